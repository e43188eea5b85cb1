import numpy as np
import pytest
from fixtures import frame, month_end, quantile_panel
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import signals


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for m in range(4):
        for i in range(30):
            size, sector = float(rng.normal(10, 2)), "ABC"[i % 3] if i % 11 else None
            factor = 2.0 * size + {"A": 1.0, "B": -1.0}.get(sector, 0.0) + float(rng.normal())
            rows.append((month_end(m), f"{i:02d}", factor if i != 7 else None, size if i != 8 else None, sector, float(i % 5) if i != 9 else None))
    return frame(spark, "date date, bid string, factor double, size double, sector string, w double", rows)


def dense(rows, with_weight):
    """Residuals and coefficients by least squares on the whole design, row by row."""
    levels = sorted({r["sector"] for r in rows if r["sector"]})
    ok = [r for r in rows if r["factor"] is not None and r["size"] is not None and (not with_weight or (r["w"] or 0) > 0)]
    x = np.array([[1.0, r["size"], *(float(r["sector"] == k) for k in levels)] for r in ok])
    y, w = np.array([r["factor"] for r in ok]), np.array([r["w"] if with_weight else 1.0 for r in ok])
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    res = y - x @ beta
    mean = (w @ y) / w.sum()
    return {r["bid"]: e for r, e in zip(ok, res, strict=True)}, dict(zip(["_const", "size", *(f"sector_{k}" for k in levels)], beta, strict=True)), 1 - (w @ res**2) / (w @ (y - mean) ** 2)


@pytest.mark.parametrize("weight", [None, "w"])
def test_regressions_equal_dense_least_squares(noisy, weight):
    got = signals.neutralize(noisy, factor="factor", by=["size", "sector"], weight=weight).collect()
    terms = signals.factor_exposure(noisy, factor="factor", factors=["size", "sector"], weight=weight).collect()
    fits = {r["date"]: r["r_squared"] for r in signals.explained_ratio(noisy, factor="factor", factors=["size", "sector"], weight=weight).collect()}
    for m in range(4):
        day = [r for r in got if r["date"] == month_end(m)]
        res, beta, r2 = dense(day, weight is not None)
        assert {r["bid"]: r["factor_neutral"] for r in day if r["factor_neutral"] is not None} == pytest.approx(res, abs=1e-8)
        assert {r["term"]: r["coef"] for r in terms if r["date"] == month_end(m)} == pytest.approx({k: v for k, v in beta.items() if k != "_const"}, abs=1e-7)
        assert fits[month_end(m)] == pytest.approx(r2, abs=1e-9)


def test_exact_fit_leaves_nothing_and_few_rows_are_skipped(spark):
    panel = quantile_panel(spark).withColumn("twice", F.col("factor") * 2 + 1)
    assert max(abs(r[0]) for r in signals.neutralize(panel, factor="factor", by="twice").select("factor_neutral").collect()) < 1e-9
    few = panel.where("bid < '02'")
    assert {r[0] for r in signals.neutralize(few, factor="factor", by="twice").select("factor_neutral").collect()} == {None}
    flat = panel.withColumn("factor", F.lit(1.0))
    assert {r["r_squared"] for r in signals.explained_ratio(flat, factor="factor", factors=["twice"]).collect()} == {None}


def test_standardizing(spark):
    panel = quantile_panel(spark, holes=(0,))
    z = signals.standardize(panel, factor="factor", group="sector")
    sums = z.groupBy("date", "sector").agg(F.avg("factor_z").alias("m"), F.stddev_samp("factor_z").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-12 and abs(r["s"] - 1) < 1e-12 for r in sums)
    ranks = signals.standardize(quantile_panel(spark, ties=True), factor="factor", method="rank").select("factor_rank").distinct().collect()
    assert [r[0] for r in ranks] == [0.55]
    w = signals.standardize(panel, factor="factor", weight="mktcap").where(F.col("date") == F.lit(month_end(0))).collect()
    x, k = np.arange(1, 10.0), np.array([3.0] + [1.0] * 8)
    mean = (k @ x) / k.sum()
    want = (x - mean) / np.sqrt(k @ (x - mean) ** 2 / k.sum())
    assert [r["factor_z"] for r in sorted(w, key=lambda r: r["bid"])] == [None, *map(pytest.approx, want)]
    assert {r[0] for r in signals.standardize(panel.withColumn("factor", F.lit(2.0)), factor="factor").select("factor_z").collect()} == {None}


def test_clipping(spark):
    panel = quantile_panel(spark)
    got = signals.winsorize(panel, factor="factor", lower=0.1, upper=0.9).agg(F.min("factor_winsorized"), F.max("factor_winsorized")).first()
    assert tuple(got) == pytest.approx((0.9, 8.1))
    got = signals.clip_outliers(panel, factor="factor", n_sigma=1).agg(F.max("factor_clipped")).first()[0]
    assert got == pytest.approx(4.5 + np.std(np.arange(10), ddof=1))
    with pytest.raises(ValidationError):
        signals.winsorize(panel, factor="factor", lower=0.9, upper=0.1)


def test_coverage_and_distribution(spark):
    panel = quantile_panel(spark, holes=(0, 1))
    universe = quantile_panel(spark).unionByName(quantile_panel(spark).withColumn("bid", F.concat("bid", F.lit("x"))))
    r = signals.coverage(panel, factor="factor", universe=universe).first()
    assert (r["n_valid"], r["n_total"], r["missing_rate"], r["coverage_rate"]) == (8, 20, pytest.approx(0.2), pytest.approx(0.4))
    r = signals.distribution_summary(frame(spark, "date date, factor double", [(month_end(0), v) for v in (1.0, 2.0, 4.0, 9.0)]), factor="factor").first()
    assert (r["skew"], r["kurtosis"], r["p50"]) == (pytest.approx(1.3309, abs=1e-4), pytest.approx(1.5, abs=1e-9), 3.0)
    r = signals.distribution_summary(frame(spark, "date date, factor double", [(month_end(0), 1.0)] * 5), factor="factor").first()
    assert (r["skew"], r["kurtosis"]) == (0.0, 0.0)


def test_correlations(spark):
    panel = quantile_panel(spark).withColumns({"same": F.col("factor"), "minus": -F.col("factor"), "flat": F.lit(1.0)})
    got = {(r["factor_1"], r["factor_2"]): r["correlation"] for r in signals.signal_correlation(panel, factors=["factor", "minus", "flat"]).collect()}
    assert got["factor", "minus"] == pytest.approx(-1) and got["minus", "factor"] == pytest.approx(-1) and got["factor", "factor"] == pytest.approx(1) and got["flat", "factor"] is None
    assert {round(r["correlation"], 12) for r in signals.rolling_signal_correlation(panel, factors=["factor", "same"]).collect()} == {1.0}
    with pytest.raises(ValidationError):
        signals.signal_correlation(panel, factors=["factor"])


def test_exposure_summary(spark):
    e = frame(spark, "date date, term string, coef double", [(month_end(k), "x", v) for k, v in enumerate((1.0, -1.0, 2.0, 2.0))])
    r = signals.exposure_summary(e).first()
    assert (r["mean"], r["hit_rate"], r["n_periods"]) == (1.0, 0.75, 4) and r["t_stat"] == pytest.approx(1 / (np.std([1, -1, 2, 2], ddof=1) / 2))


@pytest.fixture(scope="module")
def classed(spark):
    """Three dates of classes that nest, cross and are missing; on the last date there are too few rows."""
    rng, rows = np.random.default_rng(11), []
    for m, n in enumerate((90, 70, 12)):
        for i in range(n):
            a = f"a{rng.integers(0, 12)}" if rng.random() > 0.05 else None
            b = f"b{rng.integers(0, 9)}" if rng.random() > 0.05 else None
            size = float(rng.normal(10, 2))
            y = 0.5 * size + (int(a[1:]) if a else 3.0) - 2.0 * (int(b[1:]) if b else 1.0) + float(rng.normal())
            rows.append((month_end(m), f"{i:03d}", y if i % 17 else None, size, a, b, "xyz"[i % 3], float(i % 4) if i % 13 else None))
    return frame(spark, "date date, bid string, factor double, size double, a string, b string, c string, w double", rows)


@pytest.mark.parametrize(("by", "weight", "absorb"), [(["a"], None, True), (["size", "a"], "w", "a"), (["size", "a", "b"], None, True), (["b", "a", "c", "size"], "w", "b")])
def test_absorbed_classes_leave_the_same_residuals(classed, by, weight, absorb):
    key = ["date", "bid"]
    want = {tuple(r[:2]): r[2] for r in signals.neutralize(classed, factor="factor", by=by, weight=weight).select(*key, "factor_neutral").collect()}
    got = {tuple(r[:2]): r[2] for r in signals.neutralize(classed, factor="factor", by=by, weight=weight, absorb=absorb).select(*key, "factor_neutral").collect()}
    assert got.keys() == want.keys() and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert any(v is not None for v in got.values()) and all(abs(v - want[k]) < 1e-9 for k, v in got.items() if v is not None)
    if len(by) == 3:
        fits = lambda **k: {r[0]: r[1] for r in signals.explained_ratio(classed, factor="factor", factors=by, weight=weight, **k).collect()}
        assert fits(absorb=True) == pytest.approx(fits(), abs=1e-9)


@pytest.mark.parametrize("by", [["a"], ["size", "a", "c"]])
def test_absorbed_classes_have_the_coefficients_of_least_norm(classed, by):
    found = lambda **k: {(r["date"], r["term"]): r["coef"] for r in signals.factor_exposure(classed, factor="factor", factors=by, **k).collect()}
    want = found()
    assert found(absorb=True, levels=False) == pytest.approx(found(levels=False), abs=1e-8)
    assert found(absorb=True) == pytest.approx(want, abs=1e-8) and len(want) > 20


def test_thousands_of_levels(spark):
    """5,000 levels: each mean is taken out, and the slope is that of what is left."""
    rows = spark.range(20000).selectExpr("date'2024-01-31' as date", "cast(id as string) as bid", "concat('k', id % 5000) as k", "cast(pmod(id * 7919, 1009) as double) as size", "cast(pmod(id * 104729, 997) as double) as noise").withColumn("factor", F.expr("3 * size + cast(substr(k, 2) as double) + noise"))
    got = signals.neutralize(rows, factor="factor", by=["size", "k"], absorb=True)
    pdf = got.toPandas()
    less = pdf.groupby("k")[["factor", "size"]].transform("mean")
    dy, dx = pdf["factor"] - less["factor"], pdf["size"] - less["size"]
    want = dy - dx * (dx @ dy) / (dx @ dx)
    assert np.abs(pdf["factor_neutral"] - want).max() < 1e-8
    with pytest.raises(ValidationError):
        signals.neutralize(rows, factor="factor", by=["size"], absorb=True)
    with pytest.raises(ValidationError):
        signals.neutralize(rows, factor="factor", by=["k"], absorb="nope")
