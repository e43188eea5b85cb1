import numpy as np
import pytest
from fixtures import frame, month_end, segments
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import attribution


def by(rows, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in rows}


def test_effects(spark):
    e = {(r["date"], r["segment"]): r for r in attribution.effects_from_segments(segments(spark)).collect()}
    assert e[month_end(0), "A"]["allocation"] == pytest.approx(0.002) and e[month_end(0), "B"]["allocation"] == pytest.approx(0.002)
    assert e[month_end(0), "A"]["selection"] == pytest.approx(0.01) and e[month_end(0), "A"]["interaction"] == pytest.approx(0.002)
    t = attribution.total_returns(segments(spark)).orderBy("date").first()
    assert tuple(t)[1:] == pytest.approx((0.068, 0.06, 0.008))


@pytest.mark.parametrize("model", ["bf", "bhb"])
@pytest.mark.parametrize("terms", [2, 3])
def test_effects_add_up_to_the_active_return(spark, model, terms):
    effects = attribution.effects_from_segments(segments(spark), model=model, terms=terms)
    names = effects.columns[2:]
    total = by(effects.groupBy("date").agg(F.sum(sum((F.col(n) for n in names[1:]), F.col(names[0]))).alias("x")).collect(), "date", "x")
    assert total == {(r["date"],): pytest.approx(r["active"]) for r in attribution.total_returns(segments(spark)).collect()}


@pytest.mark.parametrize("method", ["carino", "grap", "frongello", "menchero"])
def test_linked_effects_add_up_to_the_geometric_active_return(spark, method):
    table = segments(spark).unionByName(frame(spark, "date date, segment string, wp double, wb double, rp double, rb double", [(month_end(2), "A", 1.0, 0.7, 0.03, 0.01), (month_end(2), "C", 0.0, 0.3, 0.0, 0.02)]))
    totals = attribution.total_returns(table).orderBy("date").collect()
    linked = attribution.link(attribution.effects_from_segments(table), attribution.total_returns(table), method=method)
    got = linked.agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction"))).first()[0]
    want = np.prod([1 + r["portfolio"] for r in totals]) - np.prod([1 + r["benchmark"] for r in totals])
    assert got == pytest.approx(want, abs=1e-12)


def test_frongello_equals_the_recursion(spark):
    table = segments(spark)
    rows = attribution.effects_from_segments(table).orderBy("date").collect()
    totals = {r["date"]: r for r in attribution.total_returns(table).collect()}
    grown, past, want = 1.0, {}, {}
    for day in sorted(totals):
        for r in (r for r in rows if r["date"] == day):
            want[day, r["segment"]] = r["allocation"] * grown + totals[day]["benchmark"] * past.get(r["segment"], 0.0)
        for k, v in ((s, v) for (d, s), v in want.items() if d == day):
            past[k] = past.get(k, 0.0) + v
        grown *= 1 + totals[day]["portfolio"]
    got = by(attribution.link(attribution.effects_from_segments(table), attribution.total_returns(table), method="frongello").collect(), "date", "segment", "allocation")
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_assets_and_segments_agree(spark):
    assets = frame(spark, "date date, bid string, sector string, weight double, bench_weight double, ret double", [(month_end(0), "a", "A", 0.4, 0.3, 0.12), (month_end(0), "b", "A", 0.2, 0.2, 0.06), (month_end(0), "c", "B", 0.4, 0.5, 0.02), (month_end(0), "d", None, 0.5, 0.5, 9.0)])
    got = {r["segment"]: r for r in attribution.aggregate_segments(assets, segment="sector", asset_return="ret").collect()}
    assert set(got) == {"A", "B"} and got["A"]["rp"] == pytest.approx(0.1) and got["A"]["rb"] == pytest.approx(0.096) and got["A"]["wp"] == pytest.approx(0.6)
    dull = attribution.aggregate_segments(assets.withColumn("ret", F.when(F.col("bid") != "b", F.col("ret"))), segment="sector", asset_return="ret").where("segment = 'A'").first()
    assert dull["rp"] == pytest.approx(0.08)  # the weight stays
    for bad in ({}, {"asset_return": "ret", "portfolio_return": "ret", "benchmark_return": "ret"}, {"portfolio_return": "ret"}):
        with pytest.raises(ValidationError):
            attribution.aggregate_segments(assets, segment="sector", **bad)


def test_equal_portfolios_and_summary(spark):
    same = frame(spark, "date date, segment string, wp double, wb double, rp double, rb double", [(month_end(m), "A", 1.0, 1.0, 0.05, 0.05) for m in range(2)])
    linked = attribution.link(attribution.effects_from_segments(same), attribution.total_returns(same)).collect()
    assert all(r["allocation"] == r["selection"] == r["interaction"] == 0 for r in linked)
    s = {r["segment"]: r for r in attribution.brinson_summary(segments(spark), segment="segment", portfolio_weight="wp", benchmark_weight="wb", portfolio_return="rp", benchmark_return="rb").collect()}
    assert set(s) == {"A", "B", "Total"} and s["Total"]["total"] == pytest.approx(s["A"]["total"] + s["B"]["total"])


def menchero(p, b):
    """The factor of each period, from the formulas with loops."""
    n, big, small = len(p), np.prod([1 + x for x in p]) - 1, np.prod([1 + x for x in b]) - 1
    constant = (1 + big) ** ((n - 1) / n) if big == small else (big - small) / n / ((1 + big) ** (1 / n) - (1 + small) ** (1 / n))
    active = [x - y for x, y in zip(p, b, strict=True)]
    rest = big - small - constant * sum(active)
    return [constant + rest * a / sum(x * x for x in active) if any(active) else constant for a in active]


@pytest.mark.parametrize(("p", "b"), [((0.05, -0.02, 0.03), (0.01, 0.01, 0.02)), ((0.05, 0.05), (0.05, 0.05)), ((0.2,), (0.1,)), ((0.1, -0.1), (-0.1, 0.1))])
def test_menchero(spark, p, b):
    effects = frame(spark, "date date, segment string, allocation double", [(month_end(k), "A", x - y) for k, (x, y) in enumerate(zip(p, b, strict=True))])
    returns = frame(spark, "date date, portfolio double, benchmark double", [(month_end(k), *v) for k, v in enumerate(zip(p, b, strict=True))])
    got = [r["allocation"] for r in attribution.link(effects, returns, method="menchero").orderBy("date").collect()]
    assert got == pytest.approx([k * (x - y) for k, x, y in zip(menchero(p, b), p, b, strict=True)], abs=1e-14)
    assert sum(got) == pytest.approx(np.prod([1 + x for x in p]) - np.prod([1 + y for y in b]), abs=1e-14)


def nested_assets(spark):
    """Three levels; one country has no benchmark weight, one region none of the portfolio, two rows lack a name."""
    rng, rows = np.random.default_rng(5), []
    for m in range(3):
        keys = [("R1", c, s) for c in ("C1", "C2") for s in ("x", "y")] + [("R2", "C3", s) for s in "xy"] + [("R2", "C4", "x"), ("R3", "C5", "y")]
        wp, wb = rng.random(len(keys)), rng.random(len(keys))
        wb[6], wp[7] = 0.0, 0.0
        wp, wb = wp / wp.sum(), wb / wb.sum()
        rows += [(month_end(m), f"{i}{j}", *k, wp[i] / 2, wb[i] / 2, float(rng.normal(0.01, 0.05))) for i, k in enumerate(keys) for j in range(2)]
        rows += [(month_end(m), "n", "R1", None, "x", 0.5, 0.5, 9.0), (month_end(m), "o", None, None, None, 0.5, 0.5, 9.0)]
    return frame(spark, "date date, bid string, region string, country string, style string, weight double, bench_weight double, ret double", [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows])


@pytest.mark.parametrize("path", [["region"], ["region", "country"], ["region", "country", "style"]])
@pytest.mark.parametrize("terms", [2, 3])
def test_levels_add_up_to_the_active_return(spark, path, terms):
    assets = nested_assets(spark)
    assets = assets if len(path) > 1 else assets.where("country is not null")
    table = attribution.nested_segments(assets, path=path)
    effects = attribution.nested_effects(table, terms=terms)
    names = effects.columns[3:]
    total = {r["date"]: r["x"] for r in effects.groupBy("date").agg(F.sum(sum((F.col(n) for n in names[1:]), F.col(names[0]))).alias("x")).collect()}
    named = assets.where("country is not null")
    assert total == {r["date"]: pytest.approx(r["a"], abs=1e-14) for r in named.groupBy("date").agg(F.sum(F.expr("(weight - bench_weight) * ret")).alias("a")).collect()}
    if len(path) == 1:
        plain = attribution.brinson(named, segment="region", asset_return="ret", terms=terms)
        assert {(r["date"], r["segment"]): tuple(r[n] for n in names) for r in effects.collect()} == {(r["date"], r["segment"]): pytest.approx(tuple(r[n] for n in names), abs=1e-14) for r in plain.collect()}


def test_effects_within_a_parent(spark):
    rows = [(month_end(0), "a", "R", "A", 0.5, 0.3, 0.10), (month_end(0), "b", "R", "B", 0.1, 0.3, 0.02), (month_end(0), "c", "S", "C", 0.4, 0.4, 0.05)]
    assets = frame(spark, "date date, bid string, region string, country string, weight double, bench_weight double, ret double", rows)
    got = {(r["level"], r["segment"]): r["allocation"] for r in attribution.nested_effects(attribution.nested_segments(assets, path=["region", "country"])).collect()}
    assert got == pytest.approx({(1, "R"): 0.0, (1, "S"): 0.0, (2, "R > A"): 0.2 * 0.04, (2, "R > B"): -0.2 * -0.04, (2, "S > C"): 0.0}, abs=1e-15)
    with pytest.raises(ValidationError):
        attribution.nested_segments(assets, path=["region", "region"])


@pytest.mark.parametrize("method", ["carino", "grap", "frongello", "menchero"])
def test_nested_summary_closes(spark, method):
    assets = nested_assets(spark).where("country is not null")
    s = {(r["level"], r["segment"]): r for r in attribution.nested_brinson(assets, path=["region", "country"], method=method).collect()}
    days = assets.groupBy("date").agg(F.sum(F.expr("weight * ret")).alias("p"), F.sum(F.expr("bench_weight * ret")).alias("b")).collect()
    assert s[None, "Total"]["total"] == pytest.approx(np.prod([1 + r["p"] for r in days]) - np.prod([1 + r["b"] for r in days]), abs=1e-13)
    assert len(s) == 1 + 3 + 5 and s[None, "Total"]["allocation"] == pytest.approx(sum(r["allocation"] for k, r in s.items() if k[0]))
