import math

import numpy as np
import pytest
from fixtures import frame, month_end, quantile_panel
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import quantile

RETURNS = {"factor": "factor", "forward_return": "fwd_ret"}


def by(rows, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in rows}


def test_equal_fifths_and_ties_by_id(spark):
    for panel in (quantile_panel(spark), quantile_panel(spark, ties=True)):
        day = quantile.assign_quantiles(panel, factor="factor").where(F.col("date") == F.lit(month_end(0))).orderBy("bid").collect()
        assert [r["quantile"] for r in day] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    down = quantile.assign_quantiles(quantile_panel(spark), factor="factor", ascending=False).where("bid = '09'").first()
    assert down["quantile"] == 1


def test_missing_values_and_small_cells(spark):
    panel = quantile_panel(spark, holes=(0, 1))
    got = by(quantile.assign_quantiles(panel, factor="factor", missing_class=True).collect(), "bid", "date", "quantile")
    assert got["00", month_end(0)] == 0 and got["02", month_end(0)] == 1
    assert {r[0] for r in quantile.assign_quantiles(panel, factor="factor", min_assets=9, missing_class=True).select("quantile").collect()} == {None}
    r = by(quantile.quantile_returns(panel, **RETURNS, include_missing=True).collect(), "date", "quantile", "ret")
    assert r[month_end(0), 0] == pytest.approx(0.005)
    assert quantile.quantile_labels(2, include_missing=True) == ["Q1", "Q2", "NA"]


def test_returns_and_spread(spark):
    panel = quantile_panel(spark)
    returns = quantile.quantile_returns(panel, **RETURNS)
    r = by(returns.collect(), "date", "quantile", "ret")
    assert r[month_end(0), 1] == pytest.approx(0.005) and r[month_end(0), 5] == pytest.approx(0.085)
    assert {round(x["ret"], 12) for x in quantile.long_short_returns(returns).collect()} == {0.08}
    assert {round(x["ret"], 12) for x in quantile.long_short_returns(returns, long=2, short=3).collect()} == {-0.02}
    w = by(quantile.quantile_returns(panel, **RETURNS, weight="mktcap").collect(), "date", "quantile", "ret")
    assert w[month_end(0), 1] == pytest.approx(0.0075)
    wide = quantile.widen(returns, 5)
    assert wide.columns == ["date", "Q1", "Q2", "Q3", "Q4", "Q5"] and wide.count() == 6
    summary = by(quantile.quantile_summary(returns).collect(), "quantile", "annualized_return")
    assert summary[(5,)] == pytest.approx(1.085**12 - 1)


def test_class_returns(spark):
    panel = quantile_panel(spark).withColumn("rating", F.expr("case when factor < 3 then 'C' when factor < 7 then 'B' when factor < 9 then 'A' end"))
    day = lambda df: {r["class"]: round(r["ret"], 12) for r in df.where(F.col("date") == F.lit(month_end(0))).collect()}
    assert day(quantile.class_returns(panel, classes="rating", forward_return="fwd_ret")) == {"C": 0.01, "B": 0.045, "A": 0.075}
    assert day(quantile.class_returns(panel, classes="rating", forward_return="fwd_ret", include_missing=True))["NA"] == 0.09
    assert set(day(quantile.class_returns(panel, classes="rating", forward_return="fwd_ret", class_order=["A"]))) == {"A"}


@pytest.fixture(scope="module")
def grid(spark):
    return frame(spark, "date date, bid string, a double, b double, fwd_ret double", [(month_end(m), f"{i}{j}", float(i), float(j), i * 0.01) for m in range(6) for i in range(5) for j in range(5)])


def test_double_sort(grid):
    sort = {"factor_1": "a", "factor_2": "b"}
    cells = quantile.double_sort_returns(grid, **sort, forward_return="fwd_ret")
    assert cells.count() == 6 * 25
    got = by(quantile.double_sort_summary(cells).collect(), "q1", "q2", "annualized_return")
    assert got[5, 1] == pytest.approx(1.04**12 - 1) and got[1, 1] == pytest.approx(0)
    assert {r["mean_count"] for r in quantile.double_sort_counts(grid, **sort).collect()} == {1.0}
    assert {r["n_periods"] for r in quantile.double_sort_summary(cells, statistic="n_periods").collect()} == {6.0}
    one = quantile.double_sort_summary(cells.where(F.col("date") == F.lit(month_end(0)))).collect()
    assert {r["annualized_return"] for r in one} == {None}
    with pytest.raises(ValidationError):
        quantile.double_sort_summary(cells, statistic="nope")


def test_information_coefficient(spark):
    panel = quantile_panel(spark)
    assert {round(r["ic"], 12) for r in quantile.information_coefficient(panel, **RETURNS).collect()} == {1.0}
    assert {r["ic"] for r in quantile.information_coefficient(panel, **RETURNS, min_assets=11).collect()} == {None}
    assert {round(r["ic"], 12) for r in quantile.information_coefficient(panel, **RETURNS, group="sector", method="pearson").collect()} == {1.0}
    # ranked over its own values first, unless grouped
    toy = frame(spark, "date date, bid string, factor double, fwd_ret double, g string", [(month_end(0), str(i), f, r, "x") for i, (f, r) in enumerate([(1.0, 2.0), (2.0, 1.0), (3.0, None), (4.0, 4.0), (5.0, 3.0)])])
    own = quantile.information_coefficient(toy, **RETURNS, min_assets=2).first()["ic"]
    grouped = quantile.information_coefficient(toy, **RETURNS, min_assets=2, group="g").first()["ic"]
    assert own == pytest.approx(0.5**0.5) and grouped == pytest.approx(0.6)
    summary = quantile.ic_summary(frame(spark, "date date, ic double", [(month_end(k), v) for k, v in enumerate((0.1, 0.2, -0.1, None))])).first()
    assert summary["n_periods"] == 3 and summary["hit_rate"] == pytest.approx(2 / 3) and summary["icir_annualized"] == pytest.approx(summary["icir"] * 12**0.5)
    assert quantile.ic_summary(frame(spark, "date date, ic double", [(month_end(0), 0.1)])).collect() == []
    decay = {r["horizon"]: r["mean"] for r in quantile.factor_decay(panel.withColumn("later", -F.col("fwd_ret")), factor="factor", forward_returns=["fwd_ret", "later"]).collect()}
    assert decay == {"fwd_ret": pytest.approx(1), "later": pytest.approx(-1)}


def test_persistence(spark):
    panel = quantile_panel(spark)
    flip = panel.withColumn("factor", F.when(F.month("date") % 2 == 0, -F.col("factor")).otherwise(F.col("factor")))
    got = {r["lag"]: r["autocorrelation"] for r in quantile.factor_autocorrelation(flip, factor="factor", lags=(1, 2, 9)).collect()}
    assert got == {1: pytest.approx(-1), 2: pytest.approx(1), 9: None}
    turn = by(quantile.quantile_turnover(flip, factor="factor").collect(), "date", "quantile", "turnover")
    assert turn[month_end(0), 1] is None and turn[month_end(1), 1] == 1.0 and turn[month_end(1), 3] == 0.0
    matrix = by(quantile.quantile_transition_matrix(flip, factor="factor").collect(), "from_quantile", "to_quantile", "probability")
    assert matrix[1, 5] == 1.0 and matrix[1, 1] == 0.0 and matrix[3, 3] == 1.0 and len(matrix) == 25
    for q in range(1, 6):
        assert sum(matrix[q, k] for k in range(1, 6)) == pytest.approx(1)
    with pytest.raises(Exception, match="no transition"):
        quantile.quantile_transition_matrix(panel.where(F.col("date") == F.lit(month_end(0))), factor="factor").collect()


def test_names_that_vanish_have_left(spark):
    panel = quantile_panel(spark).where("not (bid = '00' and month(date) >= 2)")
    turn = by(quantile.quantile_turnover(panel, factor="factor", n_quantiles=2).collect(), "date", "quantile", "turnover")
    assert turn[month_end(1), 1] == pytest.approx(0.2) and turn[month_end(2), 1] == pytest.approx(0.0)


def test_standard_errors(spark):
    x = np.random.default_rng(1).normal(0.01, 0.03, 40)
    rows = frame(spark, "date date, quantile int, ret double", [(month_end(k), q, float(v) if q == 1 else 0.5) for k, v in enumerate(x) for q in (1, 2)])
    got = {r["quantile"]: r for r in quantile.quantile_errors(rows, lags=2).collect()}
    e, n = x - x.mean(), len(x)
    hac = math.sqrt((e @ e / n + sum(2 * (1 - k / 3) * (e[k:] @ e[:-k]) / n for k in (1, 2))) / n)
    assert (got[1]["mean"], got[1]["std_error"], got[1]["std_error_nw"]) == pytest.approx((x.mean(), x.std(ddof=1) / math.sqrt(n), hac))
    assert got[2]["std_error_nw"] is None and got[2]["n_periods"] == 40
