import math

import numpy as np
import pytest
from fixtures import frame, month_end, risk_panel, series
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import risk

FACTORS = ["F1", "F2"]


def by(rows, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in rows}


@pytest.fixture(scope="module")
def long_half(spark):
    return frame(spark, "date date, factor_1 string, factor_2 string, cov double", [(month_end(0), "F1", "F1", 0.04), (month_end(0), "F1", "F2", 0.01), (month_end(0), "F2", "F2", 0.09)])


@pytest.fixture(scope="module")
def matrix(spark):
    return frame(spark, "date date, factor string, F1 double, F2 double", [(month_end(0), "F1", 0.04, 0.01), (month_end(0), "F2", 0.01, 0.09)])


def test_exposures_and_decomposition(spark, long_half, matrix):
    panel = risk_panel(spark)
    assert by(risk.factor_exposures(panel, factors=FACTORS).collect(), "date", "factor", "exposure")[month_end(0), "F1"] == pytest.approx(0.6)
    for cov in (long_half, matrix):
        rows = risk.risk_decomposition(panel, cov, factors=FACTORS).collect()
        assert len(rows) == 1  # the other month has no covariance
        assert rows[0]["factor_risk"] == pytest.approx(math.sqrt(0.0336)) and rows[0]["specific_risk"] == pytest.approx(math.sqrt(0.0038)) and rows[0]["total_risk"] == pytest.approx(math.sqrt(0.0374))
    as_variance = risk.risk_decomposition(panel.withColumn("specific_risk", F.lit(0.01)), long_half, factors=FACTORS, specific_is_variance=True).first()
    assert as_variance["specific_risk"] == pytest.approx(math.sqrt(0.0038))
    with pytest.raises(ValidationError):
        risk.risk_decomposition(panel, matrix.drop("F2"), factors=FACTORS)


def test_contributions_add_up_to_total_risk(spark, long_half):
    rows = risk.factor_risk_contribution(risk_panel(spark), long_half, factors=FACTORS, benchmark_weight="bench_weight").collect()
    total = risk.risk_decomposition(risk_panel(spark), long_half, factors=FACTORS, benchmark_weight="bench_weight").first()["total_risk"]
    assert sum(r["cctr"] for r in rows) == pytest.approx(total) and sum(r["pct_of_total"] for r in rows) == pytest.approx(1)
    grouped = {r["factor"]: r for r in risk.factor_risk_contribution(risk_panel(spark), long_half, factors=FACTORS, factor_groups={"F1": "style", "F2": "style"}).collect()}
    assert set(grouped) == {"style", "specific"} and grouped["style"]["mctr"] is None and sum(r["cctr"] for r in grouped.values()) == pytest.approx(math.sqrt(0.0374))


def test_return_attribution(spark):
    wide = frame(spark, "date date, F1 double, F2 double", [(month_end(0), 0.02, -0.01), (month_end(1), -0.01, 0.03)])
    long = wide.unpivot(["date"], FACTORS, "factor", "ret")
    for table in (wide, long):
        got = by(risk.factor_return_attribution(risk_panel(spark), table, factors=FACTORS, specific_return="specific_ret").collect(), "date", "factor", "contribution")
        assert got[month_end(0), "F1"] == pytest.approx(0.012) and got[month_end(0), "F2"] == pytest.approx(-0.004) and got[month_end(1), "specific"] == pytest.approx(0.01) and len(got) == 6


def test_model_validation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.15 / math.sqrt(12), 120)
    realized = series(spark, [float(v) for v in x], 2010)
    predicted = realized.select("date", F.lit(0.15).alias("risk"))
    z = x / (0.15 / math.sqrt(12))
    r = risk.bias_statistic(realized, predicted).first()
    assert (r["bias_statistic"], r["n_periods"]) == (pytest.approx(z.std(ddof=1)), 120)
    rolled = risk.rolling_bias_statistic(realized, predicted, 24).orderBy("date").collect()
    assert rolled[22]["bias_statistic"] is None and rolled[23]["bias_statistic"] == pytest.approx(z[:24].std(ddof=1))
    both = risk.realized_vs_predicted(realized, predicted).orderBy("date").collect()
    assert both[10]["realized"] is None and both[11]["ratio"] == pytest.approx(x[:12].std(ddof=1) * math.sqrt(12) / 0.15)
    low, high = risk.bias_confidence_interval(120)
    assert low < r["bias_statistic"] < high


def test_scenarios(spark):
    panel = risk_panel(spark)
    shocks = frame(spark, "scenario string, factor string, shock double", [("crash", "F1", -0.2), ("crash", "F2", 0.1), ("crash", "F9", 5.0), ("mild", "F1", -0.05), ("mild", "F1", 0.02), ("none", "F2", None)])
    own = frame(spark, "scenario string, bid string, shock double", [("crash", "a", -0.3), ("crash", "zz", 9.0), ("only", "b", 0.1)])
    got = by(risk.scenario_returns(panel, shocks, factors=FACTORS, specific_shocks=own).where(F.col("date") == F.lit(month_end(0))).collect(), "scenario", "factor", "contribution")
    assert got == pytest.approx({("crash", "F1"): -0.12, ("crash", "F2"): 0.04, ("crash", "specific"): -0.15, ("crash", "total"): -0.23, ("mild", "F1"): -0.018, ("mild", "total"): -0.018, ("none", "F2"): 0.0, ("none", "total"): 0.0, ("only", "specific"): 0.03, ("only", "total"): 0.03})
    active = by(risk.scenario_returns(panel, shocks, factors=FACTORS, benchmark_weight="bench_weight").where(F.col("date") == F.lit(month_end(0))).collect(), "scenario", "factor", "contribution")
    assert active["crash", "F1"] == pytest.approx(-0.2 * (0.6 - 0.5)) and active["crash", "total"] == pytest.approx(-0.2 * 0.1 + 0.1 * (0.4 - 0.5))
    with pytest.raises(ValidationError):
        risk.scenario_returns(panel, shocks.drop("shock"), factors=FACTORS)


def test_shocks_of_history(spark):
    values = {"F1": (0.1, -0.2, 0.05, None, 0.3), "F2": (0.0, 0.01, 0.02, 0.03, 0.04)}
    rows = frame(spark, "date date, factor string, ret double", [(month_end(k), f, v) for f, vs in values.items() for k, v in enumerate(vs)])
    windows = frame(spark, "scenario string, start date, end date", [("first two", month_end(0), month_end(1)), ("overlap", month_end(1), month_end(3)), ("empty", month_end(40), month_end(50)), ("backwards", month_end(3), month_end(1)), ("mid month", month_end(0).replace(day=5), month_end(1).replace(day=5)), (None, month_end(0), None)])
    got = {(r["scenario"], r["factor"]): (r["shock"], r["n_periods"]) for r in risk.historical_shocks(rows, windows).collect()}
    want = {("first two", "F1"): (1.1 * 0.8 - 1, 2), ("first two", "F2"): (0.01, 2), ("overlap", "F1"): (0.8 * 1.05 - 1, 2), ("overlap", "F2"): (1.01 * 1.02 * 1.03 - 1, 3), ("mid month", "F1"): (0.1, 1), ("mid month", "F2"): (0.0, 1)}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(v[0]), v[1]) for k, v in want.items())
