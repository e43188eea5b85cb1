import numpy as np
import pytest
from fixtures import frame, month_end
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import performance, signals, sketches
from tidemark.plans import chart_data

AT = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}


@pytest.fixture(scope="module")
def large(spark):
    """Two months of 60,000 values, skewed and with ties, and one without any."""
    x = F.when(F.col("id") % 7 == 0, 0.5).otherwise(F.exp(F.randn(3)))
    rows = spark.range(120000, numPartitions=6).select(F.when(F.col("id") % 2 == 0, F.lit(month_end(0))).otherwise(F.lit(month_end(1))).alias("date"), F.col("id").cast("string").alias("bid"), F.when(F.col("id") % 1001 != 0, x).alias("x"))
    return rows.unionAll(frame(spark, "date date, bid string, x double", [(month_end(2), "n", None), (month_end(2), "m", float("nan"))])).cache()


def off(values, found, q):
    """How far the rank of ``found`` is from that of the quantile, as a share; ties count as any of their ranks."""
    low, high = (values < found).mean(), (values <= found).mean()
    return max(0.0, low - q, q - high)


def test_rank_error_of_merged_sketches(large):
    by_part = sketches.quantile_sketches(large.withColumn("part", F.crc32("bid") % 5), value="x", by=("date", "part"))
    by_date = sketches.merged_sketches(by_part, by=("date",))
    got = {r["date"]: r for r in sketches.sketch_quantiles(by_date, AT).collect()}
    assert got[month_end(2)]["n"] == 0 and all(got[month_end(2)][n] is None for n in AT)
    for m in range(2):
        values = np.array([r[0] for r in large.where((F.col("date") == F.lit(month_end(m))) & F.col("x").isNotNull()).select("x").collect()])
        assert got[month_end(m)]["n"] == len(values)
        assert all(off(values, got[month_end(m)][n], q) <= sketches.rank_error() for n, q in AT.items())
    whole = sketches.sketch_quantiles(sketches.merged_sketches(by_date), {"p50": 0.5}).first()
    every = np.array([r[0] for r in large.where("x is not null and not isnan(x)").select("x").collect()])
    assert whole["n"] == len(every) and off(every, whole["p50"], 0.5) <= sketches.rank_error()
    for bad in (lambda: sketches.quantile_sketches(large, value="x", k=3), lambda: sketches.sketch_quantiles(by_date, {"p": 1.5}), lambda: sketches.quantile_sketches(large, value="nope")):
        with pytest.raises(ValidationError):
            bad()


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_rank_error_of_operators(large, accuracy):
    rows = large.where(F.col("date") == F.lit(month_end(0)))
    values = np.array([r[0] for r in rows.where("x is not null").select("x").collect()])
    s = signals.distribution_summary(rows, factor="x", accuracy=accuracy).first()
    found = {0.01: s["p01"], 0.5: s["p50"], 0.99: s["p99"]}
    found[0.05] = performance.value_at_risk(rows, ret="x", accuracy=accuracy).first()[0]
    found[0.1] = chart_data.distribution_marks(rows, level=0.1, ret="x", accuracy=accuracy).first()["value_at_risk"]
    clipped = signals.winsorize(rows, factor="x", lower=0.2, upper=0.8, accuracy=accuracy).agg(F.min("x_winsorized"), F.max("x_winsorized")).first()
    found |= {0.2: clipped[0], 0.8: clipped[1]}
    assert all(off(values, v, q) <= 1 / accuracy + 1e-9 and v in values for q, v in found.items())
    exact = signals.distribution_summary(rows, factor="x").first()
    assert (exact["p01"], exact["p50"], exact["p99"]) == pytest.approx(tuple(np.quantile(values, [0.01, 0.5, 0.99])))


@pytest.mark.parametrize("accuracy", [1, 50, 1000])
def test_winsorize_clips_at_the_exact_rank(spark, large, accuracy):
    got = {r["date"]: tuple(r)[1:] for r in signals.winsorize(large, factor="x", lower=0.05, upper=0.95, accuracy=accuracy).groupBy("date").agg(F.min("x_winsorized"), F.max("x_winsorized"), F.count("*")).collect()}
    assert got[month_end(2)] == (None, None, 2)
    for m in range(2):
        values = np.sort([r[0] for r in large.where((F.col("date") == F.lit(month_end(m))) & F.col("x").isNotNull()).select("x").collect()])
        low, high = (values[-(-len(values) * p // 100) - 1] for p in (5, 95))
        assert got[month_end(m)] == (low, high, 60_000)
    rows = [(month_end(0), "g" if i % 2 else None, str(i), float(i // 2)) for i in range(200)] + [(month_end(1), None, "a", 3.0)]
    small = signals.winsorize(frame(spark, "date date, sector string, bid string, x double", rows), factor="x", group="sector", lower=0.07, upper=0.95, accuracy=accuracy)
    ends = small.groupBy("date", "sector").agg(F.min("x_winsorized").alias("low"), F.max("x_winsorized").alias("high")).collect()
    assert {tuple(r) for r in ends} == {(month_end(0), None, 6.0, 94.0), (month_end(0), "g", 6.0, 94.0), (month_end(1), None, 3.0, 3.0)}


def test_partial_sums_come_before_the_shuffle(large):
    for df in (sketches.quantile_sketches(large, value="x"), signals.distribution_summary(large, factor="x", accuracy=100).select("date", "p50")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and plan.index("partial_") > plan.index("Exchange")
