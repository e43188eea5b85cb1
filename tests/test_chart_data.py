import pytest
from fixtures import frame, month_end, segments, series

from tidemark.config import ValidationError
from tidemark.operators import attribution
from tidemark.plans import chart_data


def test_histogram_shares_its_edges(spark):
    rows = frame(spark, "k string, x double", [("a", 0.0), ("a", 1.0), ("b", 10.0), ("b", None), ("a", 9.9)])
    got = {(r["k"], r["bin"]): (r["low"], r["high"], r["n"]) for r in chart_data.histogram(rows, value="x", bins=10, by="k").collect()}
    assert got == {("a", 0): (0.0, 1.0, 1), ("a", 1): (1.0, 2.0, 1), ("a", 9): (9.0, 10.0, 1), ("b", 9): (9.0, 10.0, 1)}
    assert chart_data.histogram(rows.where("x = 0"), value="x").first()["n"] == 1


def test_series_charts(spark):
    x = series(spark, [0.1, -0.1] * 12)
    assert chart_data.annual_returns(x, x.limit(12)).orderBy("year").first()["ret"] == pytest.approx((1.1 * 0.9) ** 6 - 1)
    assert chart_data.rolling(x, "volatility").columns == ["date", "value"]
    with pytest.raises(ValidationError):
        chart_data.rolling(x, "beta")
    marks = chart_data.distribution_marks(x, level=0.5).first()
    assert marks["mean"] == pytest.approx(0) and marks["value_at_risk"] == pytest.approx(0)
    assert chart_data.rolling_mean(x, value="ret").orderBy("date").collect()[11]["rolling_mean"] == pytest.approx(0)
    assert {r["mean"] for r in chart_data.with_mean_line(frame(spark, "x double", [(1.0,), (3.0,)]), value="x").collect()} == {2.0}
    heat = chart_data.calendar_heatmap(x.withColumnRenamed("ret", "ic"), value="ic").collect()
    assert len(heat) == 24 and chart_data.with_benchmark(x, series(spark, [0.1] * 30)).count() == 30


def test_attribution_charts(spark):
    effects = attribution.effects_from_segments(segments(spark))
    run = chart_data.cumulative_effects(effects).orderBy("date").collect()
    assert run[0]["allocation"] == pytest.approx(0.004) and run[1]["date"] == month_end(1)
    summary = attribution.brinson_summary(segments(spark), segment="segment", portfolio_weight="wp", benchmark_weight="wb", portfolio_return="rp", benchmark_return="rb")
    bars = {r["effect"]: (r["start"], r["end"]) for r in chart_data.waterfall(summary).collect()}
    assert bars["allocation"][0] == 0 and bars["selection"][0] == pytest.approx(bars["allocation"][1]) and bars["total"][1] == pytest.approx(bars["interaction"][1])
    assert chart_data.effect_bars(summary).count() == 2 and chart_data.effect_heatmap(effects).count() == 4
    assert chart_data.is_stackable(frame(spark, "allocation double", [(0.1,), (-0.1,)])).first()[0] is False
