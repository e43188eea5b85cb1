import math
from datetime import date, timedelta

import pytest
from fixtures import frame, month_end

from tidemark import config
from tidemark.config import ValidationError
from tidemark.functions import scalars
from tidemark.sources import panel


def test_columns_can_be_renamed():
    assert config.resolve_columns() == ("date", "bid") and config.resolve_columns("d", None) == ("d", "bid")
    try:
        config.set_columns(date="day")
        assert config.resolve_columns() == ("day", "bid") and config.resolve_columns("d", "i") == ("d", "i")
    finally:
        config.set_columns(date="date")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValidationError, match="nope"):
        config.require_columns(spark.range(1), ["id", "nope"], "here")


def test_nan_becomes_null(spark):
    got = panel.ingest(frame(spark, "date string, bid string, x double", [("2024-01-31", "a", float("nan")), ("2024-01-31", "b", 1.0)]))
    assert sorted(map(tuple, got.collect())) == [(date(2024, 1, 31), "a", None), (date(2024, 1, 31), "b", 1.0)]


def test_wide_and_long_are_inverse(spark):
    long = frame(spark, "date date, bid string, x double", [(month_end(1), "a", 1.0), (month_end(0), "b", 2.0), (month_end(0), "a", 3.0)])
    wide = panel.as_wide(long)
    assert wide.columns == ["date", "a", "b"] and [tuple(r) for r in wide.collect()] == [(month_end(0), 3.0, 2.0), (month_end(1), 1.0, None)]
    assert sorted(map(tuple, panel.to_long(wide, "x").collect())) == sorted(map(tuple, long.collect()))
    assert panel.to_long(wide, dropna=False).count() == 4


def test_shared_keys_raise(spark):
    twice = frame(spark, "date date, bid string, x double", [(month_end(0), "a", 1.0)] * 2)
    with pytest.raises(ValidationError, match="2 rows"):
        panel.check_duplicates(twice, ["date", "bid"])
    with pytest.raises(ValidationError):
        panel.as_wide(twice)


@pytest.mark.parametrize(("step", "n", "want"), [(1, 30, 252), (7, 20, 52), (14, 20, 26), (30, 20, 12), (61, 10, 6), (91, 9, 4), (182, 6, 2), (365, 5, 1), (500, 4, 365.25 / 500)])
def test_frequency(spark, step, n, want):
    days = frame(spark, "date date", [(date(2020, 1, 1) + timedelta(days=step * k),) for k in range(n)] * 2)
    assert panel.infer_periods_per_year(days).first()[0] == pytest.approx(want)


def test_frequency_needs_two_dates(spark):
    one = frame(spark, "date date", [(month_end(0),)])
    assert panel.infer_periods_per_year(one, default=12).first()[0] == 12
    assert panel.infer_periods_per_year(one, strict=False).first()[0] is None
    with pytest.raises(Exception, match="two dates"):
        panel.infer_periods_per_year(one).collect()
    with pytest.raises(ValidationError):
        panel.resolve_periods_per_year(one, -1)


def test_grid_numbers_own_dates(spark):
    rows = frame(spark, "date date, x int", [(month_end(5), 1), (month_end(0), 2), (month_end(5), 3)])
    assert {(r["x"], r["t"]) for r in panel.on_grid(rows).collect()} == {(1, 2), (2, 1), (3, 2)}


def test_scalars():
    assert scalars.volatility_scale(4) == 2 and scalars.newey_west_lags(100) == 4 and scalars.newey_west_lags(0) == 0
    low, high = scalars.bias_confidence_interval(50)
    assert (low, high) == pytest.approx((1 - 0.196, 1 + 0.196))
    assert scalars.expected_max_sharpe(100, variance=1.0) == pytest.approx(2.5306, abs=1e-3)
    assert scalars.expected_max_sharpe(100, variance=4.0) == pytest.approx(2 * scalars.expected_max_sharpe(100, variance=1.0))
    for bad in (lambda: scalars.bias_confidence_interval(5, confidence=0.5), lambda: scalars.expected_max_sharpe(1, variance=1), lambda: scalars.volatility_scale(0)):
        with pytest.raises(ValidationError):
            bad()
    assert math.isclose(scalars.bias_confidence_interval(1, confidence=0.9)[1], 1 + 1.645 / math.sqrt(2))


def test_wide_query_has_every_region_and_equals_its_sql(spark):
    import duckdb

    from tidemark.plans.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    got = QUERIES["c3_as_wide_all"](spark, folder)
    assert got.columns == ["date", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    with duckdb.connect() as db:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        want = db.execute(SQL["c3_as_wide_all"])
        assert [d[0] for d in want.description] == got.columns
        assert sorted(want.fetchall()) == sorted((str(r[0]), *r[1:]) for r in got.collect())
