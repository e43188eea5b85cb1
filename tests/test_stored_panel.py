import pytest
from fixtures import quantile_panel
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import holdings, quantile, signals
from tidemark.sources import panel


@pytest.fixture(scope="module")
def stored(spark):
    rows = quantile_panel(spark, holes=(3,)).unionByName(quantile_panel(spark).limit(1).withColumn("date", F.lit(None).cast("date")))
    got = panel.store_panel(rows, "a_stored_panel", buckets=4, mode="overwrite")
    yield rows, got
    spark.sql("drop table a_stored_panel")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rounded(df):
    """Rows in an order of their own; sums are equal up to the order of addition."""
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def by_date(data):
    return {
        "clip": signals.clip_outliers(data, factor="factor", n_sigma=1.0),
        "z": signals.standardize(data, factor="factor", group="sector"),
        "rank": signals.standardize(data, factor="factor", method="rank"),
        "summary": signals.distribution_summary(data, factor="factor"),
        "quantiles": quantile.assign_quantiles(data, factor="factor"),
        "allocation": holdings.allocation(data, by="sector", weight="mktcap"),
        "characteristics": holdings.characteristics(data, columns=["factor"], weight="mktcap"),
    }


def test_what_works_by_date_needs_no_exchange(stored):
    rows, got = stored
    plain = by_date(rows)
    for name, df in by_date(got).items():
        assert exchanges(df) == 0, name
        assert exchanges(plain[name]) > 0, name
        assert rounded(df) == rounded(plain[name].select(df.columns)), name


def test_all_rows_are_kept(spark, stored):
    rows, got = stored
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValidationError):
        panel.store_panel(rows, "another", buckets=0)
    with pytest.raises(ValidationError):
        panel.store_panel(rows.drop("bid"), "another", buckets=2)
