"""Calendar aggregation of returns that arrive over time (the streaming form of ``performance.aggregate_returns``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import one_of, require_columns, resolve_columns
from tidemark.functions.exprs import clean, growth
from tidemark.operators import performance

#: How long a period stays open after the end of the latest period seen.
DELAY = "100 days"


def period_growth(stream: DataFrame, freq: str = "month", *, delay: str = DELAY, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """(period, [by,] growth, n): the product of 1 + return over each calendar period, for a stream or a table.

    The watermark is on the period's last day: a row counts unless its period ends ``delay`` or more before the latest
    period's end that all triggers but the last one have seen; such rows are dropped, and no others. State is a row for each
    open period and series, whatever the number of returns. Missing returns leave a period as it is.
    """
    date_col, _ = resolve_columns(date_col)
    require_columns(stream, [date_col, ret, by], "period_growth")
    one_of("freq", freq, performance.PERIODS)
    end = performance.PERIODS[freq][0](F.to_date(date_col)).cast("timestamp")
    rows = stream.where(F.col(date_col).isNotNull()).select(end.alias("period"), *([by] if by else []), clean(F.col(ret)).alias("_r"))
    return rows.withWatermark("period", delay).groupBy("period", *([by] if by else [])).agg(growth(F.col("_r")).alias("growth"), F.count("_r").alias("n"))


def write_period_growth(stream: DataFrame, path: str, checkpoint: str, freq: str = "month", *, trigger: dict | None = None, **kwargs) -> StreamingQuery:
    """Start a query that keeps the periods touched by each trigger under ``path``, a folder for each trigger.

    A trigger that is run again after a failure writes its own folder again, so that nothing counts twice; the state lies
    in ``checkpoint``, from where a new query goes on. ``trigger`` is that of the writer; by default all that is there is
    read and the query ends. The rest as in :func:`period_growth`.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    grown = period_growth(stream, freq, **kwargs)
    return grown.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_period_returns(spark: SparkSession, path: str, freq: str = "month", *, by: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, [by,] ret) as ``performance.aggregate_returns`` gives for the same rows: each period as its last trigger left it."""
    date_col, _ = resolve_columns(date_col)
    keys = ["period", *([by] if by else [])]
    last = spark.read.option("basePath", path).parquet(f"{path}/trigger=*").groupBy(*keys).agg(F.max_by("growth", "trigger").alias("growth"))
    closed = last.select(F.to_date("period").alias(date_col), *keys[1:], (F.col("growth") - 1).alias("ret"))
    return performance.aggregate_returns(closed, freq, by=by, date_col=date_col)
