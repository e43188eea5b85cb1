"""Reading, reshaping and checking of (date, asset) panels, and their sampling frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import ValidationError, require_columns, resolve_columns
from tidemark.functions.exprs import clean

#: Median gap in days up to which a series has that many periods a year; fixed values.
FREQUENCIES = ((4, 252.0), (9, 52.0), (20, 26.0), (45, 12.0), (75, 6.0), (135, 4.0), (250, 2.0), (450, 1.0))


def ingest(data: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """``data`` with its dates as DATE and NaN as NULL in every float column: the one notion of missing from here on."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col], "ingest")
    floats = {f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in data.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return data.withColumns({**floats, date_col: F.to_date(date_col)})


def check_duplicates(data: DataFrame, subset: Sequence[str]) -> None:
    """Raise if rows share a key, with their number and three examples. This runs a job."""
    require_columns(data, subset, "check_duplicates")
    doubled = data.groupBy(*subset).count().where("count > 1")
    total = doubled.agg(F.sum("count")).first()[0]
    if total:
        examples = [tuple(r)[:-1] for r in doubled.orderBy(*subset).limit(3).collect()]
        raise ValidationError(f"{total} rows share a key over {list(subset)}, e.g. {examples}")


def value_column(data: DataFrame, value: str | None, keys: Sequence[str]) -> str:
    """``value``, or the one column besides the keys."""
    if value is not None:
        require_columns(data, [value], "value")
        return value
    rest = [c for c in data.columns if c not in keys]
    if len(rest) != 1:
        raise ValidationError(f"value must be named; candidates: {rest}")
    return rest[0]


def as_wide(data: DataFrame, value: str | None = None, *, ids: Sequence[object] | None = None, check: bool = True, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """One row per date, one column per id. ``ids`` fixes the columns and saves the job that finds them."""
    date_col, id_col = resolve_columns(date_col, id_col)
    if id_col not in data.columns:
        return data.withColumn(date_col, F.to_date(date_col)).orderBy(date_col)
    value = value_column(data, value, (date_col, id_col))
    rows = data.select(F.to_date(date_col).alias(date_col), id_col, value)
    if check:
        check_duplicates(rows, [date_col, id_col])
    return rows.groupBy(date_col).pivot(id_col, list(ids) if ids is not None else None).agg(F.first(value)).orderBy(date_col)


def to_long(wide: DataFrame, value: str = "value", *, dropna: bool = True, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """One row per date and column of ``wide``; cells without a value go unless ``dropna`` is off."""
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(wide, [date_col], "to_long")
    rest = [c for c in wide.columns if c != date_col]
    long = wide.unpivot([date_col], rest, id_col, value).withColumn(value, clean(F.col(value)))
    return (long.where(F.col(value).isNotNull()) if dropna else long).orderBy(date_col, id_col)


def _per_year(gap: Column) -> Column:
    out = F.lit(365.25) / gap
    for most, periods in reversed(FREQUENCIES):
        out = F.when(gap <= most, F.lit(periods)).otherwise(out)
    return out


def infer_periods_per_year(data: DataFrame, *, by: str | None = None, default: float | None = None, strict: bool = True, date_col: str | None = None) -> DataFrame:
    """([by,] periods_per_year) from the median gap between distinct dates; one row in all without ``by``.

    Under two dates it is ``default``; without one, reading the value raises, or is NULL if ``strict`` is off.
    """
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, by], "infer_periods_per_year")
    keys = [by] if by else []
    days = data.where(F.col(date_col).isNotNull()).select(*keys, F.to_date(date_col).alias("_d")).distinct()
    # distinct dates are as few as the calendar has days
    gaps = days.withColumn("_gap", F.datediff("_d", F.lag("_d").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_d"))))
    median = F.median("_gap")
    missing = F.lit(float(default)) if default is not None else F.raise_error(F.lit("at least two dates are needed to infer periods_per_year")).cast("double") if strict else F.lit(None).cast("double")
    return gaps.groupBy(*keys).agg(F.when(median.isNotNull(), _per_year(median)).otherwise(missing).alias("periods_per_year"))


def with_periods(data: DataFrame, periods_per_year: float | None, *, by: str | None = None, strict: bool = True, date_col: str | None = None, needed: bool = True, name: str = "_ppy") -> DataFrame:
    """``data`` with its periods a year in a column: the given number, or inferred from all dates, or from those of each ``by``."""
    if not needed:
        return data.withColumn(name, F.lit(1.0))
    if periods_per_year is not None:
        if periods_per_year <= 0:
            raise ValidationError(f"periods_per_year must be positive, not {periods_per_year}")
        return data.withColumn(name, F.lit(float(periods_per_year)))
    found = infer_periods_per_year(data, by=by, strict=strict, date_col=date_col).withColumnRenamed("periods_per_year", name)
    if by is None:
        return data.crossJoin(F.broadcast(found))  # one row
    return data.join(found.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def resolve_periods_per_year(data: DataFrame, periods_per_year: float | None = None, *, date_col: str | None = None) -> DataFrame:
    """One row with periods_per_year: the given number or the inferred one."""
    if periods_per_year is None:
        return infer_periods_per_year(data, date_col=date_col)
    if periods_per_year <= 0:
        raise ValidationError(f"periods_per_year must be positive, not {periods_per_year}")
    return data.sparkSession.range(1).select(F.lit(float(periods_per_year)).alias("periods_per_year"))


def date_grid(data: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """(date, t): the panel's own dates numbered from 1; "previous period" means t - 1."""
    date_col, _ = resolve_columns(date_col)
    days = data.where(F.col(date_col).isNotNull()).select(F.to_date(date_col).alias(date_col)).distinct()
    return days.withColumn("t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date_col)))


def on_grid(data: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """``data`` with ``t`` of :func:`date_grid`."""
    date_col, _ = resolve_columns(date_col)
    dated = data.withColumn(date_col, F.to_date(date_col))
    return dated.join(date_grid(dated, date_col=date_col), date_col)


def store_panel(data: DataFrame, table: str, *, buckets: int, mode: str = "error", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """Write a panel as the table ``table`` in ``buckets`` buckets by date, sorted by date and id, and read it.

    Windows, ranks and sums by date then read whole dates from their buckets: their plans have no exchange (and, by
    date alone, no sort). A date's rows lie in one file, so take buckets of a size that a task holds; lags by asset are
    still shuffled. Rows without a date are kept.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, id_col], "store_panel")
    if buckets < 1:
        raise ValidationError(f"buckets must be at least 1, not {buckets}")
    dated = data.withColumn(date_col, F.to_date(date_col))
    # dealt by the buckets' own hash: one file a bucket, not one for each task and bucket
    dated.repartition(buckets, date_col).write.bucketBy(buckets, date_col).sortBy(date_col, id_col).mode(mode).saveAsTable(table)
    return data.sparkSession.table(table)
