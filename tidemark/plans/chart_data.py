"""Tidy tables behind charts: what a drawing computes beyond the operator's own result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ValidationError, require_columns, resolve_columns
from tidemark.functions.exprs import clean, full_window, quantiles, ratio
from tidemark.operators import performance


def histogram(data: DataFrame, *, value: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """([by,] bin, low, high, n): counts over ``bins`` equal steps that all groups share; empty bins are left out."""
    require_columns(data, [value, by], "histogram")
    if bins < 1:
        raise ValidationError(f"bins must be at least 1, not {bins}")
    rows = data.select(*([by] if by else []), clean(F.col(value)).alias("_x")).where(F.col("_x").isNotNull())
    ends = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor(ratio(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(at, F.lit(0)))  # one row
    counted = placed.groupBy(*([by] if by else []), "bin").agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return counted.select(*([by] if by else []), "bin", (F.col("_lo") + step * F.col("bin")).alias("low"), (F.col("_lo") + step * (F.col("bin") + 1)).alias("high"), "n")


def calendar_heatmap(data: DataFrame, *, value: str, date_col: str | None = None) -> DataFrame:
    """(year, month, value): means by calendar month."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, value], "calendar_heatmap")
    x = clean(F.col(value))
    return data.where(x.isNotNull()).groupBy(F.year(date_col).alias("year"), F.month(date_col).alias("month")).agg(F.avg(x).alias(value))


def rolling_mean(data: DataFrame, *, value: str, window: int | None = None, date_col: str | None = None) -> DataFrame:
    """(date, value, rolling_mean) over ``window`` rows, by default a tenth of the series and 12 at least."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, value], "rolling_mean")
    x = clean(F.col(value))
    width = window or max(12, data.count() // 10)
    over = Window.partitionBy(F.lit(0)).orderBy(date_col).rowsBetween(1 - width, 0)
    return data.select(date_col, x.alias(value), full_window(F.avg(x).over(over), x, width, over).alias("rolling_mean"))


def quantile_cumulative(returns: DataFrame, *, by: str = "quantile", date_col: str | None = None) -> DataFrame:
    """(date, quantile, cumulative_return)."""
    return performance.cumulative_returns(returns, by=by, date_col=date_col)


def with_benchmark(returns: DataFrame, benchmark: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """(date, ret, benchmark) on the dates that either has."""
    date_col, _ = resolve_columns(date_col)
    return returns.select(date_col, "ret").join(benchmark.select(date_col, F.col("ret").alias("benchmark")), date_col, "full")


def cumulative_effects(effects: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """(date, effects...): running sums of the effects of all segments."""
    date_col, _ = resolve_columns(date_col)
    names = [c for c in effects.columns if c not in (date_col, "segment")]
    over = Window.partitionBy(F.lit(0)).orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    return effects.groupBy(date_col).agg(*(F.sum(n).alias(n) for n in names)).select(date_col, *(F.sum(n).over(over).alias(n) for n in names))


def cumulative_contribution(contributions: DataFrame, *, by: str = "factor", date_col: str | None = None) -> DataFrame:
    """(date, factor, contribution): running sums, a missing one counting as 0."""
    date_col, _ = resolve_columns(date_col)
    over = Window.partitionBy(by).orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    return contributions.select(date_col, by, F.sum(F.coalesce("contribution", F.lit(0.0))).over(over).alias("contribution"))


def waterfall(summary: DataFrame) -> DataFrame:
    """(effect, start, end) of the Total row of a Brinson summary, ending with the total."""
    names = [c for c in summary.columns if c not in ("segment", "total")]
    bars, before = [], F.lit(0.0)
    for n in names:
        bars.append(F.struct(F.lit(n).alias("effect"), before.alias("start"), (before + F.col(n)).alias("end")))
        before = before + F.col(n)
    bars.append(F.struct(F.lit("total").alias("effect"), F.lit(0.0).alias("start"), before.alias("end")))
    return summary.where("segment = 'Total'").select(F.inline(F.array(*bars)))


def largest_contributions(contributions: DataFrame, *, n: int = 10, at: str | None = None, date_col: str | None = None) -> DataFrame:
    """The rows of one date (the last by default) with the largest absolute cctr."""
    date_col, _ = resolve_columns(date_col)
    rows = contributions
    if at is not None:
        rows = rows.where(F.col(date_col) == F.to_date(F.lit(at)))
    else:
        rows = rows.crossJoin(F.broadcast(contributions.agg(F.max(date_col).alias("_last")))).where(f"{date_col} = _last").drop("_last")  # one row
    return rows.orderBy(F.abs("cctr").desc(), "factor").limit(n)


def exposure_bars(summary: DataFrame, *, limit: float = 2.0) -> DataFrame:
    """(term, mean, t_stat_nw, significant) of an exposure summary, largest mean first."""
    require_columns(summary, ["term", "mean", "t_stat_nw"], "exposure_bars")
    return summary.select("term", "mean", "t_stat_nw", (F.abs("t_stat_nw") >= limit).alias("significant")).orderBy(F.col("mean").desc(), "term")


def cumulative_spread(spread: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """(date, cumulative_return) of a long-short series."""
    return performance.cumulative_returns(spread, date_col=date_col)


def annual_returns(returns: DataFrame, benchmark: DataFrame | None = None, *, date_col: str | None = None) -> DataFrame:
    """(year, ret[, benchmark]): returns compounded by calendar year, beside the benchmark's."""
    date_col, _ = resolve_columns(date_col)
    by_year = lambda df, name: performance.aggregate_returns(df, "year", date_col=date_col).select(F.year(date_col).alias("year"), F.col("ret").alias(name))
    own = by_year(returns, "ret")
    return own if benchmark is None else own.join(by_year(benchmark, "benchmark"), "year", "full")


def rolling(returns: DataFrame, metric: str, window: int = 12, benchmark: DataFrame | None = None, **kwargs) -> DataFrame:
    """(date, value) of a rolling metric by name; those against a benchmark need one."""
    absolute = {"volatility": performance.rolling_volatility, "sharpe": performance.rolling_sharpe}
    relative = {"beta": performance.rolling_beta, "tracking_error": performance.rolling_tracking_error, "information_ratio": performance.rolling_information_ratio}
    if metric in absolute:
        out = absolute[metric](returns, window, **kwargs)
    elif metric in relative and benchmark is not None:
        out = relative[metric](returns, benchmark, window, **kwargs)
    else:
        raise ValidationError(f"metric must be one of {[*absolute, *relative]}, the last three with a benchmark; not {metric!r}")
    return out.withColumnRenamed(f"rolling_{metric}", "value")


def distribution_marks(returns: DataFrame, *, level: float = 0.05, accuracy: int | None = None, ret: str = "ret") -> DataFrame:
    """(mean, value_at_risk): the lines drawn over a histogram of returns; ``accuracy`` as in ``value_at_risk``."""
    require_columns(returns, [ret], "distribution_marks")
    x = clean(F.col(ret))
    return returns.agg(F.avg(x).alias("mean"), quantiles(x, [level], accuracy)[0].alias("value_at_risk"))


def with_mean_line(data: DataFrame, *, value: str) -> DataFrame:
    """``data`` with the mean of a column in ``mean``."""
    require_columns(data, [value], "with_mean_line")
    return data.crossJoin(F.broadcast(data.agg(F.avg(clean(F.col(value))).alias("mean"))))  # one row


def is_stackable(allocations: DataFrame, *, value: str = "allocation") -> DataFrame:
    """(stackable): whether no part is negative, so that parts can be stacked."""
    require_columns(allocations, [value], "is_stackable")
    return allocations.agg((F.coalesce(F.min(clean(F.col(value))), F.lit(0.0)) >= 0).alias("stackable"))


def effect_heatmap(effects: DataFrame, *, effect: str = "allocation", date_col: str | None = None) -> DataFrame:
    """(date, segment, value) of one effect."""
    date_col, _ = resolve_columns(date_col)
    require_columns(effects, [date_col, "segment", effect], "effect_heatmap")
    return effects.select(date_col, "segment", F.col(effect).alias("value"))


def effect_bars(summary: DataFrame) -> DataFrame:
    """A Brinson summary without its Total row."""
    require_columns(summary, ["segment", "total"], "effect_bars")
    return summary.where("segment <> 'Total'")
