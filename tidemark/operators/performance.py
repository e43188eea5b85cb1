"""Metrics of return series.

A series is (date, ret), or (date, series, ret) with ``by="series"``; every metric gives one row a series. Panels are
aggregated by date before they come here, so a series has no more rows than the calendar has days.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.config import ValidationError, one_of, require_columns, resolve_columns
from tidemark.functions.exprs import adjusted_kurtosis, adjusted_skew, clean, full_window, growth, quantiles, ratio
from tidemark.sources.panel import with_periods

#: How a period's days are named when returns are compounded to it: last day of month, quarter or year.
PERIODS: dict[str, tuple[Callable[[Column], Column], int]] = {
    "month": (F.last_day, 1),
    "quarter": (lambda d: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)), 3),
    "year": (lambda d: F.last_day(F.add_months(F.trunc(d, "year"), 11)), 12),
}


def _keys(by: str | None) -> list[str]:
    return [by] if by else []


def _series(returns: DataFrame, ret: str, by: str | None, date_col: str | None) -> tuple[DataFrame, str]:
    date_col, _ = resolve_columns(date_col)
    require_columns(returns, [date_col, ret, by], "returns")
    return returns.select(F.to_date(date_col).alias(date_col), *_keys(by), clean(F.col(ret)).alias("_r")), date_col


def _running(by: str | None, date_col: str) -> WindowSpec:
    return Window.partitionBy(*(_keys(by) or [F.lit(0)])).orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)


def _rolling(by: str | None, date_col: str, window: int) -> WindowSpec:
    if window < 1:
        raise ValidationError(f"window must be at least 1, not {window}")
    return Window.partitionBy(*(_keys(by) or [F.lit(0)])).orderBy(date_col).rowsBetween(1 - window, 0)


# ---- building blocks over _r, _b (benchmark) and _ppy ---------------------------------------------------------------

R, B, PPY = "_r", "_b", "_ppy"


def _ppy() -> Column:
    return F.max(PPY)


def _periodic(risk_free: float) -> Column:
    return F.pow(F.lit(1.0 + risk_free), 1 / F.col(PPY)) - 1


def _deviation(x: Column, ddof: int) -> Column:
    one_of("ddof", ddof, (0, 1))
    return F.stddev_samp(x) if ddof else F.when(F.count(x) > 0, F.stddev_pop(x))


def _total(x: Column) -> Column:
    return growth(x) - 1


def _cagr(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 0, F.pow(growth(x), ratio(_ppy(), n)) - 1)


def _volatility(x: Column, ddof: int = 1) -> Column:
    return _deviation(x, ddof) * F.sqrt(_ppy())


def _sharpe(x: Column, risk_free: float = 0.0, ddof: int = 1) -> Column:
    excess = x - _periodic(risk_free)
    return ratio(F.avg(excess), _deviation(excess, ddof)) * F.sqrt(_ppy())


def _sortino(x: Column, risk_free: float = 0.0, target: float = 0.0) -> Column:
    excess = x - _periodic(risk_free)
    under = F.when(excess.isNotNull(), F.least(excess - target, F.lit(0.0)))
    return ratio(F.avg(excess), F.sqrt(F.avg(under * under))) * F.sqrt(_ppy())


def _hits(x: Column) -> Column:
    return ratio(F.count_if(x > 0), F.count(x))


def _win_loss(x: Column) -> Column:
    return ratio(F.avg(F.when(x > 0, x)), F.abs(F.avg(F.when(x < 0, x))))


def _beta(x: Column, b: Column) -> Column:
    both = x.isNotNull() & b.isNotNull()
    return ratio(F.covar_samp(F.when(both, x), F.when(both, b)), F.var_samp(b))


def _capture(x: Column, b: Column, side: str) -> Column:
    here = b > 0 if side == "up" else b < 0
    return F.when(F.count_if(here) > 0, ratio(_total(F.when(here, x)), _total(F.when(here, b))))


def _metric(name: str, build: Callable[[Column], Column], returns: DataFrame, ret: str, by: str | None, date_col: str | None, periods: float | None = None, annual: bool = False) -> DataFrame:
    rows, date_col = _series(returns, ret, by, date_col)
    if annual:
        rows = with_periods(rows, periods, date_col=date_col)
    return rows.groupBy(*_keys(by)).agg(build(F.col(R)).alias(name))


def each_column(metric: Callable[..., DataFrame], wide: DataFrame, *args, series: Sequence[str] | None = None, by: str = "series", date_col: str | None = None, **kwargs) -> DataFrame:
    """``metric`` of every series of a frame with one column each, told apart in ``by``: any function of this module that
    takes ``by``, with its other arguments, as in ``each_column(sharpe_ratio, wide, risk_free=0.01)``.

    ``series`` names the columns; by default all but the date. A series is as long as the frame: missing returns stay.
    """
    date_col, _ = resolve_columns(date_col)
    require_columns(wide, [date_col, *(series or [])], "each_column")
    names = [c for c in wide.columns if c != date_col] if series is None else list(series)
    if not names:
        raise ValidationError("the frame has no column of returns")
    long = wide.select(date_col, *(clean(F.col(f"`{c}`")).alias(c) for c in names)).unpivot([date_col], [F.col(f"`{c}`") for c in names], by, "ret")
    return metric(long, *args, by=by, date_col=date_col, **kwargs)


# ---- level and risk ---------------------------------------------------------------------------------------------------


def cumulative_returns(returns: DataFrame, *, log: bool = False, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, [by,] cumulative_return): compounded, or summed logs; a missing return counts as 0."""
    rows, date_col = _series(returns, ret, by, date_col)
    over, x = _running(by, date_col), F.coalesce(R, F.lit(0.0))
    total = F.sum(F.log1p(x)).over(over) if log else F.product(1 + x).over(over) - 1
    return rows.select(date_col, *_keys(by), total.alias("cumulative_return"))


def total_return(returns: DataFrame, *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _metric("total_return", _total, returns, ret, by, date_col)


def annualized_return(returns: DataFrame, *, periods_per_year: float | None = None, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """Compound rate a year over the non-missing periods; NULL without any."""
    return _metric("annualized_return", _cagr, returns, ret, by, date_col, periods_per_year, True)


def annualized_volatility(returns: DataFrame, *, periods_per_year: float | None = None, ddof: int = 1, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _metric("annualized_volatility", lambda x: _volatility(x, ddof), returns, ret, by, date_col, periods_per_year, True)


def sharpe_ratio(returns: DataFrame, *, risk_free: float = 0.0, periods_per_year: float | None = None, ddof: int = 1, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """Annualised mean excess over deviation; ``risk_free`` is a yearly rate, converted geometrically."""
    return _metric("sharpe_ratio", lambda x: _sharpe(x, risk_free, ddof), returns, ret, by, date_col, periods_per_year, True)


def sortino_ratio(returns: DataFrame, *, risk_free: float = 0.0, target: float = 0.0, periods_per_year: float | None = None, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """Mean excess over the root mean square of what falls short of ``target``; all periods count below the line."""
    return _metric("sortino_ratio", lambda x: _sortino(x, risk_free, target), returns, ret, by, date_col, periods_per_year, True)


def drawdown(returns: DataFrame, *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, [by,] drawdown): wealth over its highest so far, less 1; the first period's wealth is the first high."""
    rows, date_col = _series(returns, ret, by, date_col)
    over = _running(by, date_col)
    wealth = rows.withColumn("_w", F.product(1 + F.coalesce(R, F.lit(0.0))).over(over))
    return wealth.select(date_col, *_keys(by), (ratio(F.col("_w"), F.max("_w").over(over)) - 1).alias("drawdown"))


def max_drawdown(returns: DataFrame, *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return drawdown(returns, ret=ret, by=by, date_col=date_col).groupBy(*_keys(by)).agg(F.min("drawdown").alias("max_drawdown"))


def _beside(left: DataFrame, right: DataFrame, by: str | None) -> DataFrame:
    """Two tables of one row a series, side by side."""
    if by is None:
        return left.crossJoin(F.broadcast(right))  # one row each
    return left.join(right.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def calmar_ratio(returns: DataFrame, *, periods_per_year: float | None = None, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    both = _beside(annualized_return(returns, periods_per_year=periods_per_year, ret=ret, by=by, date_col=date_col), max_drawdown(returns, ret=ret, by=by, date_col=date_col), by)
    return both.select(*_keys(by), ratio(F.col("annualized_return"), F.abs("max_drawdown")).alias("calmar_ratio"))


def drawdown_table(returns: DataFrame, *, top: int = 5, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """([by,] rank, peak, valley, recovery, max_drawdown, length, recovery_length), deepest first.

    Lengths count data points; an episode that has not recovered ends with the series and has no recovery.
    """
    rows = drawdown(returns, ret=ret, by=by, date_col=date_col)
    date_col, _ = resolve_columns(date_col)
    keys = _keys(by) or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(date_col)
    marked = rows.withColumns({"_pos": F.row_number().over(order), "_prev": F.lag(date_col).over(order), "_next": F.lead(date_col).over(order), "_under": F.col("drawdown") < 0})
    starts = marked.withColumn("_start", (F.col("_under") & ~F.coalesce(F.lag("_under").over(order), F.lit(False))).cast("int"))
    spells = starts.withColumn("_spell", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_under")
    lowest = F.min(F.struct("drawdown", "_pos", date_col))
    got = spells.groupBy(*_keys(by), "_spell").agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last"), F.min_by(F.coalesce("_prev", date_col), "_pos").alias("peak"), F.max_by("_next", "_pos").alias("recovery"), lowest.alias("_low"))
    end = F.col("_last") + F.col("recovery").isNotNull().cast("int")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_low.drawdown", "_first"))
    table = got.withColumn("rank", rank).where(F.col("rank") <= top)
    return table.select(*_keys(by), "rank", "peak", F.col(f"_low.{date_col}").alias("valley"), "recovery", F.col("_low.drawdown").alias("max_drawdown"), (end - F.greatest(F.col("_first") - 1, F.lit(1))).alias("length"), F.when(F.col("recovery").isNotNull(), end - F.col("_low._pos")).alias("recovery_length"))


def value_at_risk(returns: DataFrame, *, level: float = 0.05, accuracy: int | None = None, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """The interpolated quantile; with ``accuracy`` a return whose rank is off by count / accuracy at most, from summaries of bounded size."""
    return _metric("value_at_risk", lambda x: quantiles(x, [level], accuracy)[0], returns, ret, by, date_col)


def _tail(rows: DataFrame, level: float, by: str | None) -> DataFrame:
    """([by,] var, cvar) of ``_r``."""
    limit = rows.groupBy(*_keys(by)).agg(F.percentile(R, F.lit(level)).alias("_var"))
    return _beside(rows, limit, by).groupBy(*_keys(by)).agg(F.max("_var").alias("var"), F.avg(F.when(F.col(R) <= F.col("_var"), F.col(R))).alias("cvar"))


def conditional_value_at_risk(returns: DataFrame, *, level: float = 0.05, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """Mean of the returns at or under the value at risk."""
    rows, _ = _series(returns, ret, by, date_col)
    return _tail(rows, level, by).select(*_keys(by), F.col("cvar").alias("conditional_value_at_risk"))


def hit_rate(returns: DataFrame, *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _metric("hit_rate", _hits, returns, ret, by, date_col)


def win_loss_ratio(returns: DataFrame, *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _metric("win_loss_ratio", _win_loss, returns, ret, by, date_col)


# ---- against a benchmark -----------------------------------------------------------------------------------------------


def _aligned(returns: DataFrame, benchmark: DataFrame, ret: str, benchmark_ret: str, by: str | None, date_col: str | None) -> tuple[DataFrame, str]:
    """Rows on the dates both have, with _r, _b and the difference _a."""
    rows, date_col = _series(returns, ret, by, date_col)
    require_columns(benchmark, [date_col, benchmark_ret], "benchmark")
    other = benchmark.select(F.to_date(date_col).alias(date_col), clean(F.col(benchmark_ret)).alias(B))
    return rows.join(other, date_col).withColumn("_a", F.col(R) - F.col(B)), date_col


def active_returns(returns: DataFrame, benchmark: DataFrame, *, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, [by,] active_return) on the dates both have."""
    rows, date_col = _aligned(returns, benchmark, ret, benchmark_ret, by, date_col)
    return rows.select(date_col, *_keys(by), F.col("_a").alias("active_return"))


def _relative(name: str, build: Callable[[Column, Column, Column], Column], returns: DataFrame, benchmark: DataFrame, ret: str, benchmark_ret: str, by: str | None, date_col: str | None, periods: float | None = None, annual: bool = False) -> DataFrame:
    rows, date_col = _aligned(returns, benchmark, ret, benchmark_ret, by, date_col)
    if annual:
        rows = with_periods(rows, periods, date_col=date_col)
    return rows.groupBy(*_keys(by)).agg(build(F.col(R), F.col(B), F.col("_a")).alias(name))


def tracking_error(returns: DataFrame, benchmark: DataFrame, *, periods_per_year: float | None = None, ddof: int = 1, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _relative("tracking_error", lambda r, b, a: _volatility(a, ddof), returns, benchmark, ret, benchmark_ret, by, date_col, periods_per_year, True)


def _information(a: Column, ddof: int = 1) -> Column:
    return ratio(F.avg(a) * _ppy(), _volatility(a, ddof))


def information_ratio(returns: DataFrame, benchmark: DataFrame, *, periods_per_year: float | None = None, ddof: int = 1, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _relative("information_ratio", lambda r, b, a: _information(a, ddof), returns, benchmark, ret, benchmark_ret, by, date_col, periods_per_year, True)


def beta(returns: DataFrame, benchmark: DataFrame, *, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """Covariance over rows complete in both, over the benchmark's variance on all common dates."""
    return _relative("beta", lambda r, b, a: _beta(r, b), returns, benchmark, ret, benchmark_ret, by, date_col)


def _alpha(r: Column, b: Column, risk_free: float) -> Column:
    return _cagr(r) - (F.lit(risk_free) + _beta(r, b) * (_cagr(b) - F.lit(risk_free)))


def alpha(returns: DataFrame, benchmark: DataFrame, *, risk_free: float = 0.0, periods_per_year: float | None = None, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    return _relative("alpha", lambda r, b, a: _alpha(r, b, risk_free), returns, benchmark, ret, benchmark_ret, by, date_col, periods_per_year, True)


def capture_ratio(returns: DataFrame, benchmark: DataFrame, *, side: str = "up", ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """Compounded return over the benchmark's, over the periods in which the benchmark rose (or fell)."""
    one_of("side", side, ("up", "down"))
    return _relative(f"{side}_capture", lambda r, b, a: _capture(r, b, side), returns, benchmark, ret, benchmark_ret, by, date_col)


# ---- calendar ----------------------------------------------------------------------------------------------------------


def aggregate_returns(returns: DataFrame, freq: str = "month", *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, [by,] ret) compounded to period ends; periods without rows inside the range give 0."""
    one_of("freq", freq, PERIODS)
    rows, date_col = _series(returns, ret, by, date_col)
    end, months = PERIODS[freq]
    per = rows.groupBy(*_keys(by), end(F.col(date_col)).alias(date_col)).agg(_total(F.col(R)).alias("_t"))
    bounds = per.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    firsts = bounds.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr(f"interval {months} month"))).alias("_f"))
    spine = firsts.select(F.last_day("_f").alias(date_col))
    if by:
        spine = spine.crossJoin(rows.select(by).distinct())  # period ends times series: the result's size
        out = spine.alias("s").join(per.alias("p"), (F.col(f"s.{date_col}") == F.col(f"p.{date_col}")) & F.col(f"s.{by}").eqNullSafe(F.col(f"p.{by}")), "left")
        return out.select(f"s.{date_col}", f"s.{by}", F.coalesce("p._t", F.lit(0.0)).alias("ret"))
    return spine.join(per, date_col, "left").select(date_col, F.coalesce("_t", F.lit(0.0)).alias("ret"))


def monthly_table(returns: DataFrame, *, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """([by,] year, 01 .. 12, year_total)."""
    monthly = aggregate_returns(returns, "month", ret=ret, by=by, date_col=date_col)
    date_col, _ = resolve_columns(date_col)
    keyed = monthly.withColumns({"year": F.year(date_col), "month": F.date_format(date_col, "MM")})
    months = [f"{m:02d}" for m in range(1, 13)]
    cells = {m: F.max(F.when(F.col("month") == m, F.col("ret"))) for m in months}
    return keyed.groupBy(*_keys(by), "year").agg(*(c.alias(m) for m, c in cells.items()), _total(F.col("ret")).alias("year_total"))


# ---- rolling -----------------------------------------------------------------------------------------------------------


def rolling_volatility(returns: DataFrame, window: int, *, periods_per_year: float | None = None, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """NULL unless the window is full of values, as in all rolling metrics."""
    rows, date_col = _series(returns, ret, by, date_col)
    over, x = _rolling(by, date_col, window), F.col(R)
    value = F.stddev_samp(x).over(over) * F.sqrt(PPY)
    return with_periods(rows, periods_per_year, date_col=date_col).select(date_col, *_keys(by), full_window(value, x, window, over).alias("rolling_volatility"))


def rolling_sharpe(returns: DataFrame, window: int, *, risk_free: float = 0.0, periods_per_year: float | None = None, ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    rows, date_col = _series(returns, ret, by, date_col)
    over, x = _rolling(by, date_col, window), F.col(R) - _periodic(risk_free)
    value = ratio(F.avg(x).over(over), F.stddev_samp(x).over(over)) * F.sqrt(PPY)
    return with_periods(rows, periods_per_year, date_col=date_col).select(date_col, *_keys(by), full_window(value, x, window, over).alias("rolling_sharpe"))


def rolling_beta(returns: DataFrame, benchmark: DataFrame, window: int, *, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    rows, date_col = _aligned(returns, benchmark, ret, benchmark_ret, by, date_col)
    over = _rolling(by, date_col, window)
    value = ratio(F.covar_samp(R, B).over(over), F.var_samp(B).over(over))
    return rows.select(date_col, *_keys(by), full_window(value, F.col("_a"), window, over).alias("rolling_beta"))


def rolling_tracking_error(returns: DataFrame, benchmark: DataFrame, window: int, *, periods_per_year: float | None = None, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    rows, date_col = _aligned(returns, benchmark, ret, benchmark_ret, by, date_col)
    over, x = _rolling(by, date_col, window), F.col("_a")
    value = F.stddev_samp(x).over(over) * F.sqrt(PPY)
    return with_periods(rows, periods_per_year, date_col=date_col).select(date_col, *_keys(by), full_window(value, x, window, over).alias("rolling_tracking_error"))


def rolling_information_ratio(returns: DataFrame, benchmark: DataFrame, window: int, *, periods_per_year: float | None = None, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    rows, date_col = _aligned(returns, benchmark, ret, benchmark_ret, by, date_col)
    over, x = _rolling(by, date_col, window), F.col("_a")
    value = ratio(F.avg(x).over(over), F.stddev_samp(x).over(over)) * F.sqrt(PPY)
    return with_periods(rows, periods_per_year, date_col=date_col).select(date_col, *_keys(by), full_window(value, x, window, over).alias("rolling_information_ratio"))


# ---- summary -----------------------------------------------------------------------------------------------------------


def _absolute(risk_free: float, level: float) -> list[Column]:
    """Every absolute metric of rows with _r, _ppy, _dd (drawdown) and _var."""
    x = F.col(R)
    return [
        _total(x).alias("total_return"), _cagr(x).alias("annualized_return"), _volatility(x).alias("annualized_volatility"), _sharpe(x, risk_free).alias("sharpe_ratio"), _sortino(x, risk_free).alias("sortino_ratio"),
        ratio(_cagr(x), F.abs(F.min("_dd"))).alias("calmar_ratio"), F.min("_dd").alias("max_drawdown"), F.max("_var").alias(f"var_{level:g}"), F.avg(F.when(x <= F.col("_var"), x)).alias(f"cvar_{level:g}"),
        _hits(x).alias("hit_rate"), _win_loss(x).alias("win_loss_ratio"), adjusted_skew(x).alias("skew"), adjusted_kurtosis(x).alias("kurtosis"), F.count(x).cast("double").alias("n_periods"), _ppy().alias("periods_per_year"),
    ]


def _relative_all(risk_free: float) -> list[Column]:
    """Every relative metric of rows with _r, _b, _ppy and _on, which marks the dates that the benchmark has."""
    r, b = F.when(F.col("_on"), F.col(R)), F.col(B)
    a = r - b
    return [_cagr(a).alias("active_return"), _volatility(a).alias("tracking_error"), _information(a).alias("information_ratio"), _beta(r, b).alias("beta"), _alpha(r, b, risk_free).alias("alpha"), _capture(r, b, "up").alias("up_capture"), _capture(r, b, "down").alias("down_capture")]


# The metrics' names, in order.
ABSOLUTE = ("total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "var", "cvar", "hit_rate", "win_loss_ratio", "skew", "kurtosis", "n_periods", "periods_per_year")
RELATIVE = ("active_return", "tracking_error", "information_ratio", "beta", "alpha", "up_capture", "down_capture")


def performance_summary(returns: DataFrame, benchmark: DataFrame | None = None, *, risk_free: float = 0.0, periods_per_year: float | None = None, var_level: float = 0.05, ret: str = "ret", benchmark_ret: str = "ret", by: str | None = None, date_col: str | None = None) -> DataFrame:
    """([by,] metric, value): fifteen absolute metrics, and seven relative ones with a benchmark."""
    rows, date_col = _series(returns, ret, by, date_col)
    running, whole = _running(by, date_col), Window.partitionBy(*(_keys(by) or [F.lit(0)]))
    rows = with_periods(rows, periods_per_year, date_col=date_col).withColumns({"_w": F.product(1 + F.coalesce(R, F.lit(0.0))).over(running), "_var": F.percentile(R, F.lit(var_level)).over(whole)})
    rows, metrics = rows.withColumn("_dd", ratio(F.col("_w"), F.max("_w").over(running)) - 1), _absolute(risk_free, var_level)
    names = [f"{n}_{var_level:g}" if n in ("var", "cvar") else n for n in ABSOLUTE]
    if benchmark is not None:
        other = benchmark.select(F.to_date(date_col).alias(date_col), clean(F.col(benchmark_ret)).alias(B), F.lit(True).alias("_on"))
        rows, metrics, names = rows.join(other, date_col, "left"), [*metrics, *_relative_all(risk_free)], [*names, *RELATIVE]
    table = rows.groupBy(*_keys(by)).agg(*metrics)  # one pass over a series that is derived once
    quoted = table.select(*_keys(by), *(F.col(f"`{n}`").cast("double").alias(n) for n in names))
    return quoted.select(*_keys(by), F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names))))
