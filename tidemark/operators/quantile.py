"""Quantile portfolios, double sorts, information coefficients and signal persistence.

Quantiles are integers from 1 (smallest values) in long tables; 0 is the class of missing values. :func:`label` and
:func:`quantile_labels` name them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ValidationError, one_of, require_columns, resolve_columns
from tidemark.functions.exprs import average_rank, clean, newey_west, pair_correlation, ratio, t_stat, weighted_mean
from tidemark.operators import performance as perf
from tidemark.operators.signals import CORRELATIONS
from tidemark.sources.panel import date_grid, with_periods

MISSING_LABEL = "NA"


def label(q: Column, missing_label: str = MISSING_LABEL) -> Column:
    """``Qn``, or the missing label for 0."""
    return F.when(q == 0, missing_label).when(q.isNotNull(), F.concat(F.lit("Q"), q.cast("string")))


def quantile_labels(n: int, *, include_missing: bool = False, missing_label: str = MISSING_LABEL) -> list[str]:
    if n < 1:
        raise ValidationError(f"n must be at least 1, not {n}")
    return [f"Q{i}" for i in range(1, n + 1)] + [missing_label] * include_missing


def _quantile(x: Column, keys: Sequence[str], id_col: str, n: int, ascending: bool, min_assets: int | None, missing_class: bool) -> Column:
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    cell = Window.partitionBy(*keys)
    count = F.count(x).over(cell)
    at = F.row_number().over(cell.orderBy(order, F.col(id_col)))
    bucket = F.least(F.greatest(F.ceil(F.try_divide(at, count) * n), F.lit(1)), F.lit(n)).cast("int")
    enough = count >= (n if min_assets is None else min_assets)
    return F.when(x.isNotNull() & enough, bucket).when(enough & F.lit(missing_class), F.lit(0))


def assign_quantiles(data: DataFrame, *, factor: str, n_quantiles: int = 5, group: str | None = None, ascending: bool = True, min_assets: int | None = None, missing_class: bool = False, output: str = "quantile", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """``data`` with its quantile within the date (and group); ties go by id.

    NULL without a value and in cells with under ``min_assets`` (``n_quantiles``) values; with ``missing_class`` rows
    without a value get 0 in cells with enough.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, id_col, factor, group], "assign_quantiles")
    if n_quantiles < 2:
        raise ValidationError(f"n_quantiles must be at least 2, not {n_quantiles}")
    keys = [date_col, *([group] if group else [])]
    return data.withColumn(output, _quantile(clean(F.col(factor)), keys, id_col, n_quantiles, ascending, min_assets, missing_class))


def _mean(r: Column, w: Column | None) -> Column:
    return F.avg(r) if w is None else weighted_mean(r, w)


def _complete(rows: DataFrame, forward_return: str, weight: str | None) -> tuple[DataFrame, Column, Column | None]:
    """``rows`` without those that lack the return or the weight, and both columns."""
    r, w = clean(F.col(forward_return)), clean(F.col(weight)) if weight else None
    return rows.where(r.isNotNull() if w is None else r.isNotNull() & w.isNotNull()), r, w


def quantile_returns(data: DataFrame, *, factor: str, forward_return: str, n_quantiles: int = 5, group: str | None = None, weight: str | None = None, ascending: bool = True, min_assets: int | None = None, include_missing: bool = False, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, quantile, ret): mean, or weighted mean, forward return of each quantile."""
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [forward_return, weight], "quantile_returns")
    marked = assign_quantiles(data, factor=factor, n_quantiles=n_quantiles, group=group, ascending=ascending, min_assets=min_assets, missing_class=include_missing, output="_q", date_col=date_col, id_col=id_col)
    rows, r, w = _complete(marked.where(F.col("_q").isNotNull()), forward_return, weight)
    return rows.groupBy(date_col, F.col("_q").alias("quantile")).agg(_mean(r, w).alias("ret"))


def widen(returns: DataFrame, n_quantiles: int, *, include_missing: bool = False, missing_label: str = MISSING_LABEL, date_col: str | None = None) -> DataFrame:
    """(date, Q1 .. Qn[, NA]) of :func:`quantile_returns`; every label has a column."""
    date_col, _ = resolve_columns(date_col)
    codes = [*range(1, n_quantiles + 1), *([0] if include_missing else [])]
    names = quantile_labels(n_quantiles, include_missing=include_missing, missing_label=missing_label)
    return returns.groupBy(date_col).pivot("quantile", codes).agg(F.first("ret")).select(date_col, *(F.col(f"`{c}`").alias(n) for c, n in zip(codes, names, strict=True)))


def class_returns(data: DataFrame, *, classes: str, forward_return: str, weight: str | None = None, include_missing: bool = False, missing_label: str = MISSING_LABEL, class_order: Sequence[str] | None = None, date_col: str | None = None) -> DataFrame:
    """(date, class, ret) of an existing label; ``class_order`` also filters.

    A class named like ``missing_label`` counts as missing.
    """
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, classes, forward_return, weight], "class_returns")
    rows, r, w = _complete(data.withColumn("class", F.coalesce(F.col(classes).cast("string"), F.lit(missing_label))), forward_return, weight)
    if class_order is not None:
        rows = rows.where(F.col("class").isin(list(class_order)))
    elif not include_missing:
        rows = rows.where(F.col("class") != missing_label)
    return rows.groupBy(date_col, "class").agg(_mean(r, w).alias("ret"))


def _double_sort(data: DataFrame, factor_1: str, factor_2: str, n1: int, n2: int, group: str | None, ascending_1: bool, ascending_2: bool, min_assets: int | None, date_col: str, id_col: str) -> DataFrame:
    common = {"group": group, "min_assets": min_assets, "date_col": date_col, "id_col": id_col}
    one = assign_quantiles(data, factor=factor_1, n_quantiles=n1, ascending=ascending_1, output="q1", **common)
    two = assign_quantiles(one, factor=factor_2, n_quantiles=n2, ascending=ascending_2, output="q2", **common)
    return two.where(F.col("q1").isNotNull() & F.col("q2").isNotNull())


def double_sort_returns(data: DataFrame, *, factor_1: str, factor_2: str, forward_return: str, n_quantiles_1: int = 5, n_quantiles_2: int = 5, weight: str | None = None, group: str | None = None, ascending_1: bool = True, ascending_2: bool = True, min_assets: int | None = None, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, q1, q2, ret) of two independent sorts."""
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, factor_1, factor_2, forward_return, weight], "double_sort")
    marked = _double_sort(data, factor_1, factor_2, n_quantiles_1, n_quantiles_2, group, ascending_1, ascending_2, min_assets, date_col, id_col)
    rows, r, w = _complete(marked, forward_return, weight)
    return rows.groupBy(date_col, "q1", "q2").agg(_mean(r, w).alias("ret"))


#: What a cell's returns over time can be summed up to; each takes the return, with _ppy beside it.
CELL_STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "annualized_return": perf._cagr,
    "sharpe_ratio": perf._sharpe,
    "t_stat": t_stat,
    "hit_rate": perf._hits,
    "n_periods": lambda r: F.count(r).cast("double"),
}


def double_sort_summary(cells: DataFrame, *, statistic: str = "annualized_return", periods_per_year: float | None = None, date_col: str | None = None) -> DataFrame:
    """(q1, q2, statistic) over time; the frequency is that of each cell's own dates, NULL under two of them."""
    one_of("statistic", statistic, CELL_STATISTICS)
    date_col, _ = resolve_columns(date_col)
    require_columns(cells, [date_col, "q1", "q2", "ret"], "double_sort_summary")
    rows = cells.withColumn("_r", clean(F.col("ret"))).where(F.col("_r").isNotNull()).withColumn("_cell", F.struct("q1", "q2"))
    rows = with_periods(rows, periods_per_year, by="_cell", strict=False, date_col=date_col, needed=statistic in ("annualized_return", "sharpe_ratio"))
    return rows.groupBy("q1", "q2").agg(CELL_STATISTICS[statistic](F.col("_r")).alias(statistic))


def double_sort_counts(data: DataFrame, *, factor_1: str, factor_2: str, n_quantiles_1: int = 5, n_quantiles_2: int = 5, group: str | None = None, ascending_1: bool = True, ascending_2: bool = True, min_assets: int | None = None, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(q1, q2, mean_count) over the dates on which the cell holds anything."""
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, factor_1, factor_2], "double_sort")
    marked = _double_sort(data, factor_1, factor_2, n_quantiles_1, n_quantiles_2, group, ascending_1, ascending_2, min_assets, date_col, id_col)
    return marked.groupBy(date_col, "q1", "q2").count().groupBy("q1", "q2").agg(F.avg("count").alias("mean_count"))


def quantile_summary(returns: DataFrame, *, periods_per_year: float | None = None, by: str = "quantile", date_col: str | None = None) -> DataFrame:
    """One row a label: mean, std, annualized_return, annualized_volatility, sharpe_ratio, max_drawdown, hit_rate, t_stat, t_stat_nw, n_periods; one frequency for all labels."""
    date_col, _ = resolve_columns(date_col)
    require_columns(returns, [date_col, by, "ret"], "quantile_summary")
    rows = with_periods(returns.select(date_col, by, clean(F.col("ret")).alias("_r")), periods_per_year, date_col=date_col)
    x = F.col("_r")
    flat = rows.groupBy(by).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), perf._cagr(x).alias("annualized_return"), perf._volatility(x).alias("annualized_volatility"), perf._sharpe(x).alias("sharpe_ratio"),
        perf._hits(x).alias("hit_rate"), t_stat(x).alias("t_stat"), newey_west(x, F.col(date_col)).alias("t_stat_nw"), F.count(x).alias("n_periods"),
    )
    out = perf._beside(flat, perf.max_drawdown(rows, ret="_r", by=by, date_col=date_col), by)
    return out.select(by, "mean", "std", "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "hit_rate", "t_stat", "t_stat_nw", "n_periods")


def quantile_errors(returns: DataFrame, *, lags: int | None = None, by: str = "quantile", date_col: str | None = None) -> DataFrame:
    """(label, mean, std_error, std_error_nw, n_periods): standard errors of each label's mean return, plain and with
    Bartlett-weighted autocovariances. NULL under two returns; the second also where its variance is not positive."""
    date_col, _ = resolve_columns(date_col)
    require_columns(returns, [date_col, by, "ret"], "quantile_errors")
    rows = returns.select(date_col, by, clean(F.col("ret")).alias("_r"))
    x = F.col("_r")
    at = lambda mu: newey_west(x, F.col(date_col), lags, mu)
    # t-statistics against 0 and 1 differ by one over the error
    return rows.groupBy(by).agg(F.avg(x).alias("mean"), ratio(F.stddev_samp(x), F.sqrt(F.count(x).cast("double"))).alias("std_error"), ratio(F.lit(1.0), at(0.0) - at(1.0)).alias("std_error_nw"), F.count(x).alias("n_periods"))


def long_short_returns(returns: DataFrame, *, long: int | None = None, short: int | None = None, by: str = "quantile", date_col: str | None = None) -> DataFrame:
    """(date, ret): the long label's return less the short one's, the highest less the lowest present by default."""
    date_col, _ = resolve_columns(date_col)
    require_columns(returns, [date_col, by, "ret"], "long_short_returns")
    named = returns.where(F.col(by) != 0)
    if long is None or short is None:
        ends = named.agg(F.max(by).alias("_top"), F.min(by).alias("_bottom"))
        named = named.crossJoin(F.broadcast(ends))  # one row
    top, bottom = F.col("_top") if long is None else F.lit(long), F.col("_bottom") if short is None else F.lit(short)
    pick = lambda q: F.max(F.when(F.col(by) == q, F.col("ret")))
    return named.groupBy(date_col).agg((pick(top) - pick(bottom)).alias("ret"))


def _ic(rows: DataFrame, x: str, y: str, method: str, keys: list[str], min_assets: int) -> DataFrame:
    a, b = F.col(x), F.col(y)
    if method == "spearman":
        rows = rows.withColumns({"_rx": average_rank(a, keys), "_ry": average_rank(b, keys)})
        a, b = F.col("_rx"), F.col("_ry")
    n = F.count_if(a.isNotNull() & b.isNotNull())
    return rows.groupBy(*keys).agg(F.when(n >= min_assets, pair_correlation(a, b)).alias("ic"))


def information_coefficient(data: DataFrame, *, factor: str, forward_return: str, method: str = "spearman", group: str | None = None, min_assets: int = 5, date_col: str | None = None) -> DataFrame:
    """(date, [group,] ic): correlation of signal and forward return over each cross-section.

    Without ``group`` each column is ranked over its own values before incomplete rows go; with it they go first.
    """
    one_of("method", method, CORRELATIONS)
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, factor, forward_return, group], "information_coefficient")
    keys = [date_col, *([group] if group else [])]
    rows = data.select(*keys, clean(F.col(factor)).alias("_x"), clean(F.col(forward_return)).alias("_y"))
    if group:
        rows = rows.dropna(subset=["_x", "_y", group])
    return _ic(rows, "_x", "_y", method, keys, min_assets)


def ic_summary(ic: DataFrame, *, periods_per_year: float | None = None, by: str | None = None, value: str = "ic", date_col: str | None = None) -> DataFrame:
    """([by,] mean, std, icir, icir_annualized, t_stat, t_stat_nw, hit_rate, n_periods); no row under two values."""
    date_col, _ = resolve_columns(date_col)
    require_columns(ic, [date_col, value, by], "ic_summary")
    rows = ic.select(date_col, *([by] if by else []), clean(F.col(value)).alias("_r")).where(F.col("_r").isNotNull())
    rows, x = with_periods(rows, periods_per_year, date_col=date_col, strict=False), F.col("_r")
    icir = ratio(F.avg(x), F.stddev_samp(x))
    out = rows.groupBy(*([by] if by else [])).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), icir.alias("icir"), (icir * F.sqrt(F.max("_ppy"))).alias("icir_annualized"), t_stat(x).alias("t_stat"), newey_west(x, F.col(date_col)).alias("t_stat_nw"), perf._hits(x).alias("hit_rate"), F.count(x).alias("n_periods"))
    return out.where("n_periods >= 2")


def factor_decay(data: DataFrame, *, factor: str, forward_returns: Sequence[str], method: str = "spearman", min_assets: int = 5, periods_per_year: float | None = None, date_col: str | None = None) -> DataFrame:
    """(horizon, ...): :func:`ic_summary` of each forward-return column, in one pass over the panel."""
    one_of("method", method, CORRELATIONS)
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, factor, *forward_returns], "factor_decay")
    x = clean(F.col(factor)).alias("_x")
    stacked = data.select(date_col, x, F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), clean(F.col(h)).alias("_y")) for h in forward_returns))).alias("_h")).select(date_col, "_x", "_h.horizon", "_h._y")
    return ic_summary(_ic(stacked, "_x", "_y", method, [date_col, "horizon"], min_assets), periods_per_year=periods_per_year, by="horizon", date_col=date_col)


def factor_autocorrelation(data: DataFrame, *, factor: str, lags: Sequence[int] = (1, 2, 3, 6, 12), method: str = "spearman", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(lag, autocorrelation): mean over dates of the correlation with the signal ``lag`` dates of the panel before."""
    one_of("method", method, CORRELATIONS)
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, id_col, factor], "factor_autocorrelation")
    days = data.select(F.to_date(date_col).alias(date_col), F.col(id_col).alias("_id"), clean(F.col(factor)).alias("_x"))
    ranked = days.withColumn("_x", average_rank(F.col("_x"), [date_col])) if method == "spearman" else days
    rows = ranked.where(F.col("_x").isNotNull()).join(date_grid(days, date_col=date_col), date_col).select("_id", "t", "_x")
    later = rows.select("_id", F.col("t").alias("_t"), F.col("_x").alias("_y"), F.explode(F.array(*(F.lit(k) for k in lags))).alias("lag")).withColumn("t", F.col("_t") - F.col("lag"))
    daily = later.join(rows, ["_id", "t"]).groupBy("lag", "_t").agg(pair_correlation(F.col("_y"), F.col("_x")).alias("c"))
    every = data.sparkSession.createDataFrame([(int(k),) for k in lags], "lag int")
    return every.join(daily.groupBy("lag").agg(F.avg("c").alias("autocorrelation")), "lag", "left")


def _members(data: DataFrame, kwargs: dict, date_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, t, q) of rows with a quantile, and the grid."""
    grid = date_grid(data, date_col=date_col)
    marked = assign_quantiles(data.withColumn(date_col, F.to_date(date_col)), output="_q", date_col=date_col, id_col=id_col, **kwargs)
    return marked.where(F.col("_q").isNotNull()).join(grid, date_col).select(F.col(id_col).alias("_id"), "t", F.col("_q").alias("q")), grid


def quantile_turnover(data: DataFrame, *, factor: str, n_quantiles: int = 5, group: str | None = None, ascending: bool = True, min_assets: int | None = None, include_missing: bool = False, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, quantile, turnover): share of the previous date's names that are no longer in the quantile.

    Names that vanish have left. NULL on the first date and where the previous date had none.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    kwargs = {"factor": factor, "n_quantiles": n_quantiles, "group": group, "ascending": ascending, "min_assets": min_assets, "missing_class": include_missing}
    rows, grid = _members(data, kwargs, date_col, id_col)
    before = rows.select("_id", (F.col("t") + 1).alias("t"), "q")
    stayed = before.join(rows.withColumn("_in", F.lit(1)), ["_id", "t", "q"], "left")
    shares = stayed.groupBy("t", "q").agg(ratio(F.count(F.lit(1)) - F.count("_in"), F.count(F.lit(1))).alias("turnover"))
    codes = [*range(1, n_quantiles + 1), *([0] if include_missing else [])]
    cells = grid.select(date_col, "t", F.explode(F.array(*(F.lit(c) for c in codes))).alias("q"))  # dates times labels
    return cells.join(shares, ["t", "q"], "left").select(date_col, F.col("q").alias("quantile"), "turnover")


def quantile_transition_matrix(data: DataFrame, *, factor: str, n_quantiles: int = 5, group: str | None = None, ascending: bool = True, min_assets: int | None = None, include_missing: bool = False, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(from_quantile, to_quantile, probability) pooled over names and dates; pairs with a side missing don't count.

    Labels never seen on a side have NULL; combinations never seen of labels that are have 0. Raises when read if no pair exists.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    kwargs = {"factor": factor, "n_quantiles": n_quantiles, "group": group, "ascending": ascending, "min_assets": min_assets, "missing_class": include_missing}
    rows, _ = _members(data, kwargs, date_col, id_col)
    pairs = rows.select("_id", (F.col("t") + 1).alias("t"), F.col("q").alias("from_quantile")).join(rows.withColumnRenamed("q", "to_quantile"), ["_id", "t"])
    counts = pairs.groupBy("from_quantile", "to_quantile").count()
    codes = F.array(*(F.lit(c) for c in [*range(1, n_quantiles + 1), *([0] if include_missing else [])]))
    one = data.sparkSession.range(1)
    cells = one.select(F.explode(codes).alias("from_quantile")).withColumn("to_quantile", F.explode(codes))
    full = cells.join(counts, ["from_quantile", "to_quantile"], "left")
    row, column, every = Window.partitionBy("from_quantile"), Window.partitionBy("to_quantile"), Window.partitionBy(F.lit(0))
    seen = F.sum("count").over(row).isNotNull() & F.sum("count").over(column).isNotNull()
    none = F.raise_error(F.lit("no transition to count: at least two dates with quantiles are needed")).cast("double")
    share = F.when(F.sum("count").over(every).isNull(), none).when(seen, ratio(F.coalesce("count", F.lit(0)), F.sum("count").over(row)))
    return full.select("from_quantile", "to_quantile", share.alias("probability"))
