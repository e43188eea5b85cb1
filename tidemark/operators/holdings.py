"""Holdings: concentration, allocation, contribution, turnover. A weight that is missing on a date is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import one_of, require_columns, resolve_columns
from tidemark.functions.exprs import clean, ratio, sum0, weighted_mean
from tidemark.sources.panel import check_duplicates, date_grid


def _weights(data: DataFrame, weight: str, date_col: str, id_col: str) -> DataFrame:
    """(date, id, _w) with missing weights as 0."""
    require_columns(data, [date_col, id_col, weight], "holdings")
    return data.select(F.to_date(date_col).alias(date_col), F.col(id_col).alias("_id"), F.coalesce(clean(F.col(weight)), F.lit(0.0)).alias("_w"))


def concentration(data: DataFrame, *, weight: str = "weight", top: Sequence[int] = (10, 20), date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, n_holdings, hhi, effective_n, topK_share ...): topK_share sums the K largest weights over all ids of the panel.

    Ids not held on a date count as weights of 0 there, above shorts: as many zeros as the panel has further ids.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    rows = _weights(data, weight, date_col, id_col)
    ids = rows.agg(F.count_distinct("_id").alias("_all"))
    at = Window.partitionBy(date_col).orderBy(F.col("_w").desc(), F.col("_id"))
    ranked = rows.withColumns({"_at": F.row_number().over(at), "_here": F.count(F.lit(1)).over(Window.partitionBy(date_col))}).crossJoin(F.broadcast(ids))  # one row
    place = F.when(F.col("_w") < 0, F.col("_at") + F.col("_all") - F.col("_here")).otherwise(F.col("_at"))
    tops = [sum0(F.when(place <= k, F.col("_w"))).alias(f"top{k}_share") for k in top]
    hhi = F.sum(F.col("_w") * F.col("_w"))
    return ranked.groupBy(date_col).agg(F.count_if(F.col("_w") != 0).alias("n_holdings"), hhi.alias("hhi"), ratio(F.lit(1.0), hhi).alias("effective_n"), *tops)


def allocation(data: DataFrame, *, by: str, weight: str = "weight", benchmark_weight: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, by, allocation): summed weights, less the benchmark's if given; rows without a segment don't count."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, by, weight, benchmark_weight], "allocation")
    total = sum0(clean(F.col(weight)))
    if benchmark_weight:
        total = total - sum0(clean(F.col(benchmark_weight)))
    return data.where(F.col(by).isNotNull()).groupBy(date_col, by).agg(total.alias("allocation"))


def top_holdings(data: DataFrame, *, weight: str = "weight", n: int = 10, at: str | None = None, benchmark_weight: str | None = None, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """The rows of one date (the last by default) with the n largest and n smallest weights, or active weights, largest first.

    Adds ``active_weight`` with a benchmark. Ties go by id; missing weights come last. All rows if there are at most 2n.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, id_col, weight, benchmark_weight], "top_holdings")
    day = F.to_date(date_col)
    rows = data.withColumn("_d", day)
    if at is not None:
        rows = rows.where(F.col("_d") == F.to_date(F.lit(at)))
    else:
        rows = rows.crossJoin(F.broadcast(data.agg(F.max(day).alias("_last")))).where("_d = _last").drop("_last")  # one row
    key = clean(F.col(weight))
    if benchmark_weight:
        key = F.coalesce(key, F.lit(0.0)) - F.coalesce(clean(F.col(benchmark_weight)), F.lit(0.0))
        rows = rows.withColumn("active_weight", key)
    down = [key.desc_nulls_last(), F.col(id_col)]
    one = Window.partitionBy("_d")
    top = rows.withColumns({"_top": F.row_number().over(one.orderBy(*down)), "_n": F.count(F.lit(1)).over(one)})
    return top.where((F.col("_top") <= n) | (F.col("_top") > F.col("_n") - n)).orderBy("_top").drop("_d", "_top", "_n")


def characteristics(data: DataFrame, *, columns: Sequence[str], weight: str = "weight", benchmark_weight: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, columns...): weighted means over rows that have the attribute, less the benchmark's if given."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, *columns, weight, benchmark_weight], "characteristics")
    mean = lambda c, w: weighted_mean(clean(F.col(c)), clean(F.col(w)))
    return data.groupBy(date_col).agg(*((mean(c, weight) - mean(c, benchmark_weight) if benchmark_weight else mean(c, weight)).alias(c) for c in columns))


def contribution(data: DataFrame, *, forward_return: str, weight: str = "weight", by: str | None = None, check: bool = True, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, id or by, contribution): weight times return, summed over the segment if ``by`` is given.

    Per id, rows that lack either stay NULL, and shared keys raise (a job; ``check=False`` leaves it out).
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, id_col, forward_return, weight, by], "contribution")
    part = clean(F.col(weight)) * clean(F.col(forward_return))
    if by is not None:
        return data.where(F.col(by).isNotNull()).groupBy(date_col, by).agg(sum0(part).alias("contribution"))
    if check:
        check_duplicates(data, [date_col, id_col])
    return data.select(date_col, id_col, part.alias("contribution"))


def top_contributors(data: DataFrame, *, forward_return: str, weight: str = "weight", n: int = 10, by: str | None = None, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(item, contribution, n_periods, side) summed over time: the n best and n worst; all, by sign, if at most 2n."""
    date_col, id_col = resolve_columns(date_col, id_col)
    item = by or id_col
    parts = contribution(data, forward_return=forward_return, weight=weight, by=by, check=False, date_col=date_col, id_col=id_col)
    totals = parts.groupBy(item).agg(F.sum("contribution").alias("contribution"), F.count("contribution").alias("n_periods")).where("contribution is not null")
    items = totals.agg(F.count(F.lit(1)).alias("_n"))
    best = totals.orderBy(F.col("contribution").desc(), item).limit(n).withColumn("side", F.lit("top"))
    worst = totals.orderBy(F.col("contribution").asc(), F.col(item).desc()).limit(n).withColumn("side", F.lit("bottom"))
    ends = best.unionAll(worst).crossJoin(F.broadcast(items))  # one row
    few = F.when(F.col("contribution") >= 0, "top").otherwise("bottom")
    sided = ends.withColumn("side", F.when(F.col("_n") <= 2 * n, few).otherwise(F.col("side"))).drop("_n")
    return sided.dropDuplicates([item]).orderBy(F.col("contribution").desc(), item)


def _steps(data: DataFrame, weight: str, date_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(t, before, after) of every id held on a date or the one before, and the grid."""
    rows = _weights(data, weight, date_col, id_col)
    grid = date_grid(rows, date_col=date_col)
    held = rows.join(grid, date_col).where("_w <> 0").select("_id", "t", "_w")
    last = grid.agg(F.max("t").alias("_t"))
    earlier = held.select("_id", (F.col("t") + 1).alias("t"), F.col("_w").alias("before")).join(F.broadcast(last), F.col("t") <= F.col("_t")).drop("_t")  # one row
    both = held.withColumnRenamed("_w", "after").join(earlier, ["_id", "t"], "full")
    return both.select("t", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after")), grid


def _after_first(grid: DataFrame, sums: DataFrame, date_col: str, names: Sequence[str]) -> DataFrame:
    """The sums on their dates; 0 where nothing moved, NULL on the first date."""
    filled = [F.when(F.col("t") > 1, F.coalesce(n, F.lit(0).cast(sums.schema[n].dataType))).alias(n) for n in names]
    return grid.join(sums, "t", "left").select(date_col, *filled)


def turnover(data: DataFrame, *, weight: str = "weight", method: str = "one_way", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, turnover): summed absolute weight changes since the panel's date before, halved for ``one_way``."""
    one_of("method", method, ("one_way", "two_way"))
    date_col, id_col = resolve_columns(date_col, id_col)
    steps, grid = _steps(data, weight, date_col, id_col)
    moved = F.sum(F.abs(F.col("after") - F.col("before")))
    return _after_first(grid, steps.groupBy("t").agg((moved / 2 if method == "one_way" else moved).alias("turnover")), date_col, ["turnover"])


def trades(data: DataFrame, *, weight: str = "weight", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, n_new, n_closed, weight_bought, weight_sold) since the panel's date before."""
    date_col, id_col = resolve_columns(date_col, id_col)
    steps, grid = _steps(data, weight, date_col, id_col)
    change: Column = F.col("after") - F.col("before")
    sums = steps.groupBy("t").agg(F.count_if(F.expr("before = 0 and after <> 0")).alias("n_new"), F.count_if(F.expr("before <> 0 and after = 0")).alias("n_closed"), F.sum(F.greatest(change, F.lit(0.0))).alias("weight_bought"), F.sum(F.greatest(-change, F.lit(0.0))).alias("weight_sold"))
    return _after_first(grid, sums, date_col, ["n_new", "n_closed", "weight_bought", "weight_sold"])


def average_holding_period(data: DataFrame, *, weight: str = "weight", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(id, avg_holding_period): dates held over the number of spells; ids never held are left out."""
    date_col, id_col = resolve_columns(date_col, id_col)
    rows = _weights(data, weight, date_col, id_col)
    held = rows.where("_w <> 0").join(date_grid(rows, date_col=date_col), date_col).select("_id", "t").distinct()
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("_id").orderBy("t"))
    spells = held.withColumn("_new", F.when(gap == 1, 0).otherwise(1))
    return spells.groupBy(F.col("_id").alias(id_col)).agg(ratio(F.count(F.lit(1)), F.sum("_new")).alias("avg_holding_period"))


def holding_spells(data: DataFrame, *, weight: str = "weight", date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(id, start, end, periods, open_start, open_end) of each run of the panel's dates on which an id is held.

    ``open_start`` and ``open_end`` tell whether a spell touches the panel's first or last date, so that it may be longer.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    rows = _weights(data, weight, date_col, id_col)
    grid = date_grid(rows, date_col=date_col)
    held = rows.where("_w <> 0").join(grid, date_col).select("_id", "t", date_col).distinct()
    run = F.col("t") - F.row_number().over(Window.partitionBy("_id").orderBy("t"))
    spells = held.withColumn("_run", run).groupBy("_id", "_run").agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.min(date_col).alias("start"), F.max(date_col).alias("end"), F.count(F.lit(1)).alias("periods"))
    every = spells.crossJoin(F.broadcast(grid.agg(F.max("t").alias("_t"))))  # one row
    return every.select(F.col("_id").alias(id_col), "start", "end", "periods", (F.col("_first") == 1).alias("open_start"), (F.col("_last") == F.col("_t")).alias("open_end"))


def holding_period_distribution(data: DataFrame, *, weight: str = "weight", entered: bool = False, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(periods, at_risk, closed, censored, survival): how long positions are held, by the product-limit estimate.

    ``at_risk`` spells last ``periods`` or longer, ``closed`` end then, ``censored`` are still open then at the panel's end;
    ``survival`` is the estimated share of positions held longer. With ``entered`` only spells that begin after the
    first date count; else those open on it count from there. There is a row for each length that occurs.
    """
    spells = holding_spells(data, weight=weight, date_col=date_col, id_col=id_col)
    if entered:
        spells = spells.where(~F.col("open_start"))
    lengths = spells.groupBy("periods").agg(F.count_if(~F.col("open_end")).alias("closed"), F.count_if("open_end").alias("censored"))
    # as many rows as the panel has dates, at most
    up, down = Window.partitionBy(F.lit(0)).orderBy("periods"), Window.partitionBy(F.lit(0)).orderBy(F.col("periods").desc())
    sized = lengths.withColumn("at_risk", F.sum(F.col("closed") + F.col("censored")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    survival = F.product(1 - ratio(F.col("closed"), F.col("at_risk"))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("periods", "at_risk", "closed", "censored", survival.alias("survival"))
