"""Brinson attribution by segment, and its linking over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ValidationError, one_of, require_columns, resolve_columns
from tidemark.functions.exprs import clean, ratio, sum0

MODELS = ("bf", "bhb")
LINKING = ("carino", "grap", "frongello", "menchero", "simple")
#: Between the names of a path of segments.
STEP = " > "
#: Returns nearer than this count as equal in a log ratio.
TOLERANCE = 1e-12


def aggregate_segments(data: DataFrame, *, segment: str, portfolio_weight: str = "weight", benchmark_weight: str = "bench_weight", asset_return: str | None = None, portfolio_return: str | None = None, benchmark_return: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, segment, wp, wb, rp, rb), from assets' returns or from returns already given by segment.

    An asset without a return adds nothing to its segment's return but keeps its weight in it; a segment without weight
    has a return of 0. Rows without a segment don't count.
    """
    date_col, _ = resolve_columns(date_col)
    given = portfolio_return is not None or benchmark_return is not None
    if (asset_return is not None) == given or (given and (portfolio_return is None or benchmark_return is None)):
        raise ValidationError("give either asset_return, or both portfolio_return and benchmark_return")
    require_columns(data, [date_col, segment, portfolio_weight, benchmark_weight, asset_return, portfolio_return, benchmark_return], "aggregate_segments")
    wp, wb = clean(F.col(portfolio_weight)), clean(F.col(benchmark_weight))
    if given:
        rp, rb = F.first(clean(F.col(portfolio_return)), True), F.first(clean(F.col(benchmark_return)), True)
    else:
        r = clean(F.col(asset_return))
        rp, rb = F.coalesce(ratio(sum0(wp * r), F.sum(wp)), F.lit(0.0)), F.coalesce(ratio(sum0(wb * r), F.sum(wb)), F.lit(0.0))
    return data.where(F.col(segment).isNotNull()).groupBy(date_col, F.col(segment).alias("segment")).agg(sum0(wp).alias("wp"), sum0(wb).alias("wb"), rp.alias("rp"), rb.alias("rb"))


def effects_from_segments(segments: DataFrame, *, model: str = "bf", terms: int = 3, date_col: str | None = None) -> DataFrame:
    """(date, segment, allocation, selection[, interaction]); with two terms the interaction is part of selection.

    "bf" takes allocation against the benchmark's total return, "bhb" against nothing.
    """
    one_of("model", model, MODELS)
    one_of("terms", terms, (2, 3))
    date_col, _ = resolve_columns(date_col)
    require_columns(segments, [date_col, "segment", "wp", "wb", "rp", "rb"], "effects_from_segments")
    wp, wb, rp, rb = (F.col(c) for c in ("wp", "wb", "rp", "rb"))
    base = F.coalesce(F.sum(wb * rb).over(Window.partitionBy(date_col)), F.lit(0.0)) if model == "bf" else F.lit(0.0)
    three = [(wb * (rp - rb)).alias("selection"), ((wp - wb) * (rp - rb)).alias("interaction")]
    return segments.select(date_col, "segment", ((wp - wb) * (rb - base)).alias("allocation"), *(three if terms == 3 else [(wp * (rp - rb)).alias("selection")]))


def brinson(data: DataFrame, *, model: str = "bf", terms: int = 3, date_col: str | None = None, **segments) -> DataFrame:
    """Effects by date and segment; the rest as in :func:`aggregate_segments`."""
    return effects_from_segments(aggregate_segments(data, date_col=date_col, **segments), model=model, terms=terms, date_col=date_col)


def _totals(segments: DataFrame, date_col: str) -> DataFrame:
    sums = segments.groupBy(date_col).agg(sum0(F.col("wp") * F.col("rp")).alias("portfolio"), sum0(F.col("wb") * F.col("rb")).alias("benchmark"))
    return sums.withColumn("active", F.col("portfolio") - F.col("benchmark"))


def total_returns(data: DataFrame, *, segment: str | None = None, date_col: str | None = None, **segments) -> DataFrame:
    """(date, portfolio, benchmark, active), from a table of segments or, with ``segment``, from what makes one."""
    date_col, _ = resolve_columns(date_col)
    if segment is not None:
        data = aggregate_segments(data, segment=segment, date_col=date_col, **segments)
    require_columns(data, [date_col, "wp", "wb", "rp", "rb"], "total_returns")
    return _totals(data, date_col)


def _log_ratio(p: Column, b: Column) -> Column:
    return F.when(F.abs(p - b) < TOLERANCE, ratio(F.lit(1.0), 1 + p)).otherwise(ratio(F.log1p(p) - F.log1p(b), p - b))


def _linked_dates(returns: DataFrame, date_col: str) -> DataFrame:
    """One row a date: Carino's, GRAP's and Menchero's factors, and Frongello's growths. As many rows as dates: one ordered task.

    Menchero's factor is a constant, the ratio of the geometric active return to that of equal returns in every period,
    and a correction in proportion to the date's active return, the least in squares that closes what is left.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(date_col)
    every, before, after, upto = Window.partitionBy(F.lit(0)), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    p, b = F.col("portfolio"), F.col("benchmark")
    sums = {"_tp": F.product(1 + p).over(every) - 1, "_tb": F.product(1 + b).over(every) - 1, "_n": F.count(F.lit(1)).over(every).cast("double"), "_sum": F.sum(p - b).over(every), "_squares": F.sum((p - b) * (p - b)).over(every)}
    rows = returns.withColumns(sums)
    tp, tb, n = F.col("_tp"), F.col("_tb"), F.col("_n")
    even = lambda r: F.pow(1 + r, 1 / n)
    constant = F.when(F.abs(tp - tb) < TOLERANCE, F.pow(1 + tp, (n - 1) / n)).otherwise(ratio((tp - tb) / n, even(tp) - even(tb)))
    correction = F.coalesce(ratio(tp - tb - constant * F.col("_sum"), F.col("_squares")), F.lit(0.0)) * (p - b)
    past = F.coalesce(F.product(1 + p).over(before), F.lit(1.0))
    return rows.select(date_col, b.alias("_rb"), past.alias("_past"), (past * F.coalesce(F.product(1 + b).over(after), F.lit(1.0))).alias("grap"), F.product(1 + b).over(upto).alias("_grown"), F.coalesce(F.product(1 + b).over(before), F.lit(1.0)).alias("_grown_before"), ratio(_log_ratio(p, b), _log_ratio(tp, tb)).alias("carino"), (constant + correction).alias("menchero"))


def link(effects: DataFrame, returns: DataFrame, *, method: str = "carino", by: Sequence[str] = ("segment",), date_col: str | None = None) -> DataFrame:
    """Effects scaled so that their sum over time is the geometric (``simple``: arithmetic) active return.

    ``by`` names what effects are told apart by, beside the date; all other columns are effects. Frongello's recursion is solved in closed form with running sums; segments absent on a date have no effect there.
    """
    one_of("method", method, LINKING)
    date_col, _ = resolve_columns(date_col)
    by = list(by)
    require_columns(effects, [date_col, *by], "link")
    require_columns(returns, [date_col, "portfolio", "benchmark"], "link")
    names = [c for c in effects.columns if c not in (date_col, *by)]
    if method == "simple":
        return effects
    dates = _linked_dates(returns, date_col)
    if method != "frongello":
        joined = effects.join(dates.select(date_col, F.col(method).alias("_k")), date_col)
        return joined.select(date_col, *by, *((F.col(n) * F.col("_k")).alias(n) for n in names))
    grid = dates.crossJoin(effects.select(*by).distinct())  # dates times segments: the result's size
    full = grid.join(effects, [date_col, *by], "left").fillna(0.0, names)
    earlier = Window.partitionBy(*by).orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda n: F.coalesce(F.sum(F.col(n) * F.col("_past") / F.col("_grown")).over(earlier), F.lit(0.0))
    return full.select(date_col, *by, *((F.col(n) * F.col("_past") + F.col("_rb") * F.col("_grown_before") * carried(n)).alias(n) for n in names))


def brinson_summary(data: DataFrame, *, model: str = "bf", terms: int = 3, method: str = "carino", date_col: str | None = None, **segments) -> DataFrame:
    """(segment, effects..., total): linked effects summed over time, with a row ``Total``."""
    date_col, _ = resolve_columns(date_col)
    table = aggregate_segments(data, date_col=date_col, **segments)
    linked = link(effects_from_segments(table, model=model, terms=terms, date_col=date_col), _totals(table, date_col), method=method, date_col=date_col)
    names = [c for c in linked.columns if c not in (date_col, "segment")]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    rolled = linked.rollup("segment").agg(*(F.sum(n).alias(n) for n in names), F.grouping("segment").alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "Total").otherwise(F.col("segment").cast("string")).alias("segment"), *names, total.alias("total"))


def nested_segments(data: DataFrame, *, path: Sequence[str], portfolio_weight: str = "weight", benchmark_weight: str = "bench_weight", asset_return: str = "ret", date_col: str | None = None) -> DataFrame:
    """(date, level, segment, parent, wp, wb, rp, rb) of every segment of every level of ``path``, outermost first.

    ``segment`` is the names down to it, joined by ``STEP``; ``parent`` is that of the level above, empty at level 1.
    Weights and returns as in :func:`aggregate_segments`; rows that lack a name of the path don't count. Assets are
    summed once, to the innermost segments; the levels above come from these sums by grouping sets.
    """
    date_col, _ = resolve_columns(date_col)
    path = list(path)
    if not path or len({*path}) < len(path):
        raise ValidationError(f"path needs different columns, not {path}")
    require_columns(data, [date_col, *path, portfolio_weight, benchmark_weight, asset_return], "nested_segments")
    wp, wb, r = clean(F.col(portfolio_weight)), clean(F.col(benchmark_weight)), clean(F.col(asset_return))
    named = data.where(" and ".join(f"`{c}` is not null" for c in path))
    steps = [f"_p{i}" for i in range(len(path))]
    leaves = named.groupBy(F.col(date_col).alias("_date"), *(F.col(c).cast("string").alias(s) for c, s in zip(path, steps, strict=True))).agg(sum0(wp).alias("wp"), sum0(wb).alias("wb"), sum0(wp * r).alias("wr"), sum0(wb * r).alias("br"))
    sets = [[F.col("_date"), *(F.col(s) for s in steps[: k + 1])] for k in range(len(path))]
    rolled = leaves.groupingSets(sets, F.col("_date"), *(F.col(s) for s in steps)).agg(*(F.sum(n).alias(n) for n in ("wp", "wb", "wr", "br")), F.grouping_id("_date", *steps).alias("_set"))
    # a step left out sets its bit, the innermost the lowest
    level = F.lit(len(path)) - F.length(F.regexp_replace(F.bin("_set"), "0", ""))
    names = lambda upto: F.concat_ws(STEP, F.slice(F.array(*steps), F.lit(1), upto))
    quotient = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return rolled.withColumn("_level", level).select(F.col("_date").alias(date_col), F.col("_level").cast("int").alias("level"), names(F.col("_level")).alias("segment"), names(F.col("_level") - 1).alias("parent"), "wp", "wb", quotient("wr", "wp").alias("rp"), quotient("br", "wb").alias("rb"))


def nested_effects(segments: DataFrame, *, model: str = "bf", terms: int = 3, date_col: str | None = None) -> DataFrame:
    """(date, level, segment, allocation, selection[, interaction]) of :func:`nested_segments`' table.

    Level 1 allocates against the benchmark's total return ("bf") or nothing ("bhb"). A segment further in allocates
    within its parent: its weight less the benchmark's, scaled to the weight that the portfolio gives the parent, times its
    benchmark return less the parent's. Selection and interaction are those of the innermost segments, 0 elsewhere. All
    effects of a date add up to its active return (with "bf", if both sides' weights have the same sum).
    """
    one_of("model", model, MODELS)
    one_of("terms", terms, (2, 3))
    date_col, _ = resolve_columns(date_col)
    require_columns(segments, [date_col, "level", "segment", "parent", "wp", "wb", "rp", "rb"], "nested_effects")
    wp, wb, rp, rb = (F.col(c) for c in ("wp", "wb", "rp", "rb"))
    inside = Window.partitionBy(date_col, "level", "parent")  # a parent's own numbers are the sums of its segments
    above, below = F.sum(wp).over(inside), F.sum(wb).over(inside)
    total = F.sum(wb * rb).over(inside)
    within = F.coalesce(ratio(total, below), F.lit(0.0))
    base = total if model == "bf" else F.lit(0.0)
    scaled = F.coalesce(wb * ratio(above, below), F.lit(0.0))
    allocation = F.when(F.col("level") == 1, (wp - wb) * (rb - base)).otherwise((wp - scaled) * (rb - within))
    last = F.max("level").over(Window.partitionBy(date_col))
    own = lambda x: F.when(F.col("level") == last, x).otherwise(0.0)
    three = [own(wb * (rp - rb)).alias("selection"), own((wp - wb) * (rp - rb)).alias("interaction")]
    return segments.select(date_col, "level", "segment", allocation.alias("allocation"), *(three if terms == 3 else [own(wp * (rp - rb)).alias("selection")]))


def nested_brinson(data: DataFrame, *, path: Sequence[str], model: str = "bf", terms: int = 3, method: str = "carino", date_col: str | None = None, **segments) -> DataFrame:
    """(level, segment, effects..., total): linked effects of every level summed over time, and a row ``Total`` (level NULL).

    The rest as in :func:`nested_segments`.
    """
    date_col, _ = resolve_columns(date_col)
    table = nested_segments(data, path=path, date_col=date_col, **segments)
    effects = nested_effects(table, model=model, terms=terms, date_col=date_col)
    totals = _totals(table.where(F.col("level") == len(path)), date_col)
    linked = link(effects, totals, method=method, by=("level", "segment"), date_col=date_col)
    names = [c for c in linked.columns if c not in (date_col, "level", "segment")]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    keys = [F.col("level"), F.col("segment")]
    rolled = linked.groupingSets([keys, []], *keys).agg(*(F.sum(n).alias(n) for n in names), F.grouping("segment").alias("_all"))
    return rolled.select("level", F.when(F.col("_all") == 1, "Total").otherwise(F.col("segment")).alias("segment"), *names, total.alias("total"))
