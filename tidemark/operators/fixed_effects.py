"""Cross-sectional regressions on classes of many levels: no dense matrix, and no date's rows in one task.

Rows are summed to moments by date and combination of levels. The levels of one class are absorbed: each variable is
taken less its mean by level. What other classes explain of the rest is found by conjugate gradients, where a product
with the normal equations is a join of the moments with levels' numbers and a sum by level; all dates and all variables
go through the same jobs. Slopes of numbers then need a matrix of their own size only (Frisch, Waugh and Lovell).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ValidationError, one_of
from tidemark.functions.exprs import clean, ratio, sum0
from tidemark.functions.least_squares import solve as least_squares
from tidemark.sources.lineage import cut, dropped

#: Residuals of the normal equations are brought down to this share of what they were.
TOLERANCE = 1e-13
#: Steps grow with the square root of the classes' condition number; more mean that a design is beyond doubles.
MAX_STEPS = 1000
#: A number that classes explain up to this share of its square has no slope.
ALIASED = 1e-11


def level(column: str) -> Column:
    """A class as text that is never null: rows without a class are a level of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


@dataclass
class Fit:
    """Coefficients by date. ``slopes``: (d, ybar, b array). ``effects``: (d, c, level, e), a level's effect in class c."""

    numbers: list[str]
    classes: list[str]
    slopes: DataFrame
    effects: DataFrame
    moments: DataFrame


def _moments(data: DataFrame, y: str, numbers: Sequence[str], classes: Sequence[str], weight: str | None, date_col: str) -> DataFrame:
    """(d, k0.., n, w, v0.., v0_1..): weighted sums of y (v0), numbers (v1..) and their products by combination of levels."""
    w = clean(F.col(weight)) if weight else F.lit(1.0)
    v = [f"v{i}" for i in range(len(numbers) + 1)]
    rows = data.where(F.col(date_col).isNotNull()).select(F.col(date_col).alias("d"), w.alias("w"), *(clean(F.col(c)).alias(n) for n, c in zip(v, [y, *numbers], strict=True)), *(level(c).alias(f"k{i}") for i, c in enumerate(classes)))
    ok = F.col("w") > 0
    for n in v:
        ok = ok & F.col(n).isNotNull()
    taken = lambda x: sum0(F.when(F.col("ok"), x))
    sums = [F.count_if("ok").alias("n"), taken(F.col("w")).alias("w"), *(taken(F.col("w") * F.col(n)).alias(n) for n in v)]
    sums += [taken(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b[1:]}") for a, b in combinations_with_replacement(v, 2)]
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("d", *(f"k{i}" for i in range(len(classes)))).agg(*sums)


def _fitted(rows: DataFrame, levels: DataFrame, at: Sequence[int], names: Sequence[str], prefix: str) -> DataFrame:
    """``rows`` with ``f_<v>``: the sum, over the classes ``at``, of ``prefix_<v>`` of the row's level."""
    for j in at:
        side = levels.where(F.col("c") == j).select("d", F.col("level").alias(f"k{j}"), *(F.col(f"{prefix}_{v}").alias(f"_{j}_{v}") for v in names))
        rows = rows.join(side, ["d", f"k{j}"], "left")
    total = lambda v: sum((F.coalesce(F.col(f"_{j}_{v}"), F.lit(0.0)) for j in at), F.lit(0.0))
    return rows.withColumns({f"f_{v}": total(v) for v in names}).drop(*(f"_{j}_{v}" for j in at for v in names))


def _demeaned(rows: DataFrame, absorbed: int | None, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with ``sums`` as columns, each less its weighted mean by the absorbed level."""
    rows = rows.withColumns(sums)
    if absorbed is None:
        return rows
    means = rows.groupBy("d", f"k{absorbed}").agg(*(ratio(F.sum(n), F.sum("w")).alias(f"_m_{n}") for n in sums))
    joined = rows.join(means, ["d", f"k{absorbed}"])
    return joined.withColumns({n: F.col(n) - F.col("w") * F.col(f"_m_{n}") for n in sums}).drop(*(f"_m_{n}" for n in sums))


def _by_level(rows: DataFrame, at: Sequence[int], names: Sequence[str]) -> DataFrame:
    """(d, c, level, w, names...) summed by each level of the classes ``at``."""
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("c"), F.col(f"k{j}").alias("level")) for j in at)))
    flat = rows.select("d", each.alias("_at"), "w", *names).select("d", "_at.c", "_at.level", "w", *names)
    return flat.groupBy("d", "c", "level").agg(F.sum("w").alias("w"), *(F.sum(n).alias(n) for n in names))


def _conjugate_gradients(moments: DataFrame, at: Sequence[int], absorbed: int | None, right: dict[str, Column], least_norm: bool = False) -> DataFrame:
    """(d, c, level, z_<v>...): effects of the levels of the classes ``at`` on each variable of ``right``, a sum by row.

    ``least_norm`` starts at zero and scales nothing, and so ends at the solution of least norm; rows without a class
    have no effect then. Otherwise levels are scaled by their weight, which takes fewer steps.
    """
    names, spark = list(right), moments.sparkSession
    b = _by_level(_demeaned(moments, absorbed, {f"b_{v}": x for v, x in right.items()}), at, [f"b_{v}" for v in names])
    if least_norm:
        b = b.where("level <> ''")
    scale = F.lit(1.0) if least_norm else F.col("w")
    first = {f"z_{v}": F.lit(0.0) for v in names} | {f"r_{v}": F.col(f"b_{v}") for v in names} | {f"p_{v}": F.col(f"b_{v}") / scale for v in names}
    stands = cut(b.select("d", "c", "level", scale.alias("s"), *(x.alias(n) for n, x in first.items())))
    kind = moments.schema["d"].dataType.simpleString()

    def by_date(df: DataFrame, **sums) -> dict:
        """{date: {variable: sum}}, a row a date."""
        got = df.groupBy("d").agg(*(F.sum(x(v)).alias(f"{n}_{v}") for n, x in sums.items() for v in names)).collect()
        return {r["d"]: {n: np.array([r[f"{n}_{v}"] for v in names]) for n in sums} for r in got}

    def beside(df: DataFrame, found: dict, prefix: str) -> DataFrame:
        """``df`` with a column ``prefix_<v>`` for the date's number of each variable."""
        rows = [(d, *x.tolist()) for d, x in found.items()]
        side = spark.createDataFrame(rows, f"d {kind}, " + ", ".join(f"{prefix}_{v} double" for v in names))
        return df.join(F.broadcast(side), "d")

    squares = lambda v: F.col(f"r_{v}") * F.col(f"r_{v}") / F.col("s")
    divide = lambda x, y: np.divide(x, y, out=np.zeros(len(names)), where=y > 0)
    began = {d: x["rr"] for d, x in by_date(stands, rr=squares).items()}
    state, before = stands, began
    for _ in range(MAX_STEPS):
        moved = _demeaned(_fitted(moments, state, at, names, "p"), absorbed, {f"q_{v}": F.col("w") * F.col(f"f_{v}") for v in names})
        q = _by_level(moved, at, [f"q_{v}" for v in names]).drop("w")
        both = cut(state.join(q, ["d", "c", "level"]))
        dropped(stands)
        stands = both
        curved = by_date(both, pq=lambda v: F.col(f"p_{v}") * F.col(f"q_{v}"))
        after = beside(both, {d: divide(before[d], x["pq"]) for d, x in curved.items()}, "a")
        after = after.withColumns({f"z_{v}": F.col(f"z_{v}") + F.col(f"a_{v}") * F.col(f"p_{v}") for v in names} | {f"r_{v}": F.col(f"r_{v}") - F.col(f"a_{v}") * F.col(f"q_{v}") for v in names})
        now = {d: x["rr"] for d, x in by_date(after, rr=squares).items()}
        done = {d: x <= TOLERANCE**2 * began[d] for d, x in now.items()}
        if all(x.all() for x in done.values()):
            found = cut(after.select("d", "c", "level", *(f"z_{v}" for v in names)))
            dropped(stands)
            return found
        # a variable that is done stands still: its last steps would only add noise
        now = {d: np.where(done[d], 0.0, x) for d, x in now.items()}
        turned = beside(after, {d: np.where(done[d], np.nan, divide(x, before[d])) for d, x in now.items()}, "g")
        turn = {f"p_{v}": F.when(F.isnan(f"g_{v}"), 0.0).otherwise(F.col(f"r_{v}") / F.col("s") + F.col(f"g_{v}") * F.col(f"p_{v}")) for v in names}
        state, before = turned.withColumns(turn).select("d", "c", "level", "s", *(f"{x}_{v}" for x in "zrp" for v in names)), now
    raise ArithmeticError(f"no convergence in {MAX_STEPS} steps")


def _slopes(products: DataFrame, n: int, kind: str) -> DataFrame:
    """(d, b): slopes of the ``n`` numbers from what classes leave of their products, one row of n (n + 3) / 2 sums a date."""
    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                gram, right = np.zeros((n, n)), np.array([row[f"s0_{i + 1}"] for i in range(n)])
                for i in range(n):
                    for j in range(i, n):
                        gram[i, j] = gram[j, i] = row[f"s{i + 1}_{j + 1}"]
                dead = np.array([gram[i, i] <= ALIASED * row[f"v{i + 1}_{i + 1}"] for i in range(n)])
                gram[dead, :], gram[:, dead], right[dead] = 0.0, 0.0, 0.0
                out.append(least_squares(gram, right))
            yield pd.DataFrame({"d": frame["d"], "ybar": frame["ybar"], "b": out})

    return products.mapInPandas(solve, f"d {kind}, ybar double, b array<double>")


def fit(data: DataFrame, y: str, numbers: Sequence[str], classes: Sequence[str], weight: str | None, absorb: str | bool, date_col: str) -> Fit:
    """The regression of each date that has more valid rows than a constant, numbers and levels make columns."""
    numbers, classes = list(numbers), list(classes)
    if not classes:
        raise ValidationError("a class is needed to absorb; none of the regressors is one")
    everything = cut(_moments(data, y, numbers, classes, weight, date_col))
    count = lambda i: F.count_distinct(F.when(F.col(f"k{i}") != "", F.col(f"k{i}")))
    shape = everything.groupBy("d").agg(F.sum("n").alias("n"), *(count(i).alias(f"c{i}") for i in range(len(classes)))).withColumn("size", sum((F.col(f"c{i}") for i in range(len(classes))), F.lit(1 + len(numbers))))
    if isinstance(absorb, str):
        one_of("absorb", absorb, classes)
        absorbed = classes.index(absorb)
    else:
        most = shape.agg(*(F.coalesce(F.max(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(classes)))).first()
        absorbed = max(range(len(classes)), key=lambda i: most[i])
    moments = cut(everything.where("n > 0").join(shape.where("n > size").select("d"), "d", "left_semi"))

    v = [f"v{i}" for i in range(len(numbers) + 1)]
    rest = [i for i in range(len(classes)) if i != absorbed]
    found = _conjugate_gradients(moments, rest, absorbed, {n: F.col(n) for n in v}) if rest else None
    rows = _fitted(moments, found, rest, v, "z") if rest else moments.withColumns({f"f_{n}": F.lit(0.0) for n in v})
    means = cut(rows.groupBy("d", f"k{absorbed}").agg(*(ratio(F.sum(F.col(n) - F.col("w") * F.col(f"f_{n}")), F.sum("w")).alias(f"a_{n}") for n in v)))

    both = rows.join(means, ["d", f"k{absorbed}"])
    left = lambda i, j: F.sum(F.col(f"v{min(i, j)}_{max(i, j)}") - F.col(f"v{j}") * (F.col(f"f_v{i}") + F.col(f"a_v{i}")))
    pairs = [(i, j) for i in range(len(v)) for j in range(max(i, 1), len(v))]
    products = both.groupBy("d").agg(ratio(F.sum("v0"), F.sum("w")).alias("ybar"), *(left(i, j).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(f"v{i}_{i}").alias(f"v{i}_{i}") for i in range(1, len(v))))
    kind = data.schema[date_col].dataType.simpleString()
    slopes = cut(_slopes(products, len(numbers), kind)) if numbers else cut(products.select("d", "ybar", F.array().cast("array<double>").alias("b")))

    own = lambda x: sum((-F.col("b")[i - 1] * F.col(f"{x}_v{i}") for i in range(1, len(v))), F.col(f"{x}_v0"))
    by_date = F.broadcast(slopes.select("d", "b"))  # a row a date
    effects = means.join(by_date, "d").select("d", F.lit(absorbed).alias("c"), F.col(f"k{absorbed}").alias("level"), own("a").alias("e"))
    if rest:
        effects = effects.unionAll(found.join(by_date, "d").select("d", "c", "level", own("z").alias("e")))
    return Fit(numbers, classes, slopes, cut(effects), moments)


def residuals(data: DataFrame, fitted: Fit, y: str, weight: str | None, date_col: str) -> DataFrame:
    """``data`` with _ybar, _w and _residual; NULL where a row or its date takes no part."""
    slopes = F.broadcast(fitted.slopes.select(F.col("d").alias("_d"), F.col("ybar").alias("_ybar"), F.col("b").alias("_b")))  # a row a date
    joined, used = data.join(slopes, F.col(date_col) == F.col("_d"), "left"), ["_d", "_b"]
    explained = F.lit(0.0)
    for i, c in enumerate(fitted.numbers):
        explained = explained + clean(F.col(c)) * F.col("_b")[i]
    for j, c in enumerate(fitted.classes):
        side = fitted.effects.where(F.col("c") == j).select(F.col("d").alias(f"_d{j}"), F.col("level").alias(f"_l{j}"), F.col("e").alias(f"_e{j}"))
        joined = joined.join(side, (F.col(date_col) == F.col(f"_d{j}")) & (level(c) == F.col(f"_l{j}")), "left")
        explained, used = explained + F.col(f"_e{j}"), [*used, f"_d{j}", f"_l{j}", f"_e{j}"]
    w = clean(F.col(weight)) if weight else F.lit(1.0)
    return joined.withColumn("_w", w).withColumn("_residual", F.when((F.col("_w") > 0) & F.col("_d").isNotNull(), clean(F.col(y)) - explained)).drop(*used)


def coefficients(fitted: Fit, levels: bool = True) -> DataFrame:
    """(d, term, coef): slopes, and with ``levels`` the effects of all levels of all classes of least norm, with the constant among them."""
    v, names = range(1, len(fitted.numbers) + 1), fitted.classes
    slopes = fitted.slopes.select("d", F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in fitted.numbers)).cast("array<string>"), F.col("b"))).alias("term", "coef"))
    if not levels:
        return slopes
    constant = len(names)
    rows = fitted.moments.join(F.broadcast(fitted.slopes.select("d", "b")), "d").withColumn(f"k{constant}", F.lit("=1"))  # a row a date
    left = sum((-F.col("b")[i - 1] * F.col(f"v{i}") for i in v), F.col("v0"))
    found = _conjugate_gradients(cut(rows.withColumn("left", left)), range(constant + 1), None, {"left": F.col("left")}, least_norm=True)
    name = F.element_at(F.array(*(F.lit(f"{c}_") for c in names)), F.col("c") + 1)
    effects = found.where(F.col("c") < constant).select("d", F.concat(name, F.substring("level", 2, 1 << 30)).alias("term"), F.col("z_left").alias("coef"))
    return slopes.unionAll(effects)
