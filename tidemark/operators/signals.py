"""Cross-sectional preprocessing of signals, and their diagnostics.

Preprocessing appends a column; ``group`` cuts the cross-section further, and rows without a group are a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import ValidationError, one_of, require_columns, resolve_columns
from tidemark.functions.exprs import adjusted_kurtosis, adjusted_skew, average_rank, clean, newey_west, pair_correlation, quantiles, ratio, t_stat
from tidemark.functions.least_squares import solve
from tidemark.operators import fixed_effects

CORRELATIONS = ("pearson", "spearman")


def _keys(data: DataFrame, factor: str, group: str | None, date_col: str | None) -> list[str]:
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, factor, group], "signals")
    return [date_col, *([group] if group else [])]


def _clipped(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def _ranked_values(data: DataFrame, keys: Sequence[str], x: Column, at: Sequence[float], accuracy: int) -> DataFrame:
    """(_k0, ..., _bounds): by ``keys``, the values of rank ceil(q n), 1 at least, for each q of ``at``; no row without values.

    Summaries of bounded size, merged before the shuffle, enclose each between two values twice their error away. A second
    pass counts the values below and each one in between, of which there are about 4 n / accuracy and ties.
    """
    rows = data.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), x.alias("_x")).where("_x is not null")
    k = [f"_k{i}" for i in range(len(keys))]
    points = [min(max(q + side * 2 / accuracy, 0.0), 1.0) for q in at for side in (-1, 1)]
    near = rows.groupBy(*(F.col(c).alias(f"{c}_") for c in k)).agg(F.percentile_approx("_x", points, accuracy).alias("ends"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.count("*").alias("n"))
    end = lambda j: F.col("least") if points[j] == 0 else F.col("most") if points[j] == 1 else F.get("ends", F.lit(j))
    ranks = (F.greatest(F.ceil(F.lit(Decimal(str(q))) * F.col("n")).cast("bigint"), F.lit(1)) for q in at)  # in decimals: 0.95 n may be whole
    each = F.array(*(F.struct(F.lit(i).alias("i"), end(2 * i).alias("low"), end(2 * i + 1).alias("high"), r.alias("rank")) for i, r in enumerate(ranks)))
    met = rows.join(near.select(*(f"{c}_" for c in k), each.alias("each")), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in k])
    met = met.select(*k, "_x", F.explode(F.filter("each", lambda e: F.col("_x") <= e["high"])).alias("e"))
    counts = met.groupBy(*k, "e.i", "e.rank", F.when(F.col("_x") >= F.col("e.low"), F.col("_x")).alias("v")).agg(F.count("*").alias("m"))
    upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*k, "i").orderBy(F.asc_nulls_first("v"))))
    found = upto.groupBy(*k, "i").agg(F.min(F.when(F.col("upto") >= F.col("rank"), F.struct("upto", "v")))["v"].alias("v"))
    one = lambda i: F.max(F.when(F.col("i") == i, F.col("v")))
    missed = F.raise_error(F.lit("a summary missed a rank")).cast("double")
    return found.groupBy(*k).agg(F.array(*(F.coalesce(one(i), missed) for i in range(len(at)))).alias("_bounds"))


def winsorize(data: DataFrame, *, factor: str, lower: float = 0.01, upper: float = 0.99, group: str | None = None, accuracy: int | None = None, output: str | None = None, date_col: str | None = None) -> DataFrame:
    """Clip at linearly interpolated quantiles of the date (and group), or with ``accuracy`` at the values of rank ceil(q n):
    summaries of bounded size narrow the ranks down to about 4 n / accuracy values, and a second pass counts these out."""
    if not 0 <= lower < upper <= 1:
        raise ValidationError(f"0 <= lower < upper <= 1 is needed, not {lower}, {upper}")
    keys, x = _keys(data, factor, group, date_col), clean(F.col(factor))
    # counts of values combine before the shuffle, and one row a date (and group) is joined back
    if accuracy is None:
        bounds = data.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(quantiles(x, [lower, upper]).alias("_bounds"))
    else:
        bounds = _ranked_values(data, keys, x, [lower, upper], accuracy)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = data.join(bounds, same, "left").withColumn(output or f"{factor}_winsorized", _clipped(x, F.get("_bounds", F.lit(0)), F.get("_bounds", F.lit(1))))
    return joined.drop("_bounds", *(f"_k{i}" for i in range(len(keys))))


def clip_outliers(data: DataFrame, *, factor: str, n_sigma: float = 3.0, group: str | None = None, output: str | None = None, date_col: str | None = None) -> DataFrame:
    """Clip at the mean plus and minus ``n_sigma`` sample deviations; a single value has none and stays."""
    if n_sigma <= 0:
        raise ValidationError(f"n_sigma must be positive, not {n_sigma}")
    over, x = Window.partitionBy(*_keys(data, factor, group, date_col)), clean(F.col(factor))
    mean, width = F.avg(x).over(over), F.stddev_samp(x).over(over) * n_sigma
    return data.withColumn(output or f"{factor}_clipped", _clipped(x, mean - width, mean + width))


def standardize(data: DataFrame, *, factor: str, method: str = "zscore", weight: str | None = None, group: str | None = None, output: str | None = None, date_col: str | None = None) -> DataFrame:
    """Z-score, or average rank over the count of values (``method="rank"``, which takes no weight).

    With ``weight`` the z-score uses the weighted mean and population deviation of rows with a positive weight; others,
    and groups under two such rows or without spread, get NULL.
    """
    one_of("method", method, ("zscore", "rank"))
    keys = _keys(data, factor, group, date_col)
    over, x, name = Window.partitionBy(*keys), clean(F.col(factor)), output or f"{factor}_{'rank' if method == 'rank' else 'z'}"
    if method == "rank":
        return data.withColumn("_x", x).withColumn(name, ratio(average_rank(F.col("_x"), keys), F.count("_x").over(over))).drop("_x")
    if weight is None:
        return data.withColumn(name, ratio(x - F.avg(x).over(over), F.stddev_samp(x).over(over)))
    require_columns(data, [weight], "standardize")
    w = clean(F.col(weight))
    valid = x.isNotNull() & (w > 0)
    first = data.withColumns({"_x": F.when(valid, x), "_w": F.when(valid, w)})
    second = first.withColumns({"_m": ratio(F.sum(F.col("_x") * F.col("_w")).over(over), F.sum("_w").over(over)), "_n": F.count("_x").over(over)})
    spread = F.sqrt(ratio(F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("_m"), F.lit(2))).over(over), F.sum("_w").over(over)))
    return second.withColumn("_s", spread).withColumn(name, F.when(F.col("_n") >= 2, ratio(F.col("_x") - F.col("_m"), F.col("_s")))).drop("_x", "_w", "_m", "_n", "_s")


def _is_number(data: DataFrame, column: str) -> bool:
    return isinstance(data.schema[column].dataType, T.NumericType | T.BooleanType)


def _fits(data: DataFrame, y: str, by: Sequence[str], weight: str | None, date_col: str) -> DataFrame:
    """(date, ybar, coef map<term, double>) of each date with more valid rows than design columns.

    Cross-sections are never gathered: moments are summed by date and combination of classes (partly before the
    shuffle), and only those sums, of the size of the design, reach the solver.
    """
    numbers, classes = [c for c in by if _is_number(data, c)], [c for c in by if not _is_number(data, c)]
    x = {f"x{i}": clean(F.col(c)) for i, c in enumerate(numbers)}
    k = {f"k{i}": F.col(c).cast("string") for i, c in enumerate(classes)}
    w = clean(F.col(weight)) if weight else F.lit(1.0)
    rows = data.where(F.col(date_col).isNotNull()).select(F.col(date_col).alias("d"), clean(F.col(y)).alias("y"), w.alias("w"), *(c.alias(n) for n, c in {**x, **k}.items()))
    valid = F.col("y").isNotNull() & (F.col("w") > 0)
    for n in x:
        valid = valid & F.col(n).isNotNull()
    one = {"c": F.lit(1.0), **{n: F.col(n) for n in x}}
    sums = {"n": F.count_if("ok"), "yw": F.sum(F.when(F.col("ok"), F.col("y") * F.col("w")))}
    sums |= {f"{a}_y": F.sum(F.when(F.col("ok"), one[a] * F.col("y") * F.col("w"))) for a in one}
    sums |= {f"{a}_{b}": F.sum(F.when(F.col("ok"), one[a] * one[b] * F.col("w"))) for a, b in combinations_with_replacement(one, 2)}
    moments = rows.withColumn("ok", F.coalesce(valid, F.lit(False))).groupBy("d", *k).agg(*(v.alias(n) for n, v in sums.items()))

    names, summed, classed = list(one), list(sums), list(k)  # plain lists: columns can't go to the executors

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pdf.fillna({n: 0.0 for n in summed})
        terms = ["_const", *numbers, *(f"{c}_{v}" for n, c in zip(classed, classes, strict=True) for v in sorted(got[n].dropna().unique()))]
        at = {t: i for i, t in enumerate(terms)}
        size, gram, right = len(terms), np.zeros((len(terms), len(terms))), np.zeros(len(terms))
        n_valid = int(got["n"].sum())
        if n_valid <= size:
            return pd.DataFrame({"d": [], "ybar": [], "coef": []}, dtype=object)
        width = 1 + len(numbers)
        for row in got.to_dict("records"):
            dummies = [at[f"{c}_{row[n]}"] for n, c in zip(classed, classes, strict=True) if isinstance(row[n], str)]
            for i, a in enumerate(names):
                right[i] += row[f"{a}_y"]
                for j in range(i, width):
                    gram[i, j] += row[f"{a}_{names[j]}"]
                for d in dummies:
                    gram[i, d] += row[f"c_{a}"]
            for d in dummies:
                right[d] += row["c_y"]
                for e in dummies:
                    if d <= e:
                        gram[d, e] += row["c_c"]
        gram = np.triu(gram) + np.triu(gram, 1).T
        beta = solve(gram, right)
        return pd.DataFrame({"d": [pdf["d"].iloc[0]], "ybar": [got["yw"].sum() / gram[0, 0]], "coef": [dict(zip(terms, beta.tolist(), strict=True))]})

    kind = data.schema[date_col].dataType.simpleString()
    return moments.groupBy("d").applyInPandas(fitted, f"d {kind}, ybar double, coef map<string,double>")


def _absorbed(data: DataFrame, y: str, by: Sequence[str], weight: str | None, absorb: str | bool, date_col: str) -> fixed_effects.Fit:
    numbers = [c for c in by if _is_number(data, c)]
    return fixed_effects.fit(data, y, numbers, [c for c in by if c not in numbers], weight, absorb, date_col)


def _residuals(data: DataFrame, y: str, by: Sequence[str], weight: str | None, absorb: str | bool, date_col: str) -> DataFrame:
    """``data`` with _ybar, _w and _residual; NULL where a row or its date takes no part."""
    if absorb:
        return fixed_effects.residuals(data, _absorbed(data, y, by, weight, absorb, date_col), y, weight, date_col)
    fits = _fits(data, y, by, weight, date_col)
    of = lambda t: F.element_at("coef", t)
    numbers = [c for c in by if _is_number(data, c)]
    base = fits.select(F.col("d").alias("_d"), F.col("ybar").alias("_ybar"), of("_const").alias("_const"), *(of(c).alias(f"_b{i}") for i, c in enumerate(numbers)))
    joined, used = data.join(base, F.col(date_col) == F.col("_d"), "left"), ["_d", "_const", *(f"_b{i}" for i in range(len(numbers)))]
    fitted = F.col("_const")
    for i, c in enumerate(numbers):
        fitted = fitted + clean(F.col(c)) * F.col(f"_b{i}")
    for i, c in enumerate(c for c in by if c not in numbers):  # a row a date and class, joined by both
        name, each = F.lit(f"{c}_"), fits.select(F.col("d").alias(f"_d{i}"), F.explode("coef").alias(f"_t{i}", f"_c{i}"))
        each = each.where(F.col(f"_t{i}").startswith(name))
        joined = joined.join(each, (F.col(date_col) == F.col(f"_d{i}")) & (F.concat(name, F.col(c).cast("string")) == F.col(f"_t{i}")), "left")
        fitted, used = fitted + F.when(F.col(c).isNull(), 0.0).otherwise(F.col(f"_c{i}")), [*used, f"_d{i}", f"_t{i}", f"_c{i}"]
    w = clean(F.col(weight)) if weight else F.lit(1.0)
    return joined.withColumn("_w", w).withColumn("_residual", F.when(F.col("_w") > 0, clean(F.col(y)) - fitted)).drop(*used)


def neutralize(data: DataFrame, *, factor: str, by: str | Sequence[str], weight: str | None = None, absorb: str | bool = False, output: str | None = None, date_col: str | None = None) -> DataFrame:
    """Residual of a (weighted) regression, per date, on a constant, numbers and a dummy for each class.

    NULL where the factor, a number or a positive weight is missing, and on dates without more such rows than columns.
    Rows without a class have no dummy of it. ``absorb`` names a class of many levels, or True takes the one of most:
    residuals are the same then, to about nine digits, but come from joins and sums without a matrix of the levels (see
    :mod:`tidemark.operators.fixed_effects`). It runs jobs at once, a few for each step of conjugate gradients; one class
    takes no step. Without it a date's columns make a dense matrix in one task: up to about a thousand levels.
    """
    date_col, _ = resolve_columns(date_col)
    by = [by] if isinstance(by, str) else list(by)
    require_columns(data, [date_col, factor, *by, weight], "neutralize")
    return _residuals(data, factor, by, weight, absorb, date_col).withColumnRenamed("_residual", output or f"{factor}_neutral").drop("_ybar", "_w")


def coverage(data: DataFrame, *, factor: str, universe: DataFrame | None = None, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, n_valid, n_total, missing_rate, coverage_rate), against the rows or a universe's distinct ids."""
    date_col, id_col = resolve_columns(date_col, id_col)
    require_columns(data, [date_col, factor], "coverage")
    own = data.groupBy(date_col).agg(F.count(clean(F.col(factor))).alias("n_valid"), F.count(F.lit(1)).alias("_rows"))
    if universe is None:
        out = own.withColumn("n_total", F.col("_rows"))
    else:
        require_columns(universe, [date_col, id_col], "coverage")
        out = own.join(universe.groupBy(date_col).agg(F.count_distinct(id_col).alias("n_total")), date_col, "left")
    rate = ratio(F.col("n_valid"), F.col("n_total"))
    return out.select(date_col, "n_valid", "n_total", (1 - ratio(F.col("n_valid"), F.col("_rows"))).alias("missing_rate"), rate.alias("coverage_rate"))


def distribution_summary(data: DataFrame, *, factor: str, accuracy: int | None = None, date_col: str | None = None) -> DataFrame:
    """Per date: mean, std, skew, kurtosis, min, p01, p50, p99, max; with ``accuracy`` the ranks of the
    quantiles are off by count / accuracy at most, from summaries of bounded size."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, factor], "distribution_summary")
    x = clean(F.col(factor))
    got = data.groupBy(date_col).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), adjusted_skew(x).alias("skew"), adjusted_kurtosis(x).alias("kurtosis"), F.min(x).alias("min"), quantiles(x, [0.01, 0.5, 0.99], accuracy).alias("p"), F.max(x).alias("max"))
    return got.select(date_col, "mean", "std", "skew", "kurtosis", "min", *(F.col("p")[i].alias(n) for i, n in enumerate(("p01", "p50", "p99"))), "max")


def factor_exposure(data: DataFrame, *, factor: str, factors: Sequence[str], weight: str | None = None, absorb: str | bool = False, levels: bool = True, date_col: str | None = None) -> DataFrame:
    """(date, term, coef): a date's regression coefficients without the constant; classes give terms ``column_value``.

    Where columns depend on each other, coefficients are those of least norm. ``absorb`` as in :func:`neutralize`; numbers
    that classes explain have a coefficient of 0 with it. Without ``levels`` numbers only are given, which saves the steps
    that levels of least norm take.
    """
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, factor, *factors, weight], "factor_exposure")
    if absorb:
        return fixed_effects.coefficients(_absorbed(data, factor, list(factors), weight, absorb, date_col), levels).withColumnRenamed("d", date_col)
    fits = _fits(data, factor, list(factors), weight, date_col)
    terms = fits.select(F.col("d").alias(date_col), F.explode("coef").alias("term", "coef")).where("term <> '_const'")
    return terms if levels else terms.where(F.col("term").isin([c for c in factors if _is_number(data, c)]))


def explained_ratio(data: DataFrame, *, factor: str, factors: Sequence[str], weight: str | None = None, absorb: str | bool = False, date_col: str | None = None) -> DataFrame:
    """(date, r_squared) of the dates that can be fitted; NULL where the factor does not vary. ``absorb`` as in :func:`neutralize`."""
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, factor, *factors, weight], "explained_ratio")
    rows = _residuals(data, factor, list(factors), weight, absorb, date_col).where(F.col("_residual").isNotNull())
    y = clean(F.col(factor))
    spread = F.sum(F.col("_w") * F.pow(y - F.col("_ybar"), F.lit(2)))
    left = F.sum(F.col("_w") * F.pow("_residual", F.lit(2)))
    return rows.groupBy(date_col).agg(F.when(spread > 0, 1 - ratio(left, spread)).alias("r_squared"))


def exposure_summary(exposures: DataFrame, *, date_col: str | None = None) -> DataFrame:
    """(term, mean, std, t_stat, t_stat_nw, hit_rate, n_periods) over the dates of :func:`factor_exposure`."""
    date_col, _ = resolve_columns(date_col)
    require_columns(exposures, [date_col, "term", "coef"], "exposure_summary")
    x = clean(F.col("coef"))
    return exposures.groupBy("term").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), t_stat(x).alias("t_stat"), newey_west(x, F.col(date_col)).alias("t_stat_nw"), ratio(F.count_if(x > 0), F.count(x)).alias("hit_rate"), F.count(x).alias("n_periods"))


def _ranked(data: DataFrame, columns: Sequence[str], method: str, keys: Sequence[str]) -> DataFrame:
    """``data`` with each column replaced by itself or by its rank over its own values."""
    cleaned = data.withColumns({c: clean(F.col(c)) for c in columns})
    return cleaned if method == "pearson" else cleaned.withColumns({f"_r_{c}": average_rank(F.col(c), list(keys)) for c in columns}).withColumns({c: F.col(f"_r_{c}") for c in columns}).drop(*(f"_r_{c}" for c in columns))


def signal_correlation(data: DataFrame, *, factors: Sequence[str], method: str = "spearman", date_col: str | None = None) -> DataFrame:
    """(factor_1, factor_2, correlation): mean over dates of the cross-sectional correlations, for every ordered pair."""
    one_of("method", method, CORRELATIONS)
    factors = list(factors)
    if len(factors) < 2:
        raise ValidationError(f"at least two factors are needed, not {factors}")
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, *factors], "signal_correlation")
    rows = _ranked(data.select(date_col, *factors), factors, method, [date_col])
    pairs = list(combinations_with_replacement(range(len(factors)), 2))
    daily = rows.groupBy(date_col).agg(*(pair_correlation(F.col(factors[i]), F.col(factors[j])).alias(f"c{i}_{j}") for i, j in pairs))
    mean = daily.agg(*(F.avg(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs))
    cell = lambda i, j: F.struct(F.lit(factors[i]).alias("factor_1"), F.lit(factors[j]).alias("factor_2"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("correlation"))
    return mean.select(F.inline(F.array(*(cell(i, j) for i in range(len(factors)) for j in range(len(factors))))))


def rolling_signal_correlation(data: DataFrame, *, factors: Sequence[str], method: str = "spearman", date_col: str | None = None) -> DataFrame:
    """(date, correlation) of exactly two signals."""
    one_of("method", method, CORRELATIONS)
    if len(factors) != 2:
        raise ValidationError(f"exactly two factors are needed, not {list(factors)}")
    date_col, _ = resolve_columns(date_col)
    require_columns(data, [date_col, *factors], "rolling_signal_correlation")
    a, b = factors
    return _ranked(data.select(date_col, a, b), factors, method, [date_col]).groupBy(date_col).agg(pair_correlation(F.col(a), F.col(b)).alias("correlation"))
