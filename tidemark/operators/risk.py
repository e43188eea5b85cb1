"""Factor risk and return decomposition, and the validation of risk models.

Factor covariances are (date, factor_1, factor_2, cov) or one column per factor beside (date, factor); factor returns
are (date, factor, ret) or one column per factor. Both are brought to the long form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ValidationError, require_columns, resolve_columns
from tidemark.functions.exprs import clean, full_window, growth, ratio, sum0
from tidemark.functions.scalars import bias_confidence_interval  # noqa: F401  part of this module's surface
from tidemark.sources.panel import with_periods


def _active(weight: str, benchmark_weight: str | None) -> Column:
    w = F.coalesce(clean(F.col(weight)), F.lit(0.0))
    return w - F.coalesce(clean(F.col(benchmark_weight)), F.lit(0.0)) if benchmark_weight else w


def _covariance(covariance: DataFrame, factors: Sequence[str], date_col: str) -> DataFrame:
    """(date, _row, _col, cov), a missing cell being 0; a long table may hold one half, which is mirrored."""
    require_columns(covariance, [date_col], "covariance")
    day = F.to_date(date_col).alias(date_col)
    rest = [c for c in covariance.columns if c != date_col]
    if len(rest) == 3 and not set(factors) <= set(rest):
        a, b, v = rest
        half = covariance.select(day, F.col(a).alias("_row"), F.col(b).alias("_col"), clean(F.col(v)).alias("cov"))
        both = half.unionAll(half.select(date_col, F.col("_col").alias("_row"), F.col("_row").alias("_col"), "cov"))
        given = both.groupBy(date_col, "_row", "_col").agg(F.first("cov", True).alias("cov"))
    else:
        names = [c for c in rest if c not in factors]
        if len(names) != 1 or not set(factors) <= set(rest):
            raise ValidationError(f"a covariance matrix needs a column of factor names and the columns {list(factors)}; it has {rest}")
        given = covariance.select(day, F.col(names[0]).alias("_row"), *factors).unpivot([date_col, "_row"], list(factors), "_col", "cov")
    return given.where(F.col("_row").isin(list(factors)) & F.col("_col").isin(list(factors))).withColumn("cov", F.coalesce(clean(F.col("cov")), F.lit(0.0)))


def _exposure_rows(data: DataFrame, factors: Sequence[str], weight: str, benchmark_weight: str | None, date_col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row a date: the exposure to each factor, and more sums, in one aggregation."""
    require_columns(data, [date_col, *factors, weight, benchmark_weight], "risk")
    if not factors:
        raise ValidationError("factors must not be empty")
    a = _active(weight, benchmark_weight)
    return data.groupBy(F.to_date(date_col).alias(date_col)).agg(*(sum0(a * clean(F.col(f))).alias(f) for f in factors), *(sum0(c).alias(n) for n, c in (extra or {}).items()))


def factor_exposures(data: DataFrame, *, factors: Sequence[str], weight: str = "weight", benchmark_weight: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, factor, exposure): (active) weights times asset exposures; what is missing adds nothing."""
    date_col, _ = resolve_columns(date_col)
    return _exposure_rows(data, list(factors), weight, benchmark_weight, date_col).unpivot([date_col], list(factors), "factor", "exposure")


def _marginal(data: DataFrame, covariance: DataFrame, factors: Sequence[str], weight: str, benchmark_weight: str | None, specific_risk: str, specific_is_variance: bool, date_col: str) -> DataFrame:
    """(date, factor, x, fx, s2): exposure, row of covariance times exposures, and specific variance; dates without covariance are left out."""
    require_columns(data, [specific_risk], "risk")
    a, d = _active(weight, benchmark_weight), clean(F.col(specific_risk))
    rows = _exposure_rows(data, factors, weight, benchmark_weight, date_col, {"_s2": a * a * (d if specific_is_variance else d * d)})
    x = rows.unpivot([date_col, "_s2"], list(factors), "factor", "x")
    cov = _covariance(covariance, factors, date_col)
    inner = cov.join(x.select(date_col, F.col("factor").alias("_col"), F.col("x").alias("x2")), [date_col, "_col"])
    fx = inner.groupBy(date_col, F.col("_row").alias("factor")).agg(F.sum(F.col("cov") * F.col("x2")).alias("fx"))
    dated = x.join(cov.select(date_col).distinct(), date_col, "left_semi")
    return dated.join(fx, [date_col, "factor"], "left").select(date_col, "factor", "x", F.coalesce("fx", F.lit(0.0)).alias("fx"), F.col("_s2").alias("s2"))


def risk_decomposition(data: DataFrame, covariance: DataFrame, *, factors: Sequence[str], weight: str = "weight", benchmark_weight: str | None = None, specific_risk: str = "specific_risk", specific_is_variance: bool = False, date_col: str | None = None) -> DataFrame:
    """(date, total_risk, factor_risk, specific_risk) as standard deviations; dates without covariance are left out."""
    date_col, _ = resolve_columns(date_col)
    parts = _marginal(data, covariance, list(factors), weight, benchmark_weight, specific_risk, specific_is_variance, date_col)
    sums = parts.groupBy(date_col).agg(F.sum(F.col("x") * F.col("fx")).alias("f"), F.first("s2").alias("s"))
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    return sums.select(date_col, root(F.col("f") + F.col("s")).alias("total_risk"), root(F.col("f")).alias("factor_risk"), root(F.col("s")).alias("specific_risk"))


def factor_risk_contribution(data: DataFrame, covariance: DataFrame, *, factors: Sequence[str], weight: str = "weight", benchmark_weight: str | None = None, specific_risk: str = "specific_risk", specific_is_variance: bool = False, factor_groups: Mapping[str, str] | None = None, date_col: str | None = None) -> DataFrame:
    """(date, factor, exposure, mctr, cctr, pct_of_total), with a row ``specific``; cctr adds up to total risk.

    With ``factor_groups`` factors are summed by group (those without one keep their name), without exposure and mctr.
    Dates without covariance or without risk are left out.
    """
    date_col, _ = resolve_columns(date_col)
    parts = _marginal(data, covariance, list(factors), weight, benchmark_weight, specific_risk, specific_is_variance, date_col)
    day = Window.partitionBy(date_col)
    total = F.sqrt(F.greatest(F.sum(F.col("x") * F.col("fx")).over(day), F.lit(0.0)) + F.greatest(F.col("s2"), F.lit(0.0)))
    risky = parts.withColumn("sigma", total).where("sigma > 0")
    own = risky.select(date_col, "factor", F.col("x").alias("exposure"), (F.col("fx") / F.col("sigma")).alias("mctr"), (F.col("x") * F.col("fx") / F.col("sigma")).alias("cctr"), "sigma")
    specific = risky.groupBy(date_col).agg(F.first("s2").alias("s2"), F.first("sigma").alias("sigma")).select(date_col, F.lit("specific").alias("factor"), F.lit(None).cast("double").alias("exposure"), F.lit(None).cast("double").alias("mctr"), (F.greatest(F.col("s2"), F.lit(0.0)) / F.col("sigma")).alias("cctr"), "sigma")
    if factor_groups:
        named = F.col("factor")
        for f, g in factor_groups.items():
            named = F.when(F.col("factor") == f, g).otherwise(named)
        nothing = F.lit(None).cast("double")
        own = own.groupBy(date_col, named.alias("factor")).agg(F.sum("cctr").alias("cctr"), F.first("sigma").alias("sigma")).select(date_col, "factor", nothing.alias("exposure"), nothing.alias("mctr"), "cctr", "sigma")
    return own.unionByName(specific).select(date_col, "factor", "exposure", "mctr", "cctr", ratio(F.col("cctr"), F.col("sigma")).alias("pct_of_total"))


def factor_return_attribution(data: DataFrame, factor_returns: DataFrame, *, factors: Sequence[str], weight: str = "weight", benchmark_weight: str | None = None, specific_return: str | None = None, date_col: str | None = None) -> DataFrame:
    """(date, factor, contribution): exposure times factor return on the dates both have, and ``specific`` with a specific return."""
    date_col, _ = resolve_columns(date_col)
    require_columns(factor_returns, [date_col], "factor_returns")
    extra = {}
    if specific_return is not None:
        require_columns(data, [specific_return], "factor_return_attribution")
        extra = {"_specific": _active(weight, benchmark_weight) * clean(F.col(specific_return))}
    rows = _exposure_rows(data, list(factors), weight, benchmark_weight, date_col, extra)
    day, rest = F.to_date(date_col).alias(date_col), [c for c in factor_returns.columns if c != date_col]
    if set(factors) <= set(rest):
        long = factor_returns.select(day, *factors).unpivot([date_col], list(factors), "factor", "f")
    elif len(rest) == 2:
        long = factor_returns.select(day, F.col(rest[0]).alias("factor"), F.col(rest[1]).alias("f"))
    else:
        raise ValidationError(f"factor returns need the columns {list(factors)}, or a factor and a return; they have {rest}")
    dated = rows.join(long.select(date_col).distinct(), date_col, "left_semi")
    parts = dated.unpivot([date_col], list(factors), "factor", "x").join(long, [date_col, "factor"], "left").select(date_col, "factor", (F.col("x") * clean(F.col("f"))).alias("contribution"))
    return parts.unionAll(dated.select(date_col, F.lit("specific").alias("factor"), F.col("_specific").alias("contribution"))) if extra else parts


def scenario_returns(data: DataFrame, shocks: DataFrame, *, factors: Sequence[str], weight: str = "weight", benchmark_weight: str | None = None, specific_shocks: DataFrame | None = None, date_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """(date, scenario, factor, contribution): what each scenario's shocks do to the (active) holdings of each date.

    ``shocks`` is (scenario, factor, shock): a factor's return; a factor without a shock doesn't move, and shocks to other
    factors count for nothing. ``specific_shocks`` is (scenario, id, shock), returns of assets beyond their factors: they
    add up to a row ``specific``. A row ``total`` adds up all; shocks to one factor or asset in a scenario add up.
    """
    date_col, id_col = resolve_columns(date_col, id_col)
    factors = list(factors)
    require_columns(shocks, ["scenario", "factor", "shock"], "shocks")
    exposures = factor_exposures(data, factors=factors, weight=weight, benchmark_weight=benchmark_weight, date_col=date_col)
    given = shocks.where(F.col("factor").isin(factors)).groupBy("scenario", "factor").agg(sum0(clean(F.col("shock"))).alias("shock"))
    # dates times shocks, the result's size
    parts = exposures.join(given, "factor").select(date_col, "scenario", "factor", (F.col("exposure") * F.col("shock")).alias("contribution"))
    if specific_shocks is not None:
        require_columns(specific_shocks, ["scenario", id_col, "shock"], "specific_shocks")
        require_columns(data, [id_col], "scenario_returns")
        own = data.select(F.to_date(date_col).alias(date_col), F.col(id_col).alias("_id"), _active(weight, benchmark_weight).alias("_a"))
        moved = specific_shocks.select("scenario", F.col(id_col).alias("_id"), clean(F.col("shock")).alias("_shock"))
        parts = parts.unionAll(own.join(moved, "_id").groupBy(date_col, "scenario").agg(sum0(F.col("_a") * F.col("_shock")).alias("contribution")).select(date_col, "scenario", F.lit("specific").alias("factor"), "contribution"))
    sets = [[F.col(date_col), F.col("scenario"), F.col("factor")], [F.col(date_col), F.col("scenario")]]
    rolled = parts.groupingSets(sets, F.col(date_col), F.col("scenario"), F.col("factor")).agg(F.sum("contribution").alias("contribution"), F.grouping("factor").alias("_all"))
    return rolled.select(date_col, "scenario", F.when(F.col("_all") == 1, "total").otherwise(F.col("factor")).alias("factor"), "contribution")


def historical_shocks(factor_returns: DataFrame, windows: DataFrame, *, factor: str = "factor", ret: str = "ret", date_col: str | None = None) -> DataFrame:
    """(scenario, factor, shock, n_periods): factors' returns compounded over each of ``windows`` (scenario, start, end), both ends included.

    A window without returns gives no rows; one that ends before it starts is empty. Returns meet windows by month, and
    the days are compared then, so that neither side is crossed with the other, however many windows there are.
    """
    date_col, _ = resolve_columns(date_col)
    require_columns(factor_returns, [date_col, factor, ret], "factor_returns")
    require_columns(windows, ["scenario", "start", "end"], "windows")
    rows = factor_returns.select(F.to_date(date_col).alias("_day"), F.trunc(F.to_date(date_col), "month").alias("_month"), F.col(factor).alias("factor"), clean(F.col(ret)).alias("_r"))
    spans = windows.select("scenario", F.to_date("start").alias("_from"), F.to_date("end").alias("_to")).where("_from <= _to")
    months = spans.withColumn("_month", F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))))
    inside = rows.join(months, "_month").where(F.col("_day").between(F.col("_from"), F.col("_to")) & F.col("_r").isNotNull())
    return inside.groupBy("scenario", "factor").agg((growth(F.col("_r")) - 1).alias("shock"), F.count("_r").alias("n_periods"))


def _standardized(realized: DataFrame, predicted: DataFrame, periods_per_year: float | None, annualized: bool, ret: str, risk: str, date_col: str) -> DataFrame:
    """(date, _z): realised return over the period's predicted risk, on the dates both have."""
    require_columns(realized, [date_col, ret], "realized")
    require_columns(predicted, [date_col, risk], "predicted")
    left = realized.select(F.to_date(date_col).alias(date_col), clean(F.col(ret)).alias("_r"))
    right = predicted.select(F.to_date(date_col).alias(date_col), clean(F.col(risk)).alias("_p"))
    both = with_periods(left.join(right, date_col), periods_per_year, date_col=date_col, needed=annualized, strict=False)
    return both.select(date_col, ratio(F.col("_r"), F.col("_p") / F.sqrt("_ppy")).alias("_z"))


def bias_statistic(realized: DataFrame, predicted: DataFrame, *, periods_per_year: float | None = None, predicted_is_annualized: bool = True, ret: str = "ret", risk: str = "risk", date_col: str | None = None) -> DataFrame:
    """(bias_statistic, n_periods): deviation of the standardised returns, 1 for a right model; NULL under two."""
    date_col, _ = resolve_columns(date_col)
    z = _standardized(realized, predicted, periods_per_year, predicted_is_annualized, ret, risk, date_col)
    return z.agg(F.stddev_samp("_z").alias("bias_statistic"), F.count("_z").alias("n_periods"))


def _row_window(date_col: str, window: int):
    return Window.partitionBy(F.lit(0)).orderBy(date_col).rowsBetween(1 - window, 0)


def rolling_bias_statistic(realized: DataFrame, predicted: DataFrame, window: int, *, periods_per_year: float | None = None, predicted_is_annualized: bool = True, ret: str = "ret", risk: str = "risk", date_col: str | None = None) -> DataFrame:
    """(date, bias_statistic) over the last ``window`` dates that have a standardised return."""
    date_col, _ = resolve_columns(date_col)
    z = _standardized(realized, predicted, periods_per_year, predicted_is_annualized, ret, risk, date_col).where(F.col("_z").isNotNull())
    over = _row_window(date_col, window)
    return z.select(date_col, full_window(F.stddev_samp("_z").over(over), F.col("_z"), window, over).alias("bias_statistic"))


def realized_vs_predicted(realized: DataFrame, predicted: DataFrame, *, window: int = 12, periods_per_year: float | None = None, predicted_is_annualized: bool = True, ret: str = "ret", risk: str = "risk", date_col: str | None = None) -> DataFrame:
    """(date, predicted, realized, ratio): annual predicted risk beside the rolling realised one."""
    date_col, _ = resolve_columns(date_col)
    require_columns(realized, [date_col, ret], "realized")
    require_columns(predicted, [date_col, risk], "predicted")
    left = realized.select(F.to_date(date_col).alias(date_col), clean(F.col(ret)).alias("_r"))
    right = predicted.select(F.to_date(date_col).alias(date_col), clean(F.col(risk)).alias("_p"))
    both = with_periods(left.join(right, date_col), periods_per_year, date_col=date_col)
    over = _row_window(date_col, window)
    real = full_window(F.stddev_samp("_r").over(over) * F.sqrt("_ppy"), F.col("_r"), window, over)
    said = F.col("_p") if predicted_is_annualized else F.col("_p") * F.sqrt("_ppy")
    return both.select(date_col, said.alias("predicted"), real.alias("realized")).withColumn("ratio", ratio(F.col("realized"), F.col("predicted")))
