"""Column builders over built-in functions; every undefined result is NULL, never NaN or an error."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def nothing() -> Column:
    return F.lit(None).cast("double")


def clean(x: Column) -> Column:
    """``x`` as a double with NaN turned to NULL."""
    return F.nanvl(x.cast("double"), nothing())


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL if b is 0 or either is NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sum0(x: Column) -> Column:
    """Sum that is 0 where nothing is there to add."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def growth(x: Column) -> Column:
    """Product of 1 + x over the non-null values; 1 if there are none."""
    return F.coalesce(F.product(F.lit(1.0) + x), F.lit(1.0))


def average_rank(x: Column, keys: list[str | Column]) -> Column:
    """Rank of x within ``keys``, ties sharing their mean rank; NULL for NULL."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


def pair_correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over rows complete in both; NULL if fewer than 2 or either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def adjusted_skew(x: Column) -> Column:
    """Aggregate: bias-corrected skewness; NULL under 3 values, 0 for a constant sample."""
    n = F.count(x).cast("double")
    value = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(x)
    return F.when(n < 3, nothing()).when(F.max(x) == F.min(x), 0.0).otherwise(value)


def adjusted_kurtosis(x: Column) -> Column:
    """Aggregate: bias-corrected excess kurtosis; NULL under 4 values, 0 for a constant sample."""
    n = F.count(x).cast("double")
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, nothing()).when(F.max(x) == F.min(x), 0.0).otherwise(value)


def quantiles(x: Column, at: list[float], accuracy: int | None = None) -> Column:
    """Aggregate: an array of the quantiles of x, linearly interpolated; every distinct value of a group is kept for it.

    With ``accuracy`` they come from summaries of bounded size, merged before the shuffle: each is one of the values, and
    its rank is off by count / accuracy at most.
    """
    points = F.array(*(F.lit(float(q)) for q in at))
    return F.percentile(x, points) if accuracy is None else F.percentile_approx(x, points, accuracy)


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: mean of x under weights w over rows complete in both; NULL if the weights sum to 0."""
    both = x.isNotNull() & w.isNotNull()
    return ratio(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))


def t_stat(x: Column, mu: float = 0.0) -> Column:
    """Aggregate: (mean - mu) over its standard error; NULL under 2 values or without spread."""
    return ratio(F.avg(x) - F.lit(mu), F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def newey_west(x: Column, order: Column, lags: int | None = None, mu: float = 0.0) -> Column:
    """Aggregate: t-statistic of the mean of x with Bartlett-weighted autocovariances of the non-null values in order.

    The values of one series, at most one a date, are gathered in an array; panels are aggregated by date before.
    """
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))

    def of(values: Column) -> Column:
        n = F.size(values)
        mean = _fold(values) / n
        centred = F.transform(values, lambda v: v - mean)

        def statistic(e: Column) -> Column:
            most = F.least(F.lit(lags) if lags is not None else F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2 / 9))).cast("int"), n - 1)
            cov = lambda k: _fold(F.zip_with(F.slice(e, F.lit(1), n - k), F.slice(e, k + 1, n - k), lambda a, b: a * b)) / n
            steps = F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            variance = cov(F.lit(0)) + F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + 2 * (1 - k / (most + 1)) * cov(k))
            return F.when(variance > 0, (mean - F.lit(mu)) / F.sqrt(variance / n))

        return F.when(n >= 2, F.transform(F.array(centred), statistic)[0])

    return F.transform(F.array(F.transform(rows, lambda r: r["x"])), of)[0]


def full_window(value: Column, x: Column, width: int, over) -> Column:
    """``value`` where the frame holds ``width`` non-null values of x, else NULL."""
    return F.when(F.count(x).over(over) == width, value)


#: Beyond so many deviations the normal distribution is 0 or 1 in doubles, and within, so many terms of its series suffice.
_FAR, _TERMS = 9.0, 150


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by the series 1/2 + phi(z) (z + z^3/3 + z^5/(3*5) + ...)."""
    near = F.greatest(F.least(z, F.lit(_FAR)), F.lit(-_FAR))
    step = lambda acc, k: F.struct((acc["term"] * near * near / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * near * near / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(near.alias("term"), near.alias("sum")), step, lambda acc: acc["sum"])
    inside = F.lit(0.5) + F.exp(-near * near / 2) / F.lit((2 * math.pi) ** 0.5) * total
    return F.when(z.isNull() | F.isnan(z), None).when(z <= -_FAR, 0.0).when(z >= _FAR, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))
