"""Quantiles from sketches that merge: one a date and group, kept beside the panel and added to as dates or parts arrive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ValidationError, require_columns
from tidemark.functions.exprs import clean

#: Items that a sketch keeps at its lowest level; a sketch holds a few times as many, whatever it has seen.
K = 400
# The published fit of the rank error of one quantile, met with 99 % confidence.
_ERROR, _POWER = 2.296, 0.9021


def rank_error(k: int = K) -> float:
    """The share of values between a sketched quantile and the true one, at most, with 99 % confidence."""
    return _ERROR / k**_POWER


def quantile_sketches(data: DataFrame, *, value: str, by: Sequence[str] = ("date",), k: int = K) -> DataFrame:
    """(by..., sketch, n): a sketch of the values that aren't missing, and their number. Sketches are merged before the
    shuffle, so that one group's values never meet in a task; a group without values has an empty sketch."""
    if not 8 <= k <= 65535:
        raise ValidationError(f"k must lie between 8 and 65535, not {k}")
    require_columns(data, [*by, value], "quantile_sketches")
    x = clean(F.col(value))
    return data.groupBy(*by).agg(F.kll_sketch_agg_double(x, k).alias("sketch"), F.count(x).alias("n"))


def merged_sketches(sketches: DataFrame, *, by: Sequence[str] = (), sketch: str = "sketch", k: int = K) -> DataFrame:
    """(by..., sketch, n) of the union of the values behind the rows of each ``by``: months of days, or old and new parts."""
    require_columns(sketches, [*by, sketch, "n"], "merged_sketches")
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double(sketch, k).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, quantiles: Mapping[str, float], *, sketch: str = "sketch") -> DataFrame:
    """``sketches`` with a column for each name of ``quantiles`` in place of the sketch; NULL where it is empty.

    A quantile is one of the values; its rank is off by :func:`rank_error` of their number at most.
    """
    require_columns(sketches, [sketch, "n"], "sketch_quantiles")
    if not all(0 <= q <= 1 for q in quantiles.values()):
        raise ValidationError(f"quantiles must lie between 0 and 1, not {dict(quantiles)}")
    found = {name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))) for name, q in quantiles.items()}
    return sketches.withColumns(found).drop(sketch)
