"""Column builders for words and shingles, made of built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\f\r"
_ALL = 1 << 30
#: Rows up to which a table of longs is broadcast (at most about 64 MB built); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas inside ``body`` use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def document_keys(id_col: str, text_col: str) -> list[Column]:
    """Two independent 64-bit hashes of (id, text), never null: rows equal in both are one document."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(77), F.col(text_col), F.col(id_col)).alias("k2")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, k1, k2): each row as one struct beside its keys, so that no name of its columns can clash in a join."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *document_keys(id_col, text_col))


def unkeyed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The struct's columns again, with some replaced."""
    return rows.select(*((changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns))


def five_word_hashes(tokens: Column) -> Column:
    """64-bit hashes of the five-word shingles in order; under five words: one hash of the whole; none: none."""

    def pair(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def full(w: Column) -> Column:
        two = pair(w, F.slice(w, 2, _ALL))
        five = let(two, lambda b: let(pair(b, F.slice(b, 3, _ALL)), lambda c: pair(c, F.slice(w, 5, _ALL))))
        return F.slice(five, F.lit(1), F.size(w) - 4)

    return let(tokens, lambda w: F.when(F.size(w) >= 5, full(w)).when(F.size(w) > 0, F.array(F.xxhash64(F.lit(5), w))).otherwise(F.array().cast("array<bigint>")))


def five_word_shingles(tokens: Column) -> Column:
    """The distinct five-word shingles as texts; under five words: the whole; none: none."""
    return F.array_distinct(
        let(
            tokens,
            lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(5)))))
            .when(F.size(w) > 0, F.array(F.concat_ws(" ", w)))
            .otherwise(F.array().cast("array<string>")),
        )
    )
