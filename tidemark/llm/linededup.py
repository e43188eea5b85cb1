"""Fuzzy line deduplication: MinHash signatures, banding, exact Jaccard, union-find, one line per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.nearsets import links, of_characters, with_character_bands
from tidemark.llm.store import dropped, stored
from tidemark.llm.text import document_keys, keyed, unkeyed


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, n_lines, line_no from 0, line, h1, h2) of every line that has a word."""
    numbered = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    held = docs.select(*document_keys(id_col, text_col), F.col(id_col).alias("id"), F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]")).alias("all"))
    each = held.select("k1", "k2", "id", F.size("all").cast("long").alias("n_lines"), F.explode("all").alias("x"))
    return each.select("k1", "k2", "id", "n_lines", F.col("x.no").alias("line_no"), F.col("x.line").alias("line"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2"))


def repeated_lines(docs: DataFrame, jaccard: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, n_lines, dropped): documents' lines with a word, and the sorted numbers (from 0) of those to drop.

    Lines are linked if their texts are equal or their shingle sets have that Jaccard similarity; of each component the
    line of the smallest (id, line number) stays. Lines without a word always stay. Rows equal in id and text are one
    document; a null id comes first; null and empty texts have no lines and no row; an empty table gives no rows; a very
    long line is one line like any other; other columns are ignored, whatever their names.
    """
    flat = stored(_lines(docs, id_col, text_col).drop("line"), "lines")
    texts = _lines(docs, id_col, text_col).select("h1", "h2", F.col("line").alias("text"))
    distinct = texts.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    unique = stored(with_character_bands(distinct).withColumn("uid", F.monotonically_increasing_id()), "unique-lines")
    parts = connected_components(links(unique, texts, of_characters, jaccard)).withColumnRenamed("node", "uid")
    again = stored(unique.select("uid", "h1", "h2", "n").join(parts, "uid", "left").where("n > 1 or component is not null").select("h1", "h2", F.coalesce("component", "uid").alias("group")), "repeated-lines")
    dropped(unique)
    rows = stored(flat.select("k1", "k2", "id", "line_no", "h1", "h2").join(again, ["h1", "h2"]).select("k1", "k2", "id", "line_no", "group"), "repeated-places")
    place = F.struct("id", "line_no", "k1", "k2")
    stays = stored(rows.groupBy("group").agg(F.min(place).alias("stays")), "places-that-stay")
    lost = rows.join(stays, "group").where(~place.eqNullSafe(F.col("stays"))).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("line_no")).alias("lost"))
    every = flat.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("n_lines").alias("n_lines"))
    return every.join(lost, ["k1", "k2"], "left").select("k1", "k2", "id", "n_lines", F.coalesce("lost", F.array().cast("array<int>")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, jaccard: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that :func:`repeated_lines` drops; every row and every other column stays."""
    lost = repeated_lines(docs, jaccard, id_col, text_col).where(F.size("dropped") > 0).select("k1", "k2", "dropped")
    joined = keyed(docs, id_col, text_col).join(lost, ["k1", "k2"], "left")
    text = F.col("row").getField(text_col)
    left = F.concat_ws("\n", F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("dropped", i)))
    return unkeyed(joined, docs.columns, **{text_col: F.when(F.col("dropped").isNotNull(), left).otherwise(text)})
