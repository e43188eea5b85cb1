"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped_since, mark, stored
from tidemark.llm.text import document_keys, five_word_hashes, five_word_shingles, keyed, let, small, unkeyed, words


def sketch(hashes: Column, containment: float) -> Column:
    """The least hashes of an item, as many as its size class needs.

    Classes double: n distinct shingles fall in the class of the next power of two, u. A document that holds the share
    c of them lacks at most (1 - c) n <= (1 - c) u, so one of floor((1 - c) u) + 1 least hashes must be in it: the
    search loses no document, in any class.
    """

    def least(h: Column) -> Column:
        top = F.pow(F.lit(2), F.ceil(F.log2(F.size(h).cast("double")))).cast("double")
        return F.slice(h, F.lit(1), F.greatest(F.lit(1), F.floor(F.lit(1.0 - containment + 1e-9) * top).cast("int") + 1))

    return let(F.sort_array(F.array_distinct(hashes)), lambda h: F.when(F.size(h) > 0, least(h)).otherwise(h))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, id, item_id, n_shared, n_item): documents that hold at least ``containment`` of an item's shingles.

    Shingles are distinct runs of five lower-cased words; a text under five words is one shingle. Null and empty texts
    have none and match nothing. Rows equal in id and text give one row; of items repeated under one id, each text
    counts for itself. Null ids are kept. Texts of any length are taken whole; their shingles are rows. Empty tables give
    no rows; other columns are ignored.
    """
    lower, at = F.lower(F.col(text_col)), mark()
    bench = items.select(F.col(item_col).alias("item_id"), F.xxhash64(item_text, item_col).alias("item_key"), words(F.lower(F.col(item_text))).alias("w")).dropDuplicates(["item_key"])
    probes = stored(bench.select("item_key", F.explode(sketch(five_word_hashes(F.col("w")), containment)).alias("h")), "sketches")
    hashed = docs.select(*document_keys(id_col, text_col), F.explode(five_word_hashes(words(lower))).alias("h"))
    candidates = stored(hashed.join(small(probes), "h").select("k1", "k2", "item_key").distinct(), "candidates")

    named = small(stored(candidates.select("k1", "k2").distinct(), "candidate-documents"))
    texts = docs.select(*document_keys(id_col, text_col), F.col(id_col).alias("id"), lower.alias("text"))
    every = bench.select("item_key", "item_id", five_word_shingles(F.col("w")).alias("all")).select("item_key", "item_id", F.size("all").alias("n_item"), F.explode("all").alias("s"))
    wanted = small(stored(every, "item-shingles"))  # met before anything is shuffled, as long as the benchmark is small
    held = texts.join(named, ["k1", "k2"], "left_semi").select("k1", "k2", "id", F.explode(five_word_shingles(words(F.col("text")))).alias("s"))
    shared = held.join(wanted, "s").distinct().groupBy("k1", "k2", "id", "item_key", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    enough = shared.where(F.col("n_shared") >= F.col("n_item") * F.lit(containment) - F.lit(1e-9))
    found = stored(enough.join(candidates, ["k1", "k2", "item_key"], "left_semi").select("k1", "k2", "id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item")), "contaminated")
    dropped_since(at, found)
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` finds; null and empty texts, repeated rows and other
    columns stay as they are, whatever their names; an empty table gives an empty result."""
    bad = small(stored(contaminated(docs, items, containment, id_col, text_col).select("k1", "k2").distinct(), "contaminated-documents"))
    return unkeyed(keyed(docs, id_col, text_col).join(bad, ["k1", "k2"], "left_anti"), docs.columns)
