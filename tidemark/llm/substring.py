"""Removal of long repeated passages: winnowed anchors, extension to windows, maximal runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored
from tidemark.llm.text import document_keys, keyed, unkeyed

#: Words of an anchor. A window of w words holds w - ANCHOR + 1 anchors' places and keeps the least of their hashes.
ANCHOR = 12
_BASES = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class _Powers:
    """Powers of an odd base and of its inverse mod 2^64, as many as the longest text so far needs."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_hashes(x: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` words, from the words' hashes; equal runs have equal hashes."""
    up, down = _POWERS[which].upto(len(x) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[:-1], dtype=np.uint64)))
    return _mixed((sums[width:] - sums[:-width]) * down[: len(x) - width + 1])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The least or largest of each run of ``width``, by doubling."""
    span = 1
    out = x
    while span < width:
        step = min(span, width - span)
        out = best(out[:-step], out[step:])
        span += step
    return out


def _word_hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, tokens), np.uint64, len(tokens))


def _least_anchor(x: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors' hashes, and of each window the least of those inside it."""
    grams = _window_hashes(x, anchor)
    return grams, _sliding(grams, window - anchor + 1, np.minimum)


def anchors(docs: DataFrame, window: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, n_words, sha256, anchors) of each row: the winnowed anchors' hashes, once for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, sha, found = [], [], []
            for text in batch.column(3):
                tokens = (text.as_py() or b"").split()
                n_words.append(len(tokens))
                sha.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                if len(tokens) < window:
                    found.append([])
                    continue
                grams, least = _least_anchor(_word_hashes(tokens), window, anchor)
                near = window - anchor  # a place is kept if it is the least of a window that holds it
                padded = np.concatenate((np.zeros(near, np.uint64), least, np.zeros(near, np.uint64)))
                found.append(grams[_sliding(padded, near + 1, np.maximum) == grams].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["k1", "k2", "id", "n_words", "sha256", "anchors"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(*document_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, f"k1 long, k2 long, id {kind}, n_words long, sha256 string, anchors array<long>")


def _extend(window: int, anchor: int):
    """From a text and its repeated anchors to the windows that hold one as their least: starts and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, first, second = [], [], []
            for text, seeds in zip(batch.column("text"), batch.column("seeds"), strict=True):
                x = _word_hashes(text.as_py().split())
                _, least = _least_anchor(x, window, anchor)
                at = np.nonzero(np.isin(least, np.array(seeds.as_py(), np.int64).view(np.uint64)))[0]
                starts.append(at.astype(np.int32))
                first.append(_window_hashes(x, window)[at].view(np.int64))
                second.append(_window_hashes(x, window, 1)[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("whole"), pa.array(starts, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.list_(pa.int64()))], names=["k1", "k2", "whole", "starts", "h1", "h2"])

    return run


def _cut_out(window: int):
    """From a text and the starts of its repeated windows to the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column("text"), batch.column("found"), strict=True):
                tokens = text.as_py().split()
                edges = np.zeros(len(tokens) + 1, np.int32)
                at = np.unique(np.array(starts.as_py(), np.int64))
                edges[at] += 1
                edges[at + window] -= 1  # starts are unique, so are ends
                gone = np.cumsum(edges)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, out in zip(tokens, gone.tolist(), strict=True) if not out]))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], names=["k1", "k2", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all documents, cut documents): ``k1, k2, id, n_words, sha256`` of each row, and ``k1, k2, n_removed, kept`` of
    each document that loses words.

    Documents of the same words lose all of them; one of each group goes on, to be met by others, and counts twice.
    Seeds: anchors that occur twice or more. Equal windows keep equal least anchors, so every repeated window holds a
    seed as its least anchor. Extension: each seed is extended both ways to the windows it is the least anchor of; a
    window is repeated if its 128-bit hash is found twice. Overlapping repeated windows merge to maximal runs. Counts
    are combined before the shuffle and joined back, so that no group of copies meets in one task, and no pairs arise.
    """
    found = stored(anchors(docs, window, anchor, id_col, text_col), "anchors")
    groups = stored(found.where(F.col("n_words") >= window).groupBy("sha256").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("lead")), "same-words")
    leads = groups.select("lead.k1", "lead.k2", (F.col("n") > 1).alias("whole"))
    copies = found.select("k1", "k2", "n_words", "sha256").join(groups.where("n > 1").select("sha256"), "sha256").select("k1", "k2", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))

    seeds = stored(found.select("k1", "k2", "anchors").join(leads, ["k1", "k2"]).select("k1", "k2", "whole", F.explode("anchors").alias("anchor")), "seeds")
    times = F.sum(F.when(F.col("whole"), 2).otherwise(1))
    # stored, so that both sides of the joins are plain exchanges and one key's many rows can be split
    twice = stored(seeds.groupBy("anchor").agg(times.alias("times")).where("times > 1").select("anchor"), "repeated-anchors")
    seeded = stored(seeds.join(twice, "anchor").groupBy("k1", "k2").agg(F.first("whole").alias("whole"), F.collect_set("anchor").alias("seeds")), "seeded")
    texts = docs.select(*document_keys(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    lists = "k1 long, k2 long, whole boolean, starts array<int>, h1 array<long>, h2 array<long>"
    wide = stored(texts.join(seeded.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(_extend(window, anchor), lists), "windows")
    places = wide.select("k1", "k2", "whole", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("k1", "k2", "whole", "w.starts", "w.h1", "w.h2")
    again = stored(places.groupBy("h1", "h2").agg(times.alias("times")).where("times > 1").select("h1", "h2"), "found-twice")
    hits = stored(places.where("not whole").drop("whole").join(again, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("starts").alias("found")), "repeated-windows")
    for table in (seeds, twice, seeded, wide, again):
        dropped(table)
    cut = texts.join(hits.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(_cut_out(window), "k1 long, k2 long, n_removed long, kept string")
    return found.drop("anchors"), cut.unionAll(copies)


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): words left after each word covered by a repeated window is removed.

    A window of ``window`` words is repeated if its words also start anywhere else, in the same document too; windows
    are judged on the input. Repeated rows count as places of their own, so both lose what they share. Null and empty
    texts, and texts shorter than a window, lose nothing. A text of any length is taken whole, by one task at a time, with
    some forty bytes a word. A null id stays null; an empty table gives no rows; other
    columns are ignored.
    """
    every, cut = repeated_windows(docs, window, anchor, id_col, text_col)
    lost = cut.select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["k1", "k2"])
    out = every.join(lost, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = 35, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts left by :func:`remove_repeats`, words joined by one space where any was removed."""
    _, cut = repeated_windows(docs, window, anchor, id_col, text_col)
    kept = cut.select("k1", "k2", "kept").dropDuplicates(["k1", "k2"])
    joined = keyed(docs, id_col, text_col).join(kept, ["k1", "k2"], "left")
    return unkeyed(joined, docs.columns, **{text_col: F.coalesce("kept", F.col("row").getField(text_col))})
