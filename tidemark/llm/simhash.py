"""SimHash near-duplicates: fingerprints, vantage-point shards, exact pairs, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.nearsets import BANDS, links, of_words, with_bands
from tidemark.llm.store import dropped, stored
from tidemark.llm.text import document_keys, keyed, small, unkeyed

#: Fingerprints that the trees' vantage points and radii are fitted to; every fingerprint is indexed.
SAMPLE = 20_000
#: Fingerprints a shard should hold, and the most that one task compares with its visitors.
SHARD, BLOCK = 4_096, 8_192
MAX_BITS = 3
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42); no words: 0. Unsigned."""
    tokens = text.lower().split() if text else []  # of bytes: only A-Z, only space and 0x09-0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[len(tokens) - n :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) of each row, repeated rows included; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, f"id {kind}, fingerprint long")


class VantageTree:
    """A vantage-point tree over 32-bit values under Hamming distance, fitted to a sample.

    Inner node: values within ``radius`` of ``point`` go left. A query of range r visits the left side if its
    distance minus r is at most the radius, and the right side if its distance plus r exceeds it: by the triangle
    inequality no value within r lies elsewhere.
    """

    def __init__(self, sample: np.ndarray, depth: int, seed: int) -> None:
        self.point, self.radius, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(np.asarray(sample, np.uint32), depth, np.random.default_rng(seed))

    def _grow(self, values: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(self.point)
        for part in (self.point, self.radius, self.left, self.right, self.leaf):
            part.append(-1)
        best = None
        if depth > 0 and len(values) > 1:
            for point in rng.choice(values, 8):
                d = np.bitwise_count(values ^ point)
                radius = int(np.median(d))
                inside = np.count_nonzero(d <= radius)
                blurred = np.count_nonzero((d == radius) | (d == radius + 1))  # values whose queries visit both sides
                cost = blurred + abs(len(values) - 2 * inside)
                if 0 < inside < len(values) and (best is None or cost < best[0]):
                    best = cost, point, radius, d <= radius
        if best is None:
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
            return at
        _, self.point[at], self.radius[at], inside = best
        self.left[at] = self._grow(values[inside], depth - 1, rng)
        self.right[at] = self._grow(values[~inside], depth - 1, rng)
        return at

    def visits(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each visit of queries with that reach; reach 0 gives the one home of each value."""
        rows, leaves, todo = [], [], [(0, np.arange(len(values)))]
        while todo:
            at, mine = todo.pop()
            if self.leaf[at] >= 0:
                rows.append(mine)
                leaves.append(np.full(len(mine), self.leaf[at]))
            elif len(mine):
                d = np.bitwise_count(values[mine] ^ self.point[at]).astype(np.int64)
                todo.append((self.left[at], mine[d - reach <= self.radius[at]]))
                todo.append((self.right[at], mine[d + reach > self.radius[at]]))
        return np.concatenate(rows), np.concatenate(leaves)


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of a[i] and b[i]; smaller indices become roots."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def _shard_links(homes: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links between homes and visitors (uint64, each without repeats): at most one edge a node."""
    nodes = np.union1d(homes, visitors)
    h, parent = np.searchsorted(nodes, homes), np.arange(len(nodes))
    step = max(1, (1 << 21) // max(1, len(homes)))
    for at in range(0, len(visitors), step):
        some = visitors[at : at + step]
        i, j = np.nonzero(np.bitwise_count(some[:, None] ^ homes[None, :]) <= bits)
        parent = _unite(parent, np.searchsorted(nodes, some)[i], h[j])
    linked = np.nonzero(parent != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[parent[linked]]


def hamming_links(prints: DataFrame, bits: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join every two distinct fingerprints at ``bits`` or fewer differing bits.

    ``prints``: a stored table of distinct longs ``fingerprint``. Two fingerprints at 3 bits differ in at most one bit
    of one half, so each half has its own tree, asked with reach 1: that prunes far better than reach 3 on 64 bits.
    A shard holds its home values and the visitors whose range reaches it; a large one is cut into blocks of homes and
    of visitors, each pair of which is a group of its own, so that no group outgrows a task. All comparisons use the
    64 bits. Each group returns a spanning forest, never its pairs.
    """
    spark = prints.sparkSession
    reach = bits // 2
    n = prints.count()
    share = max(1, n // sample)
    got = prints.where(F.pmod(F.xxhash64(F.lit(9), "fingerprint"), F.lit(share)) == 0).limit(2 * sample).collect()
    picked = np.array([r[0] for r in got], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard))))
    trees = [VantageTree(half, depth, seed) for seed, half in enumerate(_halves(picked))]
    parts = []  # of each tree, for each leaf: blocks of its homes, and of its visitors
    for tree, half in zip(trees, _halves(picked), strict=True):
        scale, counts = n / max(1, len(picked)), []
        for asked, most in ((0, block), (reach, 4 * block)):
            per_leaf = np.bincount(tree.visits(half, asked)[1], minlength=tree.leaves) if len(half) else np.zeros(tree.leaves)
            counts.append(np.maximum(1, np.ceil(per_leaf * scale / most).astype(np.int64)))
        parts.append(counts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "leaf", "block", "visitors", "home", "fingerprint"]
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            values = signed.view(np.uint64)
            slot = [(values * np.uint64(m) >> np.uint64(33)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            for t, half in enumerate(_halves(values)):
                for home in (True, False):  # a home goes to all blocks of visitors, a visitor to all blocks of homes
                    rows, leaves = trees[t].visits(half, 0 if home else reach)
                    own, other = parts[t] if home else parts[t][::-1]
                    mine = slot[0 if home else 1][rows] % own[leaves]
                    for k in range(int(other[leaves].max(initial=0))):
                        sent = other[leaves] > k
                        size, theirs = int(sent.sum()), np.full(int(sent.sum()), k)
                        at = (mine[sent], theirs) if home else (theirs, mine[sent])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, t, np.int32)), pa.array(leaves[sent].astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in at), pa.array(np.full(size, home)), pa.array(signed[rows[sent]])], names=names)

    def compare(pdf):
        import pandas as pd

        values, home = pdf["fingerprint"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        a, b = _shard_links(np.unique(values[home]), np.unique(values[~home]), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = prints.select("fingerprint").repartition(max(1, min(n // 20_000 + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(route, "tree int, leaf int, block int, visitors int, home boolean, fingerprint long")
    return routed.groupBy("tree", "leaf", "block", "visitors").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint long, component_id): rows whose fingerprints are linked by steps of ``bits`` or fewer bits.

    component_id is the smallest id in the component. Every input row gives one row: repeated rows and equal texts share
    a fingerprint; null and empty texts have fingerprint 0 and link like others; a null id is never smallest, and where
    a component has no other, its component_id is null. A text of any length is read whole, by the task that has its row, and
    is not shuffled. An empty table gives an empty result; other columns are ignored.
    """
    per_doc = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    return _named(per_doc, bits).withColumnRenamed("id", id_col)


def _named(per_doc: DataFrame, bits: int, more: DataFrame | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of a stored (id, fingerprint); ``more``: further edges (a, b) of fingerprints."""
    prints = stored(per_doc.groupBy("fingerprint").agg(F.min("id").alias("least")), "prints")
    edges = hamming_links(prints.select("fingerprint"), bits)
    parts = connected_components(edges if more is None else edges.unionAll(more)).withColumnRenamed("node", "fingerprint")
    rooted = stored(prints.join(parts, "fingerprint", "left").withColumn("root", F.coalesce("component", "fingerprint")), "rooted-prints")
    leaders = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # stored, so that both sides of the join are plain exchanges and a fingerprint of many copies can be split
    named = stored(rooted.join(leaders, "root").select("fingerprint", "component_id"), "named-prints")
    dropped(prints)
    dropped(rooted)
    return per_doc.join(small(named), "fingerprint").select("id", "fingerprint", "component_id")


def _near_copies(texts: DataFrame, per_doc: DataFrame, jaccard: float) -> DataFrame:
    """Edges (a, b) of fingerprints of the texts (h1, h2, text) whose sets of five-word shingles have that similarity."""
    flat = stored(with_bands(texts, "text", of_words), "text-bands")
    unique = stored(flat.groupBy("h1", "h2").agg(*(F.first(f"b{i}").alias(f"b{i}") for i in range(BANDS)), F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id()), "unique-texts")
    edges = links(unique, texts, of_words, jaccard)
    ends = edges.select(F.col("a").alias("uid")).unionAll(edges.select(F.col("b").alias("uid"))).distinct()
    prints = per_doc.select(F.col("id.h1").alias("h1"), F.col("id.h2").alias("h2"), "fingerprint").distinct()
    of = small(stored(unique.select("uid", "h1", "h2").join(ends, "uid").join(prints, ["h1", "h2"]).select("uid", "fingerprint"), "linked-prints"))
    out = stored(edges.join(of.select(F.col("uid").alias("a"), F.col("fingerprint").alias("x")), "a").join(of.select(F.col("uid").alias("b"), F.col("fingerprint").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), "print-edges")
    for table in (flat, unique, edges):
        dropped(table)
    return out


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, shingle: int = 5, jaccard: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, a null id last; of rows equal in id and text one stays.

    Documents are linked if the fingerprints of their ``shingle``-word shingles differ in ``bits`` or fewer bits, or if
    their sets of five-word shingles have the similarity ``jaccard`` or more: at 0.8 fingerprints differ in about ten
    bits, which no tree prunes, so MinHash bands propose those pairs and the exact similarity decides. Null and empty
    texts are alike; texts under five words are one shingle. Rows go by their two keys, so the texts of those that stay
    are not compared, and shuffled once at most; very long texts are read whole; an empty table gives an empty result.
    """
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "k1", "k2", "h1", "h2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(id_col, text.alias("text"), *document_keys(id_col, text_col), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).select(order.alias("place"), "text", "h1", "h2")
    per_doc = stored(fingerprints(named, "place", "text", shingle), "fingerprints")
    found = stored(_named(per_doc, bits, _near_copies(named.select("h1", "h2", "text"), per_doc, jaccard)).withColumnRenamed("id", "place"), "kept-places")
    gone = stored(found.where(F.col("place") != F.col("component_id")).select("place.k1", "place.k2").distinct(), "near-copies")
    same = stored(found.where(F.col("place") == F.col("component_id")).groupBy("place.k1", "place.k2").count().where("count > 1").select("k1", "k2"), "equal-rows")
    left = keyed(docs, id_col, text_col).join(small(gone), ["k1", "k2"], "left_anti")
    if not same.isEmpty():
        left = left.join(small(same), ["k1", "k2"], "left_anti").unionAll(left.join(small(same), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return unkeyed(left, docs.columns)
