"""Pairs of near sets: MinHash bands, exact Jaccard similarity, and buckets of any size without all their pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.store import dropped, stored
from tidemark.llm.text import BROADCAST_ROWS, let, small

#: Minima of a text: a square of so many by so many. Each row and each column of it is a band.
SIDE = 6
BANDS = 2 * SIDE
#: Bucket size up to which every two texts of a bucket are paired.
SMALL = 4
#: Texts of a bucket up to which each may meet all others; a larger one is split by the rarest shingles of its texts.
LARGE = 256
#: Longs that hold the parity bits of a text's shingle set.
PARITY = 16
#: Characters worked on at once, so that their shingles stay in a core's cache.
_CHUNK = 1 << 15
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 32, (SIDE * SIDE, 2), np.uint32) | np.uint32(1)
#: Characters or words that a shingle runs on after its first one: shingles have five.
INTO = 4

#: Points, each in a sixty-fourth of its own, whose nearest shingle hashes are the minima of characters' bands.
_POINTS = [int(x) - (1 << 63) for x in (np.arange(SIDE * SIDE, dtype=np.uint64) * np.uint64(37) % np.uint64(64) << np.uint64(58)) | np.random.default_rng(7).integers(0, 1 << 58, SIDE * SIDE, np.uint64)]
#: Shingles of a text that one row of :func:`with_character_bands` holds.
_STEP = 8
#: Bytes of a character in UTF-32.
_WIDE = 4

#: From texts to the 64-bit hashes of all their shingles, text after text with repeats, and how many each has (one at least).
Shingler = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _rolled(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five codes of each text; ``counts[i] + INTO`` codes belong to text i."""
    places = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * INTO, counts)
    found = codes[: len(codes) - INTO].copy()
    for i in range(1, INTO + 1):
        found = found * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - INTO + i]
    found = found[places]
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        found = (found ^ (found >> np.uint64(shift))) * np.uint64(by)
    return found ^ (found >> np.uint64(32))


def of_characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A shingle at every character; a text of fewer is one shingle, filled up with a code that is no character."""
    full = [x if len(x) > INTO else x.ljust(INTO + 1, "\U0010ffff") for x in texts]
    codes = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.fromiter(map(len, full), np.int64, len(full)) - INTO
    return _rolled(codes, counts), counts


def _codes(text: Column) -> Column:
    """UTF-32 of a text, filled up to a shingle with bytes of no code."""
    missing = F.lit(_WIDE * (INTO + 1)) - _WIDE * F.length(text)
    return F.concat(F.encode(text, "UTF-32"), F.when(missing > 0, F.substring(F.lit(b"\xff" * _WIDE * (INTO + 1)), F.lit(1), missing)).otherwise(F.lit(b"")))


def _shingle(codes: Column, at: Column) -> Column:
    """Hash of the shingle whose first byte is the one at ``at``, from 1."""
    return F.xxhash64(F.substring(codes, at, F.lit(_WIDE * (INTO + 1))))


def _last(codes: Column) -> Column:
    return F.octet_length(codes) - (_WIDE * (INTO + 1) - 1)


def character_set(text: Column) -> Column:
    """The distinct 64-bit hashes of the shingles of :func:`of_characters`, in built-in functions."""
    return F.array_distinct(let(_codes(text), lambda c: F.transform(F.sequence(F.lit(1), _last(c), F.lit(_WIDE)), lambda at: _shingle(c, at))))


def of_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A shingle at every word, A-Z lower-cased; a text of fewer is one shingle, filled up with a code of no word."""
    tokens = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
    fill = [b"\xff"]
    full = [t if len(t) > INTO else t + fill * (INTO + 1 - len(t)) for t in tokens]
    counts = np.fromiter(map(len, full), np.int64, len(full)) - INTO
    digest = xxhash.xxh3_64_intdigest
    codes = np.fromiter((digest(w) for t in full for w in t), np.uint64, int(counts.sum()) + INTO * len(full))
    return _rolled(codes, counts), counts


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``_CHUNK`` characters; a longer one is alone."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if i > at and held + len(text) > _CHUNK:
            yield texts[at:i]
            at, held = i, 0
        held += max(len(text), INTO + 1)
    if texts:
        yield texts[at:]


def _sets(texts: list[str], shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted, as one array of 16 and 48 bits; at most 65,536 texts."""
    found, counts = shingler(texts)
    every = np.sort(np.repeat(np.arange(len(texts), dtype=np.uint64), counts) << np.uint64(48) | found >> np.uint64(16))
    every = every[np.concatenate(([True], every[1:] != every[:-1]))]
    return every, np.bincount((every >> np.uint64(48)).astype(np.int64), minlength=len(texts))


def band_hashes(texts: list[str], shingler: Shingler) -> np.ndarray:
    """(text, band): each band hashes the ``SIDE`` minima of a row or column, each under an order of its own.

    Two texts of Jaccard 0.8 share a row or a column with 95 %, of 0.85 with 99 %.
    """
    out = np.empty((len(texts), BANDS), np.int32)
    at = 0
    for some in _chunks(texts):
        found, counts = shingler(some)
        x, starts = (found >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], np.cumsum(counts)[:-1]))
        held = np.empty_like(x)
        mixed = np.zeros((BANDS, len(some)), np.uint64)
        for i, (add, by) in enumerate(_MULTIPLIERS):
            np.bitwise_xor(x, add, out=held)
            np.multiply(held, by, out=held)
            least = np.minimum.reduceat(held, starts)
            for band in (i // SIDE, SIDE + i % SIDE):
                mixed[band] = (mixed[band] ^ least) * np.uint64(0x9E3779B97F4A7C15)
                mixed[band] ^= mixed[band] >> np.uint64(32)
        out[at : at + len(some)] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32).T
        at += len(some)
    return out


def with_bands(texts: DataFrame, column: str, shingler: Shingler) -> DataFrame:
    """``texts`` with ``b0``, ``b1``, ... in place of ``column``."""
    kept = [f for f in texts.schema if f.name != column]
    names = [f.name for f in kept] + [f"b{i}" for i in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = band_hashes(batch.column(column).to_pylist(), shingler)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(BANDS))], names=names)

    return texts.mapInArrow(run, StructType([*kept, *(StructField(f"b{i}", IntegerType()) for i in range(BANDS))]))


#: Shinglers whose sets built-in functions make as well; for these, no Python runs on the executors.
BUILT_IN: dict[Shingler, Callable[[Column], Column]] = {of_characters: character_set}


def with_character_bands(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, b0, b1, ...) of the distinct texts (h1, h2, n, text), in built-in functions.

    A minimum is the shingle whose hash comes first once a point's bits are flipped in all of them, the nearest to that
    point: for each point, two sets agree with the probability of their similarity. The rows of a text lie in one task
    if ``lines`` are dealt by (h1, h2), and hold ``_STEP`` shingles each; the last one is repeated to fill the last row.
    """
    at, codes, last = F.col("at"), F.col("codes"), _last(F.col("codes"))
    rows = lines.select("h1", "h2", "n", _codes(F.col("text")).alias("codes")).select("h1", "h2", "n", "codes", F.explode(F.sequence(F.lit(1), last, F.lit(_WIDE * _STEP))).alias("at"))
    hashed = rows.select("h1", "h2", "n", *(_shingle(codes, F.least(at + _WIDE * j, last)).alias(f"s{j}") for j in range(_STEP)))
    minima = hashed.groupBy("h1", "h2", "n").agg(*(F.min(F.least(*(F.col(f"s{j}").bitwiseXOR(F.lit(p)) for j in range(_STEP)))).alias(f"m{i}") for i, p in enumerate(_POINTS)))
    square = [[SIDE * i + j for j in range(SIDE)] for i in range(SIDE)]
    return minima.select("h1", "h2", "n", *(F.hash(*(f"m{i}" for i in band)).alias(f"b{k}") for k, band in enumerate([*square, *zip(*square, strict=True)])))


def parities(every: np.ndarray, n_texts: int) -> np.ndarray:
    """(text, long): for each of 64 ``PARITY`` classes of shingles, whether a text of :func:`_sets` holds an odd number."""
    classes = np.uint64(64 * PARITY)
    met = np.bincount(((every >> np.uint64(48)) * classes + every % classes).astype(np.int64), minlength=n_texts * int(classes))
    return np.packbits(met.astype(np.uint8) & 1, bitorder="little").view(np.int64).reshape(n_texts, PARITY)


def _sizes(texts: DataFrame, shingler: Shingler) -> DataFrame:
    """(uid, len, x0, x1, ...) of (uid, text): the size of the shingle set and its parity bits. Two sets differ in at least
    as many elements as their bits differ."""
    names = ["len", *(f"x{k}" for k in range(PARITY))]
    if shingler in BUILT_IN:
        low = F.col("s").bitwiseAND(F.lit(64 * PARITY - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int"))
        each = _shingles(texts, shingler).select("uid", F.shiftright(low, 6).alias("word"), bit.alias("bit"))
        return each.groupBy("uid").agg(F.count("*").alias("len"), *(F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"x{k}") for k in range(PARITY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [np.empty(0, np.int64)], [np.empty((0, PARITY), np.int64)]
            for some in _chunks(batch.column("text").to_pylist()):
                every, n = _sets(some, shingler)
                bits.append(parities(every, len(some)))
                sizes.append(n)
            x = np.concatenate(bits)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(np.concatenate(sizes)), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(PARITY))], names=["uid", *names])

    return texts.select("uid", "text").mapInArrow(run, StructType([StructField(n, LongType()) for n in ["uid", *names]]))


def similarities(one: list[str], two: list[str], shingler: Shingler) -> np.ndarray:
    """Jaccard similarity of the shingle sets of one[i] and two[i]."""
    out, at = [np.empty(0)], 0
    while at < len(one):
        step, held = 1, len(one[at]) + len(two[at])
        while step < 256 and at + step < len(one) and (held := held + len(one[at + step]) + len(two[at + step])) <= 64 * _CHUNK:
            step += 1
        (x, n), (y, m) = _sets(one[at : at + step], shingler), _sets(two[at : at + step], shingler)
        both = np.sort(np.concatenate((x, y)))
        shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(n))
        out.append(shared / (n + m - shared))
        at += step
    return np.concatenate(out)


def _compared(pairs: DataFrame, shingler: Shingler) -> DataFrame:
    """(a, b, similarity) of (a, b, text_a, text_b)."""
    if built_in := BUILT_IN.get(shingler):
        sets = pairs.select("a", "b", built_in(F.col("text_a")).alias("x"), built_in(F.col("text_b")).alias("y"))
        counts = sets.select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.size(F.array_intersect("x", "y")).alias("shared"))
        return counts.select("a", "b", (F.col("shared") / (F.col("sum") - F.col("shared"))).alias("similarity"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = similarities(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), shingler)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def _shingles(texts: DataFrame, shingler: Shingler) -> DataFrame:
    """(uid, s) of the distinct shingles of (uid, text)."""
    if built_in := BUILT_IN.get(shingler):
        return texts.select("uid", F.explode(built_in(F.col("text"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, at = np.asarray(batch.column("uid")), 0
            for some in _chunks(batch.column("text").to_pylist()):
                every, n = _sets(some, shingler)
                hashes = (every & np.uint64((1 << 48) - 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uids[at : at + len(some)], n)), pa.array(hashes)], names=["uid", "s"])
                at += len(some)

    return texts.mapInArrow(run, "uid long, s long")


def rarest(texts: DataFrame, shingler: Shingler, jaccard: float) -> DataFrame:
    """(uid, s): as many of the rarest shingles of each of (uid, text) as two texts of that similarity must share one of.

    Such texts share ``jaccard`` of the larger set at least, so that the sets without all but one of these overlap. Any one
    order of the shingles gives this; the rarest first make few others meet. Frequent shingles, of which there are at most
    ``BROADCAST_ROWS`` as they hold that share of all, come last by count; the others by hash.
    """
    each = stored(_shingles(texts, shingler), "near-shingles")
    least = max(2, -(-each.count() // BROADCAST_ROWS))
    frequent = stored(each.groupBy("s").agg(F.count("*").alias("f")).where(F.col("f") >= least), "near-frequent")
    ranked = each.join(small(frequent), "s", "left").select("uid", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "s").alias("x"))
    kept = F.size("all") - F.ceil(F.size("all") * F.lit(jaccard) - F.lit(1e-9)).cast("int") + 1
    out = stored(ranked.groupBy("uid").agg(F.array_sort(F.collect_list("x")).alias("all")).select("uid", F.explode(F.slice("all", F.lit(1), kept)).alias("x")).select("uid", "x.s"), "near-rarest")
    dropped(each, frequent)
    return out


def _bands() -> Column:
    """A text's bands as longs, its number above each band's bits."""
    return F.array(*(F.shiftleft(F.lit(i).cast("bigint"), 32).bitwiseOR(F.col(f"b{i}").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))) for i in range(BANDS)))


def _pairs_of(lists: DataFrame) -> DataFrame:
    """(a, b) for every two of the sorted ``uids`` of a row; rows hold few."""
    each = lists.select("uids", F.posexplode("uids").alias("i", "a"))
    return each.select("a", F.explode(F.slice("uids", F.col("i") + 2, F.lit(SMALL))).alias("b"))


def links(unique: DataFrame, texts: DataFrame, shingler: Shingler, jaccard: float) -> DataFrame:
    """Edges (a, b) between the numbers ``uid`` of texts whose shingle sets have that Jaccard similarity or more; where the texts
    of a bucket are similar to one of them, only the edges to that one.

    ``unique``: a stored table of distinct texts (uid, h1, h2, n, b0, b1, ...): two hashes of the text, how often it
    occurs, and its bands. ``texts``: (h1, h2, text), which may hold others and repeats.

    Buckets of up to ``SMALL`` texts pair every two. In larger ones all texts meet the one that occurs most often, as
    copies with small changes do with their original. Pairs are then taken, in the first bucket they share, only of
    those that aren't similar to one same line, and that two bounds let be near: the triangle over the most frequent line
    and the differing parities of their sets. In buckets of over ``LARGE`` texts, as templates make them, pairs also share
    one of their rarest shingles (:func:`rarest`), which loses none that is similar. A text stands there once for all
    buckets of one most frequent line, and only with shingles that another text has among its rarest too.
    """
    banded = unique.select("uid", F.posexplode(_bands()).alias("at", "band"))
    sizes = stored(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("uid").alias("a"), F.max("uid").alias("b")).where("n > 1"), "near-bands")
    members = stored(banded.join(small(sizes.where("n > 2").select("band", "n")), "band"), "near-band-members")
    lists = members.where(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("uid")).alias("uids"))
    close = stored(sizes.where("n = 2").select("a", "b").unionAll(_pairs_of(lists)).distinct(), "near-close")
    wide = members.where(F.col("n") > SMALL).select("uid", "at", "band")

    named = close.select(F.col("a").alias("uid")).unionAll(close.select(F.col("b").alias("uid"))).select("uid", F.lit(0).alias("wide")).unionAll(wide.select("uid", F.lit(1)))
    wanted = stored(named.groupBy("uid").agg(F.max("wide").alias("wide")).join(unique.select("uid", "h1", "h2", F.col("n").alias("occurs"), _bands().alias("bands")), "uid"), "near-candidates")
    named = texts.select("h1", "h2", "text").join(small(wanted.select("uid", "h1", "h2", "wide")), ["h1", "h2"])
    sets = stored(named.groupBy("uid").agg(F.min("text").alias("text"), F.max("wide").alias("wide")), "near-sets")

    marks = wanted.where("wide = 1").select("uid", "occurs", "bands").join(_sizes(sets.where("wide = 1").select("uid", "text"), shingler), "uid")
    inside = stored(wide.join(marks, "uid"), "near-wide")
    heads = stored(inside.groupBy("band").agg(F.max_by("uid", F.struct("occurs", -F.col("uid"))).alias("head")), "near-heads")
    star = inside.select("uid", "band").join(small(heads), "band").where("uid <> head")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs with their similarity."""
        one = sets.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
        two = sets.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
        return _compared(pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b"), shingler)

    first = stored(verified(star.select(F.col("head").alias("a"), F.col("uid").alias("b"))), "near-star")
    under = first.where(F.col("similarity") >= jaccard).groupBy(F.col("b").alias("uid")).agg(F.min("a").alias("under"))
    placed = star.join(first.select(F.col("a").alias("head"), F.col("b").alias("uid"), "similarity"), ["head", "uid"]).select("band", "uid", "head", "similarity")
    around = stored(inside.join(placed, ["band", "uid"]).join(under, "uid", "left"), "near-around")
    made, slack = [], 1 - jaccard
    cell = F.floor((1 - F.col("similarity")) / slack)
    parity = [f"x{k}" for k in range(PARITY)]
    columns = ["uid", "at", "bands", "len", *parity, "similarity", "under"]
    large = stored(around.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("similarity") < jaccard).alias("apart")).where((F.col("n") > LARGE) & (F.col("apart") > 0)).select("band"), "near-large")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in parity))
    near = (F.abs(F.col("a.similarity") - F.col("b.similarity")) <= slack + 1e-9) & (differ <= (F.col("a.len") + F.col("b.len")) * F.lit(slack / (1 + jaccard) + 1e-9))
    apart = F.col("a.under").isNull() | F.col("b.under").isNull() | (F.col("a.under") != F.col("b.under"))
    once = (F.col("a.uid") < F.col("b.uid")) | ((F.col("a.uid") != F.col("b.uid")) & (F.col("b.similarity") >= jaccard))  # two that aren't similar to the head would come from both sides
    earlier = F.arrays_overlap(F.slice("a.bands", F.lit(1), F.col("a.at")), F.slice("b.bands", F.lit(1), F.col("b.at")))

    def met(rows: DataFrame, *keys: str) -> DataFrame:
        """Pairs of the rows, one of them not similar to its bucket's head, that share the keys and a bucket and lie in cells side by side."""
        here = rows.where(F.col("similarity") < jaccard).select(*keys, F.struct(*columns).alias("a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        there = rows.select(*keys, F.struct(*columns).alias("b"), cell.alias("cell"))
        both = here.join(there, [*keys, "cell"]).where(once & near & apart & ~F.coalesce(earlier, F.lit(False)))
        both = both if "band" in keys else both.where(F.arrays_overlap("a.bands", "b.bands"))
        return both.select(F.least("a.uid", "b.uid").alias("a"), F.greatest("a.uid", "b.uid").alias("b"))

    rest = met(around.join(small(large), "band", "left_anti"), "band")
    if not large.isEmpty():
        # a text stands here once for a head, not for each bucket of it; shingles that are one text's alone meet nothing
        split = stored(around.join(small(large), "band").drop("band").withColumn("at", F.lit(0)).dropDuplicates(["head", "uid"]), "near-split")
        rare = rarest(sets.join(split.select("uid").distinct(), "uid").select("uid", "text"), shingler, jaccard)
        common = stored(rare.groupBy("s").agg(F.count("*").alias("f")).where("f > 1").select("s"), "near-common")
        lists = stored(rare.join(small(common), "s", "left_semi").groupBy("uid").agg(F.collect_list("s").alias("all")), "near-shared")
        made += [split, rare, common, lists]
        rest = rest.unionAll(met(split.join(lists, "uid").withColumn("s", F.explode("all")).drop("all"), "head", "s"))
    found = stored(verified(close.unionAll(rest)), "near-pairs")
    edges = stored(first.unionAll(found).where(F.col("similarity") >= jaccard).select("a", "b"), "near-edges")
    for table in (sizes, members, close, wanted, sets, inside, heads, first, around, large, *made, found):
        dropped(table)
    return edges
