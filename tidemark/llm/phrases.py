"""Phrase collocations: n-gram counts from suffix arrays of shards, merged by key, and scored at their weakest cut.

Most phrases of a corpus occur once or twice. A first pass counts pairs of words by hashed buckets, and the second cuts
pieces at pairs that are too rare for any candidate before it sorts suffixes; no candidate is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored

#: Words that a task holds, about: the slice of texts that reaches it closes a shard, of the language with most of them.
#: More words combine more counts in a task and need more memory: about 15 bytes a word held, and 100 in the shard at work.
SHARD_WORDS = 1 << 21
#: Bytes of texts that are cut into words at once.
_SLICE = 8 << 20
#: Pairs of words are told apart by so many bits of a hash when rare ones are sought: 2^27 bits are 16 MB.
BUCKET_BITS = 27
#: Bits of a bitmap of Spark's.
_BLOCK_BITS = 15
#: Rows of a batch of counts.
_ROWS = 1 << 16
_LANG = "und"
#: Parts of a language's phrases that are ranked before their best are ranked together.
_PARTS = 64

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_GAP = np.isin(_BYTES, np.frombuffer(b" \t", np.uint8))
_BREAK = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_INSIDE = ~(_GAP | _BREAK)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words in a row, their lengths, whether a word begins a piece) of binary texts."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, bool)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]  # of texts that aren't empty
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    text = np.searchsorted(bounds, starts, side="right") - 1
    breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    opens = np.ones(len(starts), bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    return _LOWER[data[inside]], lengths, opens


def _sorted_suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP up to ``depth``): places in the order of the next ``depth`` words, none beyond a piece's end.

    ``ids`` are the words' numbers, ``left`` the words from each place to its piece's end. Ranks of runs of h words give
    those of 2h by one sort of pairs, until they cover ``depth``; suffixes equal so far stay in any order.
    """
    rank, h = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1, 1
    order = None
    while h < depth or order is None:
        beyond = np.zeros(len(ids), np.int64)
        beyond[:-h] = np.where(left[:-h] > h, rank[h:], 0)
        pair = rank * (int(rank.max(initial=0)) + 1) + beyond
        order = np.argsort(pair)
        placed = pair[order]
        new = np.ones(len(ids), np.int64)
        new[1:] = placed[1:] != placed[:-1]
        rank[order] = np.cumsum(new)
        h *= 2
    lcp, same = np.zeros(len(ids), np.int8), np.ones(max(len(ids) - 1, 0), bool)
    for d in range(depth):
        here = np.minimum(order + d, len(ids) - 1)
        same &= (left[order[1:]] > d) & (left[order[:-1]] > d) & (ids[here[1:]] == ids[here[:-1]])
        lcp[1:] += same
    return order, lcp


def _intervals(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different run of ``size`` words, how often it occurs): the LCP intervals of that depth."""
    edges = np.flatnonzero(lcp < size)
    counts = np.diff(np.append(edges, len(lcp)))
    places = order[edges]
    whole = left[places] >= size  # a run that is cut off by its piece's end is no phrase of this size
    return places[whole], counts[whole]


class _Shard:
    """Words gathered from texts of one language."""

    def __init__(self, lang: str) -> None:
        self.lang, self.n = lang, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: pa.Array) -> int:
        data, lengths, opens = _words(texts)
        self.parts.append((data, lengths.astype(np.int32), opens))
        self.n += len(lengths)
        return len(lengths)

    def numbered(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(words' numbers, the words numbered, whether a word begins a piece); parts are let go."""
        data, lengths, opens = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.cast(pa.binary()), opens


def _pair_buckets(number: np.ndarray, known: pa.Array, opens: np.ndarray, lang: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that follow another in their piece, the bucket of the language and the two words)."""
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, known.to_pylist()), np.uint64, len(known))
    firsts = (hashes + np.uint64(digest(lang))) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(~opens)
    x = firsts[number[at - 1]]
    x ^= hashes[number[at]]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(64 - bits)
    return at, x.astype(np.int32)


def _counts(shard: _Shard, depth: int, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the shard's phrases of up to ``depth`` words, and with an empty phrase the words in all.

    With ``pairs``, a bit for each bucket, pieces are cut between words whose pair's bit is off.
    """
    yield _batch(shard.lang, pa.array([b""], pa.binary()), np.array([shard.n]))
    if not shard.n:
        return
    number, known, opens = shard.numbered()
    times = np.bincount(number, minlength=len(known))
    for k in range(0, len(known), _ROWS):
        yield _batch(shard.lang, known[k : k + _ROWS], times[k : k + _ROWS])
    if pairs is not None:
        at, bucket = _pair_buckets(number, known, opens, shard.lang, len(pairs).bit_length() + 2)
        opens[at[(pairs[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 0]] = True
        del at, bucket
    follows = ~opens
    follows[:-1] |= ~opens[1:]  # or is followed: words alone in their piece are done
    number, opens = number[follows], opens[follows]
    if depth < 2 or not len(number):
        return
    ends = np.append(np.flatnonzero(opens)[1:], len(opens))
    left = (ends[np.cumsum(opens) - 1] - np.arange(len(opens))).astype(np.int32)
    order, lcp = _sorted_suffixes(number, left, depth)
    for size in range(2, depth + 1):
        places, times = _intervals(order, lcp, left, size)
        for k in range(0, len(places), _ROWS):
            some = places[k : k + _ROWS]
            phrase = pc.binary_join_element_wise(*(known.take(pa.array(number[some + d])) for d in range(size)), b" ")
            yield _batch(shard.lang, phrase, times[k : k + _ROWS])


def _batch(lang: str, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrase)), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[_Shard]:
    """Shards of (lang, text) rows; texts are cut into words a slice of a batch at a time. Once ``shard_words`` words are
    held, the language with most of them makes a shard."""
    held: dict[str, _Shard] = {}
    words = 0
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + _SLICE, side="right")) - 1)
            some = langs[at:upto]
            for lang in some.unique():
                shard = held.setdefault(lang.as_py(), _Shard(lang.as_py()))
                words += shard.add(texts[at:upto].filter(pc.equal(some, lang)))
            at = upto
            while words >= shard_words:
                largest = held.pop(max(held, key=lambda x: held[x].n))
                words -= largest.n
                yield largest
    yield from held.values()


def _given(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def frequent_pairs(docs: DataFrame, min_count: int, *, bucket_bits: int = BUCKET_BITS, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> np.ndarray:
    """A bit for each of 2^``bucket_bits`` buckets of pairs of words: on if its pairs occur ``min_count`` times together.

    A pair whose bit is off is rarer than that, and so is every phrase that holds it; a pair whose bit is on may be rare,
    the more so the more pairs there are. The bits take 16 MB whatever the input: they are all that reaches the driver.
    """

    if not _BLOCK_BITS <= bucket_bits < 31:
        raise ValueError(f"bucket_bits must lie between {_BLOCK_BITS} and 30, not {bucket_bits}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_words):
            bucket, times = np.unique(_pair_buckets(*shard.numbered(), shard.lang, bucket_bits)[1], return_counts=True)
            for k in range(0, len(bucket), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[k : k + _ROWS]), pa.array(times[k : k + _ROWS])], names=["bucket", "n"])

    found = _given(docs, lang_col, text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    block = F.shiftright("bucket", _BLOCK_BITS)
    # positions in a bitmap of Spark's begin at the lowest bit of the first byte
    bits = stored(found.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("bucket").bitwiseAND((1 << _BLOCK_BITS) - 1)).alias("bits")), "pair-bits")
    out = np.zeros(1 << (bucket_bits - 3), np.uint8)
    for row in bits.toLocalIterator():
        at = row["block"] << (_BLOCK_BITS - 3)
        out[at : at + (1 << (_BLOCK_BITS - 3))] = np.frombuffer(row["bits"], np.uint8)
    dropped(bits)
    return out


def phrase_counts(docs: DataFrame, *, max_words: int = 3, pairs: np.ndarray | None = None, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase binary, n): occurrences of each run of 1 to ``max_words`` words within pieces, overlaps included.

    A row with an empty phrase has a language's words. Texts are lower-cased in A-Z and split at ``.,;:!?`` and line
    ends into pieces, these at spaces and tabs into words. Each task gathers shards of its texts, numbers their words,
    sorts a suffix array of each and counts its LCP intervals; Spark adds the counts up by key. No text is shuffled.
    With ``pairs`` (:func:`frequent_pairs`) phrases that hold a pair whose bit is off are left out.
    """
    bits = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)  # 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_words):
            yield from _counts(shard, max_words, None if bits is None else bits.value)

    return _given(docs, lang_col, text_col).mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _split(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, min_words: int = 2, max_words: int = 3, min_count: int = 10, cover: int = 50, best: int | None = 2000, bucket_bits: int = BUCKET_BITS, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases (None: all) that stick together.

    Candidates have ``min_words`` to ``max_words`` words and occur ``min_count`` times (a) or more. Cut after k words, a
    candidate has the counts l and r of its parts and the score floor(1000000 a a / (l r)); the cut of the lowest score
    counts, of equal ones the first. A candidate goes if a longer candidate holds its words and occurs in ``cover`` of
    100 of its occurrences or more. The order is by score and a, both descending, and phrase. n counts the language's words.

    A null language is ``und``; null and empty texts have no words; repeated rows count again; texts of any length are
    taken whole. An empty table gives no rows; other columns are ignored. Arithmetic is exact, in decimals of 38 digits.
    """
    if not 2 <= min_words <= max_words or min_count < 1:
        raise ValueError("2 <= min_words <= max_words and min_count >= 1 are needed")
    columns = {"lang_col": lang_col, "text_col": text_col, "shard_words": shard_words}
    # a candidate's pairs are as frequent as it is: most phrases need never be told apart
    pairs = frequent_pairs(docs, min_count, bucket_bits=bucket_bits, **columns)
    counts = phrase_counts(docs, max_words=max_words, pairs=pairs, **columns)
    # parts of a candidate are as frequent as it is, so that all that is looked up below is here
    known = stored(counts.where((F.col("n") >= min_count) | (F.octet_length("phrase") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "n"), "phrases")
    words = _split(F.col("phrase"))
    found = known.where(F.size(words).between(min_words, max_words) & (F.col("phrase") != "")).select("lang", "phrase", F.col("n").alias("a"))
    parts = known.where(F.col("phrase") != "")

    cuts = found.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), 1, F.col("k")).alias("left"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)"), wide("l") * wide("r"))
    scored = both.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = found.where(F.size(words) > min_words)
    spans = F.flatten(F.transform(F.sequence(F.lit(min_words), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: _joined(F.col("w"), i, m))))
    inner = longer.select("lang", "a", words.alias("w")).select("lang", F.col("a").alias("held"), F.explode(spans).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.lit(100) * F.col("held") < F.lit(cover) * F.col("a")))

    totals = known.where(F.col("phrase") == "").select("lang", "n")
    rows = stored(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations")
    order = "score desc, a desc, phrase"
    if best is not None:  # first the best of each part, so that no task ranks all of a language's
        part = F.pmod(F.hash("phrase"), F.lit(_PARTS))
        rows = rows.withColumn("part", part).withColumn("rank", F.expr(f"row_number() over (partition by lang, part order by {order})")).where(F.col("rank") <= best).drop("part", "rank")
    ranked = rows.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang order by {order}) as bigint)"))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
