"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored

#: Parts of words that a worker keeps the ids of, and the text tokenized together, in bytes.
CACHE_WORDS, CHUNK = 600_000, 8_000_000


class Match(NamedTuple):
    """Pieces ``rank .. rank + count - 1`` of one length go to bins ``bin, bin + 1, ...`` at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Match]:
    """Best-fit decreasing over size classes: what each length's ranked pieces are matched to.

    Lengths go from large to small. Each takes the smallest open gap that holds it (its successor among the gaps),
    a whole run of bins at a time; conflicts are settled by rank; the bins move on to their new gap; what finds no gap
    opens bins. The table has at most ``capacity`` lengths and ``capacity`` gaps, whatever the number of pieces.
    """
    runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    gaps: list[int] = []
    out: list[Match] = []
    opened = 0

    def freed(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, n))

    def fill(length: int, rank: int, pieces: int, gap: int, first: int, n: int) -> None:
        """``pieces`` go to the ``n`` bins from ``first``, as many to each as fit; the last may get fewer."""
        each = gap // length
        full, rest = divmod(pieces, each)
        for layer in range(each):
            if full:
                out.append(Match(length, rank + layer * full, full, first, capacity - gap + layer * length))
        freed(gap - each * length, first, full)
        for layer in range(rest):
            out.append(Match(length, rank + each * full + layer, 1, first + full, capacity - gap + layer * length))
        if rest:
            freed(gap - rest * length, first + full, 1)
        used = full + (rest > 0)
        freed(gap, first + used, n - used)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                n = -(-left // (capacity // length))
                fill(length, rank, left, capacity, opened, n)
                opened += n
                break
            gap = gaps[at]
            first, n = runs[gap].popleft()
            if not runs[gap]:
                gaps.pop(at)
            took = min(left, n * (gap // length))
            fill(length, rank, took, gap, first, n)
            rank, left = rank + took, left - took
    return out


class WordIds:
    """The ids of texts, from a tokenizer that drops white space and never joins across it: those of the words in order.

    Most words are Latin letters with or without ASCII marks behind: the tokenizer lower-cases such a word and cuts it
    between letters and marks, and nothing else. Those two parts go many at a time to a copy of the tokenizer without
    the general steps, and the last token of a part, known by its ending, shows where the next one starts. All other
    words go to the whole tokenizer. Found parts are kept; past ``limit`` of them those met once only are let go.
    """

    SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]{1,200})(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.bare, self.limit = Tokenizer.from_file(path), Tokenizer.from_file(path), limit
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocabulary = getattr(self.whole.model, "end_of_word_suffix", None), self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.is_part = re.compile(self.SIMPLE.replace("*)$", "*)$|^[!-&(-/:-@\\[-`{-~]+$")).match
        self.index, self.flat = {"": 0}, np.zeros(0, "<u4")
        self.start, self.size, self.met = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 2)
        self.simple = bool(suffix) and self._agree()

    def _agree(self) -> bool:
        """Whether this tokenizer does treat simple words so; one that doesn't gets all words whole."""
        sample = [("The", ""), ("Überß", ""), ("éa", ","), ("x", "..."), ("word", ".***")]
        bare = lambda part: self.bare.encode(part, add_special_tokens=False).ids
        return all(self.whole.encode(a + b, add_special_tokens=False).ids == bare(a.lower()) + bare(b) for a, b in sample)

    def _learn(self, parts: list[str]) -> None:
        easy, rest = [], []
        for part in parts:
            (easy if self.simple and self.is_part(part) else rest).append(part)
        groups = [easy[i : i + 64] for i in range(0, len(easy), 64)]
        got = [e.ids for e in self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)]
        got += [e.ids for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), "<u4")
        n_easy = sum(map(len, got[: len(groups)]))
        ends = np.concatenate((np.nonzero(self.last[ids[:n_easy]])[0] + 1, n_easy + np.cumsum([len(x) for x in got[len(groups) :]], dtype=np.int64)))
        begins = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
        self.index.update(zip([*easy, *rest], range(len(self.start), len(self.start) + len(ends)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + begins))
        self.size = np.concatenate((self.size, ends - begins))
        self.met = np.concatenate((self.met, np.zeros(len(ends), np.int64)))
        self.flat = np.concatenate((self.flat, ids))

    def _forget(self) -> None:
        keep = self.met > 1
        if keep.sum() > self.limit // 2:
            keep[1:] = False
        names = [name for name, kept in zip(self.index, keep.tolist(), strict=True) if kept]
        size = self.size[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[keep] - ends + size, size) + np.arange(size.sum())]
        self.index, self.start, self.size, self.met = dict(zip(names, range(len(names)), strict=True)), ends - size, size, np.full(len(names), 2)

    def _places(self, words: pa.Array) -> np.ndarray:
        """The place of each word's two parts among the known ones; what isn't known yet is learnt."""
        if not self.simple:
            parts = [words, pa.array([""]).take(pa.array(np.zeros(len(words), np.int64)))]
        else:
            found = pc.extract_regex(words, self.SIMPLE)
            parts = [pc.if_else(found.is_valid(), pc.utf8_lower(found.field("letters")), words), pc.if_else(found.is_valid(), found.field("marks"), "")]
        out = []
        for coded in (p.dictionary_encode() for p in parts):
            names = coded.dictionary.to_pylist()
            if missing := [n for n in names if n not in self.index]:
                self._learn(missing)
            at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
            self.met[at] += 1
            out.append(at[coded.indices.to_numpy()])
        return np.stack(out, axis=1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and where each text's begin and the last one's end; a null is an empty text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        if len(self.index) > self.limit:
            self._forget()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()].ravel()
        size = self.size[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHUNK`` bytes of text, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, side="right")))
        yield batch.slice(low, high - low)
        low = high


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids plus ``end_id``, cut every ``capacity`` ids.

    A null text counts as empty: one piece with ``end_id`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in _slices(whole, 1):
                ids, bounds = tokens(batch.column(1))
                n = np.diff(bounds) + 1  # with the end id
                cut = -(-n // capacity)
                row = np.repeat(np.arange(batch.num_rows), cut)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cut) - cut, cut)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                data, low = ids.tobytes(), 4 * (bounds[row] + start)
                high = np.minimum(low + 4 * length, 4 * bounds[row + 1])
                crc = [zlib.crc32(data[a:b]) if b - a == 4 * k else zlib.crc32(end, zlib.crc32(data[a:b])) for a, b, k in zip(low.tolist(), high.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` with (sequence_id, offset): its rows of length 1 to ``capacity`` packed into few sequences, without gaps.

    ``cut`` has ``id``, ``piece`` and ``length``. Pieces are range-sorted by length and id, so that a length shared by a
    third of all rows is spread over tasks; a piece's rank within its length follows from its place in the sorted table
    and the partitions' row counts. Only the number of pieces of each length (at most ``capacity`` numbers) and of each
    partition reach the driver, and the matches of :func:`best_fit` go back to the tasks.
    """
    order = ["length", "id", "piece", "start", "ids_crc32"]
    sorted_ = cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranked = stored(sorted_, "sorted-pieces")
    part = F.shiftright("_at", 33)
    sizes = {r[0]: r[1] for r in ranked.groupBy(part.alias("p")).count().collect()}
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}
    parts = sorted(sizes)
    before = np.concatenate(([0], np.cumsum([sizes[p] for p in parts])))[:-1].astype(np.int64)
    offset_of = np.zeros(parts[-1] + 1 if parts else 1, np.int64)
    offset_of[parts] = before
    below = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        below[length + 1] = n
    below = np.cumsum(below)
    found = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, 5)
    keys = (found[:, 0] << 44) + found[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, length = batch.column("_at").to_numpy(), batch.column("length").to_numpy()
            rank = offset_of[at >> 33] + (at & ((1 << 33) - 1)) - below[length]
            m = found[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            columns = [batch.column(n) for n in batch.schema.names if n != "_at"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(m[:, 3] + rank - m[:, 1]), pa.array(m[:, 4])], names=[*(n for n in batch.schema.names if n != "_at"), "sequence_id", "offset"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{given}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    Null and empty texts are one piece of length 1; texts of any length are taken whole, by the task that has the row;
    repeated rows are packed each; a null id stays null; an empty table
    gives no rows; other columns are ignored. Ties are ordered by id, piece and content.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    packed = pack(cut, capacity).withColumnRenamed("id", id_col)
    dropped(cut)  # its rows are in the sorted table
    return packed
