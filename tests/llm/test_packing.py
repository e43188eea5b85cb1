"""Packing: ids against the tokenizer on whole texts, places without gaps, few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 0]


ODD = ["it's They're a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ Σ é é x　y \x1cz 12ab", "a'b' 'S x.'s ..' _a_ ß ẞ ǅ µ ª 3.5", " \x0b\x0ca\t\r\n b", "́a é.", "数学。test Straße, É...", "", None, "x" * 5000]


def corpus():
    rng = random.Random(5)
    words = ["The", "étude", "Über", "word", "re%%%", "don't", "数学", "x", "antidis", "42"]
    texts = [*ODD, *(" ".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(80)), " ".join(rng.choices(words, k=9000))]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id"), (None, None)]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(spark, encode, capacity):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, piece string, length int").repartition(3)
    got = packing.best_fit_packing(df, tokenizer_path(), capacity).collect()
    want = []
    for key, text in docs:
        ids = encode(text)
        want += [(key, at // capacity, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for at in range(0, len(ids), capacity)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    gaps = []  # best-fit decreasing, one piece after the other
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - length)
    assert len(bins) <= len(gaps)


def test_words_are_let_go_and_learnt_again(encode):
    import pyarrow as pa

    words = packing.WordIds(tokenizer_path(), limit=20)
    for part in range(0, 90, 9):
        texts = [t for _, t in corpus()[part : part + 9]]
        ids, bounds = words(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encode(t)[:-1] for t in texts]


def test_best_fit_takes_the_smallest_gap_that_holds():
    placed = packing.best_fit({6: 1, 5: 1, 4: 1, 3: 1}, 10)  # 6 + 4 and 5 + 3
    assert len({m.bin for m in placed}) == 2


def test_empty_table(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
