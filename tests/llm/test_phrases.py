"""Collocations against plain counting, and suffix arrays against plain sorting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n long, phrase string, rank int"


def plain_counts(docs, most=3):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts[lang].update(tuple(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    return counts, words


def plain(docs, least=10, most=3, best=2000, shortest=2, cover=50):
    counts, words = plain_counts(docs, most)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) >= shortest and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["The", "cat", "Éa", "éa", "数学", "x\xa0y", "of", "DOG", "\x00", "a-b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]) for _ in range(n))
    docs = [(text(rng.randrange(60)), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    docs += [("New York City", "en")] * 12 + [("new york", "en")] * 9 + [("old new york", "fr")] * 11 + [("a a a a a", "fr")] * 10
    docs += [(None, "en"), ("", "en"), (" \t\n", "en"), (None, None), (".,;:!?", "de"), ("z" * 70000, "en"), (text(20000), "long"), ("empty", "")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(3)


@pytest.mark.parametrize("shard_words", [phrases.SHARD_WORDS, 50])
def test_same_as_plain_counting(spark, shard_words):
    got = phrases.collocations(frame(spark, corpus()), shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == plain(corpus()) and {"en", "und", "long", "fr"} <= {r[0] for r in rows}


def test_longer_phrases_and_limits(spark):
    docs = corpus()
    got = phrases.collocations(frame(spark, docs), max_words=5, min_words=3, min_count=4, best=7, cover=30)
    assert sorted(map(tuple, got.collect())) == plain(docs, 4, 5, 7, 3, 30)
    every = phrases.collocations(frame(spark, docs), best=None).count()
    assert every == len(plain(docs, best=10**9))
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, docs), min_words=1)


def test_counts_of_every_run_of_words(spark):
    got = {(r["lang"], bytes(r["phrase"])): r["n"] for r in phrases.phrase_counts(frame(spark, corpus()), shard_words=200).collect()}
    counts, words = plain_counts(corpus())
    want = {(lang, " ".join(p).encode()): n for lang, f in counts.items() for p, n in f.items()}
    assert got == want | {(lang, b""): words[lang] for lang in words}


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = [("en", "a", 4 * 10**12), ("en", "b", 5 * 10**12), ("en", "a b", 3 * 10**12 + 1), ("en", "", 10**13)]

    def given(*_, **__):
        return spark.createDataFrame(counts, "lang string, phrase string, n long").withColumn("phrase", F.col("phrase").cast("binary"))

    monkeypatch.setattr(phrases, "phrase_counts", given)
    row = phrases.collocations(frame(spark, [])).first()
    assert row["score"] == 10**6 * (3 * 10**12 + 1) ** 2 // (20 * 10**24)


@pytest.mark.parametrize("bits", [15, 18])
def test_no_candidate_is_lost_when_buckets_are_crowded(spark, bits):
    rng = random.Random(1)
    docs = [(" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(300)), "en") for _ in range(80)]
    frame_ = frame(spark, docs)
    pairs = phrases.frequent_pairs(frame_, 10, bucket_bits=bits)
    assert len(pairs) == 1 << (bits - 3) and 0 < np.unpackbits(pairs).sum() < 1 << bits
    assert sorted(map(tuple, phrases.collocations(frame_, bucket_bits=bits).collect())) == plain(docs)
    known = {bytes(r["phrase"]) for r in phrases.phrase_counts(frame_, pairs=pairs).collect()}
    counts = plain_counts(docs)[0]["en"]
    assert {" ".join(p).encode() for p, n in counts.items() if n >= 10} <= known


def test_suffixes_are_sorted_and_their_prefixes_measured():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 300)
    opens = rng.random(300) < 0.1
    opens[0] = True
    ends = np.append(np.flatnonzero(opens)[1:], 300)
    left = ends[np.cumsum(opens) - 1] - np.arange(300)
    order, lcp = phrases._sorted_suffixes(ids, left, 5)
    seen = [tuple(ids[i : i + min(5, left[i])]) for i in order]
    assert sorted(order) == list(range(300)) and seen == sorted(seen)
    assert lcp[0] == 0 and [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(seen, seen[1:], strict=False)] == lcp[1:].tolist()


def test_words_of_sliced_arrays():
    texts = pa.array([b"skip. me", b"A b,", b"", b"c", b". d"], pa.binary())[1:]
    data, lengths, opens = phrases._words(texts)
    assert (bytes(data), lengths.tolist(), opens.tolist()) == (b"abcd", [1, 1, 1, 1], [True, False, True, True])


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, corpus()).limit(0)).collect() == []
