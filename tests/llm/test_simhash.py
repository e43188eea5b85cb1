"""Fingerprints and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, k1 long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_groups(docs):
    """By five-word fingerprints, or a similarity of 0.8 of the sets of five-word shingles."""
    return components([brute_print(t, 5) for _, t in docs], sets=[five_words(t) for _, t in docs])


def components(prints, bits=3, sets=None):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits or (sets and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def corpus():
    rng = random.Random(1)
    vocabulary = [f"Word{i}" for i in range(60)] + ["É", "数学", "x\x1cy"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 200)))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " end") for i in range(40)] + [(200 + i, docs[i][1].upper()) for i in range(5)]
    return [*docs, (300, None), (301, ""), (302, " \n"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (None, "only here, a text without id")]


def test_same_as_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    prints = [brute_print(t) for _, t in docs]
    group = components(prints)
    least = {g: min((d[0] for d, h in zip(docs, group, strict=True) if h == g and d[0] is not None), default=None) for g in group}
    want = sorted(((d[0], p, least[g]) for d, p, g in zip(docs, prints, group, strict=True)), key=str)
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("shard", [16, 4096])
def test_no_link_is_lost_at_shard_bounds(spark, shard):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.int64)
    flips = [np.bitwise_xor.reduce([np.int64(1 << int(b)) for b in rng.choice(63, k, replace=False)]) for k in rng.integers(1, 6, 400)]
    values = sorted({*base.tolist(), *(base ^ np.array(flips)).tolist()})
    table = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    edges = simhash.hamming_links(table, sample=200, shard=shard, block=64).collect()
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        assert (a ^ b).bit_count() <= 3
        root[find(a)] = find(b)
    want = components(values)
    assert len({find(v) for v in values}) == len(set(want))


def test_one_of_each_stays(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    got = simhash.keep_one_each(df)
    assert got.columns == df.columns
    group = near_groups(docs)
    kept = [(r["doc_id"], r["text"], r["fingerprint"], r["k1"]) for r in got.collect()]
    assert len(kept) == len(set(group)) and all(k[2:] == ("x", 1) for k in kept)
    for g in set(group):
        inside = [d for d, h in zip(docs, group, strict=True) if h == g]
        ids = [d[0] for d in inside if d[0] is not None]
        assert sum((k[0], k[1]) in inside and (not ids or k[0] == min(ids)) for k in kept) == 1


def test_near_copies_of_all_edit_rates_go(spark):
    """Copies with one to six words in a hundred changed: those of a similarity of 0.8 or more, as found by all pairs."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    docs = []
    for i in range(80):
        words = rng.choices(vocabulary, k=200)
        docs.append((i, " ".join(words)))
        for at in rng.sample(range(200), rng.randint(1, 6)):
            words[at] = rng.choice(vocabulary)
        docs.append((1000 + i, " ".join(words)))
    kept = {r["doc_id"] for r in simhash.keep_one_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    group = near_groups(docs)
    least = {g: min(d[0] for d, h in zip(docs, group, strict=True) if h == g) for g in group}
    want = {d[0] for d, g in zip(docs, group, strict=True) if d[0] != least[g]}
    gone = {d[0] for d in docs} - kept
    assert gone <= want and len(gone) >= 0.95 * len(want) > 50


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one_each(none).collect() == []
