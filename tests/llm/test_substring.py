"""Removal of repeated windows against a count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, k1 long, kept string"


def expected(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ü x", "数"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared, edge, short = text(60), text(35), text(34)
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, text(20))]
    docs += [(10 + i, f"{text(rng.randrange(50))} {shared} {text(rng.randrange(50))}") for i in range(6)]
    docs += [(20 + i, f"{text(30)}\n{edge}\t{text(40)}") for i in range(2)] + [(30 + i, f"{text(30)} {short} {text(40)}") for i in range(2)]
    copy = text(90)
    docs += [(40, copy), (41, copy), (41, copy), (42, copy.replace(" ", "  ")), (43, copy + " end")]
    docs += [(50, f"{(own := text(50))} {text(10)} {own}"), (51, "a " * 120), (52, "a " * 34)]
    near = copy.split()
    near[45] = "changed"
    return [*docs, (60, " ".join(near)), (None, shared), (61, text(3000) + " " + edge)]


@pytest.mark.parametrize("window", [35, 20])
def test_same_as_counting_every_window(spark, window):
    docs = corpus()
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], SCHEMA).repartition(3)
    got = substring.remove_repeats(df, window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, window)


def test_texts_are_cut_and_the_rest_stays(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], SCHEMA)
    got = substring.without_repeats(df).collect()
    assert len(got) == len(docs) and {r["k1"] for r in got} == {7} and {r["kept"] for r in got} == {"x"}
    want = {key: sha for key, _, lost, sha in expected(docs) if lost}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    assert {r["doc_id"]: r["text"] for r in got}[4] == dict(docs)[4]


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
