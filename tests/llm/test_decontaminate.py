"""Containment of benchmark items against all pairs."""

import random
import re

import pytest

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "数学"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate([5, 6, 8, 9, 12, 15, 16, 17, 33, 60, 64, 65, 120])]
    items += [(50, "short one"), (51, None), (52, ""), (9, text(20)), (None, text(25)), (53, items[3][1]), (9, items[9][1])]
    docs = []
    for n, (_, item) in enumerate(items):
        words = (item or "").split()
        for k in (0, 1, 2):
            held = list(words)
            for at in range(k):
                if held:
                    held[(at * 9 + 4) % len(held)] = "changed"
            docs.append((100 * n + k, f"{text(200)} {' '.join(held).upper()}\n{text(100)}"))
    docs += [(7000, None), (7001, ""), (7002, "short one"), (7003, "a short one"), (None, items[5][1]), (7004, " ".join(items[12][1].split()[:100])), (101, docs[4][1])]
    return docs, items


@pytest.mark.parametrize("containment", [0.8, 0.5])
def test_same_as_all_pairs(spark, containment):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, item_id string, n_shared int").repartition(3)
    b = spark.createDataFrame([(*x, "a") for x in items], "item_id long, text string, doc_id string")
    got = [(r["id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontaminate.contaminated(d, b, containment).collect()]
    want = []
    for key, text in {(k, t) for k, t in docs}:
        own = shingles(text)
        want += [(key, i, len(own & s), len(s)) for i, t in set(items) if (s := shingles(t)) and len(own & s) >= containment * len(s) - 1e-9]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.without_contaminated(d, b, containment)
    bad = {(w[0]) for w in want}
    assert kept.columns == d.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((k for k, _ in docs if k not in bad), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(none, some).collect() == []
    assert decontaminate.contaminated(none.union(some), some.limit(0)).collect() == []
