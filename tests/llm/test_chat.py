"""Snapshots collapse to maximal conversations."""

import random

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n long, pos string"


def brute(turns):
    by = {}
    for c, t, r, x in set(turns):
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    seqs = {c: tuple((v[-2], v[-1]) for v in sorted(rows, key=lambda v: v[:6])) for c, rows in by.items()}
    out = []
    for s in set(seqs.values()):
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            text = "\n".join(f"<|{'unknown' if r is None else r}|>\n{x or ''}" for r, x in s)
            out.append((min(c for c, o in seqs.items() if o == s), len(s), text))
    return sorted(out)


def corpus():
    rng = random.Random(10)
    turns, conv = [], 0
    for _ in range(12):
        base = [(k % 2 and "assistant" or "user", f"text {rng.randrange(3)} {k}") for k in range(rng.randrange(1, 9))]
        for n in range(1, len(base) + 1):
            for _ in range(rng.randrange(1, 3)):
                turns += [(conv, 2 * k, *x) for k, x in enumerate(base[:n])]
                conv += 1
    turns += [(900, k, "user", f"long {k}") for k in range(700)] + [(901, k, "user", f"long {k}") for k in range(300)] + [(902, k, "user", f"long {k}" if k != 299 else "other") for k in range(300)]
    turns += [(903, None, None, None), (904, None, None, None), (904, 1, "user", ""), (905, 1, None, "x"), (905, 1, None, "x"), (906, 1, "user", "b"), (906, 1, "user", "a"), (None, 1, "user", "lost"), (907, 5, "user", "long 0"), (908, -3, "user", "m"), (908, 4, "user", "n")]
    return turns


def test_same_as_all_pairs(spark):
    turns = corpus()
    df = spark.createDataFrame([(*t, 1, "p") for t in turns], SCHEMA).repartition(3)
    got = sorted((r["conv_id"], r["n_turns"], r["rendered"]) for r in chat.render(df).collect())
    assert got == brute(turns)


def test_empty_table(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_a_missing_text_equals_no_text(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate([None, "", "\0", None])] + [(10, 0, None, "a"), (11, 0, "", "a"), (12, 0, "\0", "a")]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(r["conv_id"] for r in got) == [0, 1, 2, 10, 11, 12]
