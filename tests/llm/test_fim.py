"""Fill-in-the-middle against a plain version; texts come back exactly."""

import hashlib
import random
import re

import pytest

from tidemark.llm import fim

SCHEMA = "doc_id long, text string, n int, cut_at string, output long"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(key, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    rng = random.Random(6)
    alphabet = ["a", "bb", " ", "  ", "\n", "\t", "é", "数学", "\U0001f600", "\x0b\x0c", "\x1c", "\xa0", "<", ">", "P", "S>", "<P", "<M"]
    docs = [(i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(300)]
    docs += [(400 + i, t) for i, t in enumerate([None, "", " ", "word", " x ", "a<P>b", "<S>", "x <M>", "<p>", "é" * 3 + " ü"])]
    docs += [(420, "w " * 60_000), (420, "w " * 60_000), (420, "other"), (None, "no id at all"), (None, None), (-5, "minus five")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "c", 2) for d in docs], SCHEMA).repartition(3)


def test_digests_equal_a_plain_version(spark):
    docs = corpus()
    got = fim.digests(frame(spark, docs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = []
    for key, text in docs:
        n, form, p, m, out = plain(key, text)
        want.append((key, n, form, p, m, sha(out), sha(text or "")))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str) and {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_texts_and_the_way_back(spark):
    docs = corpus()
    made = fim.fill_in_middle(frame(spark, docs), rate=90, spm_rate=50)
    assert made.columns == ["doc_id", "text", "n", "cut_at", "output", "cut"]
    rows = made.collect()
    want = sorted(((k, *plain(k, t, 90, 50)) for k, t in docs), key=str)
    assert sorted(((r["doc_id"], *r["cut"], r["text"]) for r in rows), key=str) == want
    assert all((r["n"], r["cut_at"], r["output"]) == (1, "c", 2) for r in rows)
    back = fim.restore(made)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((k, t or "") for k, t in docs), key=str)


def test_other_sentinels_seed_and_rates(spark):
    docs = corpus()
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    made = fim.fill_in_middle(frame(spark, docs), rate=100, spm_rate=0, seed=7, sentinels=marks)
    assert {r["cut"]["form"] for r in made.collect()} == {"plain", "psm"}
    assert sorted(r["text"] for r in fim.restore(made, sentinels=marks).collect()) == sorted(t or "" for _, t in docs)
    assert {r["form"] for r in fim.digests(frame(spark, docs), rate=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "abc", "d"), ("xa", "ay", "z")):
        with pytest.raises(ValueError):
            fim.digests(frame(spark, docs), sentinels=bad)
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, docs), cut_col="n")


def test_rates_are_met(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('some words here ', id) as text")
    forms = {r["form"]: r["count"] for r in fim.digests(docs).groupBy("form").count().collect()}
    assert forms["plain"] == pytest.approx(2500, abs=150) and forms["spm"] == pytest.approx(2000, abs=150)


def test_empty_table(spark):
    empty = frame(spark, corpus()).limit(0)
    assert fim.digests(empty).collect() == [] and fim.fill_in_middle(empty).collect() == []
