"""Quality counts against plain Python."""

import random
import re
from collections import Counter

from tidemark.llm import quality

SCHEMA = "doc_id long, text string, kept string, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def corpus():
    rng = random.Random(9)
    words = ["a", "b", "cc", "été", "😀", "#x", "|", "<b>", "word", "y", "z!!"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(1, 120)))) for i in range(80)]
    wide = [f"w{i}" for i in range(500)]
    docs += [(100 + i, "\n".join(" ".join(rng.choices(wide, k=12)) for _ in range(10))) for i in range(20)]
    line = " ".join(wide[:12])
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "a b c d e a b c d e"), (204, " ".join(["a"] * 30)), (205, "w " * 9), (206, " ".join(wide)), (207, "\r\n".join([line, "Home | About | Contact", line, line])), (208, line + "\x1c \x85 z")]
    return [*docs, (None, line), (5, docs[5][1])]


def test_counts(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    got = quality.assess(df.select("doc_id", "text")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=str) == sorted(((k, *counts(t)) for k, t in docs), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert all(r["kept"] for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 120)


def test_bad_lines_go_and_clean_documents_stay_whole(spark):
    wide = [f"w{i}" for i in range(60)]
    lines = [" ".join(wide[i : i + 12]) for i in range(0, 60, 12)]
    good, mixed = "\n".join(lines), "\n".join([lines[0], "Home | About | Contact | Login", "###$$$%%%&&&", lines[1], "", "Cookie policy"])
    bad = "\n".join([lines[0], *(f"Menu {i} | Item {i} | More {i} | Sub {i}" for i in range(30))])
    df = spark.createDataFrame([(1, good, "k", 5), (2, mixed, "k", 5), (3, bad, "k", 5), (4, None, "k", 5)], SCHEMA)
    got = {r["doc_id"]: r for r in quality.keep_good(df).collect()}
    assert set(got) == {1, 2} and got[1]["text"] == good and got[2]["text"] == "\n".join([lines[0], lines[1], ""])
    assert got[1]["kept"] == "k" and got[1]["n_words"] == 5


def test_empty_table(spark):
    assert quality.assess(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts_and_odd_names(spark):
    long = "\n".join(" ".join(f"v{i * 9 + k}" for k in range(9)) for i in range(30_000))
    one_line = " ".join(f"w{i}" for i in range(200_000))
    docs = [(1, long, "a", 1), (2, one_line, "b", 2), (3, "Impressum\n" + " ".join(f"wort{i}" for i in range(40)), "c", 3), (4, None, "d", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, `a.b` string, kept long")
    got = {r["doc_id"]: r for r in quality.keep_good(df).collect()}
    assert set(got) == {1, 2, 3} and got[1]["text"] == long and got[2]["text"] == one_line and got[3]["text"].startswith("wort0")
    assert [(r["a.b"], r["kept"]) for r in got.values()] == [("a", 1), ("b", 2), ("c", 3)]
    counted = {r["doc_id"]: r["n_words"] for r in quality.assess(df).collect()}
    assert counted == {1: len(long.split()), 2: 200_000, 3: 41, 4: 0}
