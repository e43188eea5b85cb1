"""The pipeline against brute-force versions of its stages, one after the other."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_decontaminate
import test_linededup
import test_simhash

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nter", "list", "mora", "vel", "ska")]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    text = lambda n: "\n".join(line(14) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate((12, 30, 60))]
    docs = [(i, text(8)) for i in range(30)]
    docs += [(100, docs[3][1]), (101, docs[4][1].replace(" ", "  ", 3)), (102, docs[5][1] + "\n" + line(3))]
    same = docs[6][1].split()  # the same words in lines of other lengths
    docs += [(103, "\n".join(" ".join(same[i : i + 5]) for i in range(0, len(same), 5)))]
    docs += [(200 + i, f"{text(3)}\n{line(6)} {item} {line(6)}\n{text(3)}") for i, item in items]
    docs += [(300, "Home | About | Contact | Login\n" + text(5)), (301, "\n".join(f"Menu {i} | Item {i} | More {i} | Sub {i}" for i in range(20))), (302, "too short"), (303, None), (304, ""), (305, "again and " * 40)]
    rng.shuffle(docs)
    return docs, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = corpus()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", f"src{(k or 0) % 3}", len(t or "")) for k, t in docs], SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_equal_brute_force(spark, folder):
    _, items = corpus()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, given = docs.columns, pairs(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        got = pairs(docs)
        if name == "quality_rules":
            assert {i for i, _ in got} == {i for i, _ in given if i < 301} and dict(got)[300] == dict(given)[300].split("\n", 1)[1]
        elif name == "line_dedup":
            lost, _ = test_linededup.brute(given)
            want = {(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in lost)) for i, t in given}
            assert set(got) == want and lost
        elif name == "near_dedup":
            group = test_simhash.near_groups(given)
            least = {g: min(d[0] for d, h in zip(given, group, strict=True) if h == g) for g in group}
            assert sorted(got) == sorted(d for d, g in zip(given, group, strict=True) if d[0] == least[g]) and len(got) < len(given)
        else:
            bad = {i for i, t in given for _, x in items if (s := test_decontaminate.shingles(x)) and len(s & test_decontaminate.shingles(t)) >= 0.8 * len(s)}
            assert sorted(got) == sorted(d for d in given if d[0] not in bad) and bad == {200, 201, 202}
        given = got


def test_run_packs_what_is_left(spark, folder):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs(docs)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["length"] for r in got) == sum(want.values()) and {r["doc_id"] for r in got} == set(want)


def test_other_columns_and_odd_rows_pass(spark, folder):
    odd = [(None, None, 1), (None, "x y z " * 10, 2), (7, "", 3), (7, " ".join(f"w{i}" for i in range(3000)), 4), (7, " ".join(f"w{i}" for i in range(3000)), 4)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, k1 long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "k1"]
    assert [r["k1"] for r in docs.collect()] == [4]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_quality_is_the_first_stage_and_keeps_clean_documents(spark, folder):
    docs, _ = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs if i < 30], SCHEMA)
    assert sorted(pairs(quality.keep_good(df))) == sorted(d for d in docs if d[0] < 30)
