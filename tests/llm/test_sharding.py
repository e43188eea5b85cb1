"""Shards against the published algorithm, slots without gaps, and what moves when shards are appended."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, size int, shard string, at long"


def jump(key, n):
    k, b, j = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16), -1, 0
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def corpus():
    rng = random.Random(2)
    texts = ["", "a", "é数", "x" * 200_000, None, "same", " \n"]
    docs = [(rng.randrange(-50, 10**12), rng.choice(texts)) for _ in range(400)]
    return docs + [(7, "hot")] * 300 + [(7, f"hot {i}") for i in range(200)] + [(None, "x"), (None, "x"), (None, None)]


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "s", 3) for d in docs], SCHEMA).repartition(5)


@pytest.mark.parametrize("n", [1, 2, 24, 700])
def test_same_as_the_published_algorithm(spark, n):
    docs = corpus()
    got = sharding.shards(frame(spark, docs), n)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", jump(k, n), jump(k, n + 1)) for k, t in docs)
    assert Counter((*r[:5], r["grown_shard"]) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        by.setdefault(r["shard"], []).append((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])))
    assert all([s for s, _ in x] == list(range(len(x))) and [k for _, k in x] == sorted(k for _, k in x) for x in by.values())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(40000).select("id", sharding.shard_of(F.col("id"), 24).alias("a"), sharding.shard_of(F.col("id"), 25).alias("b"), sharding.shard_of(F.col("id"), 60).alias("c"))
    moved = keys.where("a <> b").agg(F.count("*"), F.min("b"), F.max("b")).first()
    assert moved[1:] == (24, 24) and moved[0] / 40000 == pytest.approx(1 / 25, rel=0.1)
    assert keys.where("a <> c and c < 24").isEmpty()
    sizes = [r["count"] for r in keys.groupBy("a").count().collect()]
    assert len(sizes) == 24 and max(abs(s - 40000 / 24) for s in sizes) < 5 * (40000 / 24) ** 0.5


def test_text_keys_and_files(spark, tmp_path):
    docs = frame(spark, corpus()).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string"))).withColumnRenamed("shard", "other")
    sharding.write_shards(docs, f"{tmp_path}/out", 6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert {(r[0], r[1]) for r in back.select("doc_id", "shard").collect()} == {(k, jump(k, 6)) for (k,) in docs.select("doc_id").collect()}
    moved = sharding.appended(back, 6, 8)
    assert {(r["doc_id"], r["new_shard"]) for r in moved.collect()} == {(k, jump(k, 8)) for (k,) in docs.select("doc_id").collect() if jump(k, 8) >= 6}
    with pytest.raises(ValueError):
        sharding.write_shards(back, f"{tmp_path}/again", 6)
    with pytest.raises(ValueError):
        sharding.appended(back, 6, 5)


def test_empty_table_and_no_shards(spark):
    assert sharding.shards(frame(spark, corpus()).limit(0), 24).collect() == []
    with pytest.raises(ValueError):
        sharding.shards(frame(spark, []), 0)


def test_plan_is_made_of_built_in_functions(spark):
    plan = sharding.shards(frame(spark, corpus()), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
