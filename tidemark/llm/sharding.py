"""Shards by jump consistent hashing: a key and the number of shards decide, and no table of ring points is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored
from tidemark.llm.text import let, small

# Fixed values of the published algorithm: its generator's multiplier, modulus 2^64, and the bits of it that make a draw.
_MULTIPLIER = 2862933555777941757
_MODULUS = 1 << 64
_LOW_BITS, _DRAW = 1 << 33, float(1 << 31)
#: A key jumps about ln(n) times on its way to n shards. Stopping here leaves uneven shards with a chance under 1e-50;
#: a key stopped early stays where it is as shards are added, so the law holds even then.
MAX_JUMPS = 160


def _decimal(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def stable_key(key: Column) -> Column:
    """The upper half of the MD5 of the key's text as an unsigned 64-bit number; of a null key that of no text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def _jumps(key: Column, n_shards: int) -> Column:
    """(k, b, j): the last shard ``b`` under ``n_shards`` that the key jumps to, and ``j``, the first one beyond it."""

    def jump(at: Column) -> Column:
        # products pass 64 bits, where bigint would overflow
        following = (at["k"] * _decimal(_MULTIPLIER) + 1) % _decimal(_MODULUS)
        draw = lambda k: F.call_function("div", k, _decimal(_LOW_BITS)).cast("double") + 1.0
        far = lambda k: F.floor((at["j"] + 1).cast("double") * (F.lit(_DRAW) / draw(k)))
        return let(following.cast("decimal(20,0)"), lambda k: F.struct(k.alias("k"), at["j"].alias("b"), far(k).cast("bigint").alias("j")))

    first = F.struct(key.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    steps = F.sequence(F.lit(1), F.lit(min(n_shards, MAX_JUMPS)))
    return F.aggregate(steps, first, lambda at, _: F.when(at["j"] < n_shards, jump(at)).otherwise(at))


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard, from 0, of a key among ``n_shards``. With more shards a key stays or goes to one of the new ones."""
    if n_shards < 1:
        raise ValueError(f"at least one shard is needed, not {n_shards}")
    return _jumps(stable_key(key), n_shards)["b"].cast("int")


def shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``; the law is always ``key``.

    ``size`` is the UTF-8 bytes of the text and 8 more; a null text counts as empty. ``slot`` numbers a shard's rows
    from 0 in the order of id (nulls first), checksum and size; rows equal in these are alike and take the next slots in
    any order. ``grown_shard`` is the shard once there is one more. The key alone decides, so rows of one id share a
    shard, whatever their texts, and rows of equal texts need not. Texts of any length are read where they lie and
    never shuffled. An empty table gives no rows; other columns are ignored.

    Rows are range-sorted by shard, id and place, so that an id or a shard with a third of all rows is spread over
    tasks; a row's slot follows from its place in its sorted part and the parts' counts, a row for each shard in a part.
    """
    if n_shards < 1:
        raise ValueError(f"at least one shard is needed, not {n_shards}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("crc"), _jumps(stable_key(F.col(id_col)), n_shards).alias("at"))
    beyond = F.when(F.col("at.j") == n_shards, n_shards).otherwise(F.col("at.b")).cast("int")
    cut = rows.select("id", "size", "crc", F.col("at.b").cast("int").alias("shard"), beyond.alias("grown"), F.monotonically_increasing_id().alias("place"))
    placed = stored(cut, "shard-rows")
    order = ["shard", "id", "crc", "size", "place"]
    ranged = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place").withColumn("at", F.monotonically_increasing_id()), "sorted-shards")
    dropped(placed)

    part = F.shiftright("at", 33)
    runs = ranged.groupBy("shard", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.expr("sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding)")
    starts = stored(runs.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "shard-starts")
    found = ranged.withColumn("part", part).join(small(starts), ["shard", "part"])
    return found.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.col("grown").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Write every column of ``docs`` under ``path``, a folder for each shard; large shards get several files.

    A column named ``shard_col`` must not be there yet.
    """
    if shard_col in docs.columns:
        raise ValueError(f"docs have a column {shard_col} already; name another shard_col")
    docs.withColumn(shard_col, shard_of(F.col(f"`{id_col}`"), n_shards)).hint("rebalance", shard_col).write.partitionBy(shard_col).parquet(path)


def appended(sharded: DataFrame, n_shards: int, n_grown: int, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """The rows of ``sharded`` that go elsewhere as ``n_shards`` grow to ``n_grown``, with ``new_shard``.

    All go to shards numbered ``n_shards`` and up; the rest, ``n_shards / n_grown`` of all, need not be read again.
    """
    if n_grown < n_shards:
        raise ValueError("shards can only be appended")
    moved = sharded.withColumn("new_shard", shard_of(F.col(f"`{id_col}`"), n_grown))
    return moved.where(F.col("new_shard") >= n_shards)
