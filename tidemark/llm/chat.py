"""Chat formatting: cumulative snapshots collapse to maximal conversations before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored

#: Turns of a conversation that are numbered together; longer ones are numbered block by block.
BLOCK = 256
#: A turn's rendering; fixed values.
OPEN, CLOSE = "<|", "|>\n"


def _turn_hash(seed: int) -> Column:
    """Of a turn with its place: the XOR over turns 1..n then stands for the ordered prefix of n turns."""
    marked = [x for c in ("role", "text") for x in (F.isnull(c), F.coalesce(c, F.lit("")))]  # no text equals a missing one
    return F.xxhash64(F.lit(seed), "pos", *marked)


def prefixes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, pos, role, text, p1, p2): the turns numbered from 1, each with the 128-bit hash of the prefix it ends.

    Repeated rows are one turn. Turns are ordered by turn (nulls first), role and text. Windows run inside blocks of
    ``BLOCK`` turn numbers and over the block totals, so that a very long conversation is not one task's work.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col("role"), F.col("text")).distinct()
    blocked = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("id", "block").orderBy("turn", "role", "text")
    numbered = blocked.withColumn("at", F.row_number().over(inside))
    totals = blocked.groupBy("id", "block").count()
    before = totals.select("id", "block", F.coalesce(F.sum("count").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    same = [F.col("n.id").eqNullSafe(F.col("b.id")), F.col("n.block").eqNullSafe(F.col("b.block"))]
    placed = numbered.alias("n").join(before.alias("b"), same).select("n.id", "n.block", "n.role", "n.text", (F.col("at") + F.col("before")).alias("pos"))
    hashed = placed.withColumns({"t1": _turn_hash(1), "t2": _turn_hash(2)})

    running = Window.partitionBy("id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumns({"l1": F.bit_xor("t1").over(running), "l2": F.bit_xor("t2").over(running)})
    sums = hashed.groupBy("id", "block").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    earlier = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select("id", "block", *(F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))))
    both = local.alias("n").join(past.alias("b"), same)
    return both.select("n.id", "n.pos", "n.role", "n.text", F.col("l1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("l2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, pos, role, text) of the conversations that are no proper prefix of another; of equal ones the least id stays.

    Prefix hashes are compared by equality and anti-join; each distinct prefix is one row, however many conversations
    share it. Rows without an id form no conversation and are left out. An empty table gives no rows.
    """
    rows = stored(prefixes(turns.where(F.col(id_col).isNotNull()), id_col, turn_col), "prefixes")
    lengths = rows.groupBy("id").agg(F.max("pos").alias("n"))
    marked = rows.join(lengths, "id")
    whole = marked.where("pos = n").groupBy("pos", "p1", "p2").agg(F.min("id").alias("id"))
    proper = marked.where("pos < n").select("pos", "p1", "p2").distinct()
    kept = whole.join(proper, ["pos", "p1", "p2"], "left_anti").select("id")
    return rows.join(kept, "id", "left_semi").select("id", "pos", "role", "text")


def render(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, n_turns, rendered): each maximal conversation as one text, ``<|role|>`` before each turn's text.

    A null role is rendered as ``unknown``, a null text as empty. One conversation is one value, so its length is
    bounded by what a cell can hold. Repeated rows are one turn; turns that tie go by role and text; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(CLOSE), F.coalesce("text", F.lit("")))
    kept = maximal(turns, id_col, turn_col).select("id", "pos", line.alias("line"))
    per = kept.groupBy("id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return per.select(F.col("id").alias(id_col), "n_turns", F.concat_ws("\n", F.col("lines.line")).alias("rendered"))
