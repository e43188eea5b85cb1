"""Connected components by alternating large-star and small-star rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored

#: Rounds grow with the logarithm of the longest path; this many means a defect, not a large input.
MAX_ROUNDS = 60


def _moved(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with the least of its ``u``. Both sides are plain exchanges, so that a hub's rows can be split over tasks."""
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node hang on the least of it and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = stored(_moved(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, hang on the least of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = _moved(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stored(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    dropped(least)
    return out


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node hangs directly on one root."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return seen.where("up > 1 or (up > 0 and root > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of at least one edge; the component is its smallest node.

    Edges with a null end and loops are left out. No node's neighbours are gathered: each round takes minima
    (combined before the shuffle) and joins them back, so a hub with a third of all edges stays spread out.
    Each round is written to the shared folder, which keeps the plan short and survives lost executors.
    """
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    now = stored(first, "edges")
    for _ in range(MAX_ROUNDS):
        if _is_forest(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        large = _large_star(now)
        after = _small_star(large)
        dropped(now)
        dropped(large)
        now = after
    raise RuntimeError("components did not settle")
