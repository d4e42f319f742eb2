"""Connected components of a graph of long ids, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.scratch import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node that are larger (large) or not larger than it at its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root): root is the least id reachable. Nodes without a link have no row.

    Alternates large and small stars until nothing changes; every round is a
    join of the edge list with one row a node, so no group meets in one task,
    and each round is written to the shared folder.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    last = None
    for _ in range(rounds):
        now = saved(_star(_star(now, True), False))
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"no fixed point within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
