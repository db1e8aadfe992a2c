"""Connected components by alternating star contractions.

Every round is a grouped minimum and an equality join; edges live in the shared folder
between rounds, so a lost executor costs one round at most. The number of rounds grows with
the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.session import durable


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of the edges: equal marks mean that nothing moved."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v")
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), u < v; root is the smallest node reachable.

    The root itself is listed too. No edges give no rows.
    """
    now = durable(edges.select("u", "v"))
    mark = _mark(now)
    while mark[0]:
        now = durable(_small_star(durable(_large_star(now))))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return (now.select(F.col("v").alias("node"), F.col("u").alias("root"))
            .unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct())
