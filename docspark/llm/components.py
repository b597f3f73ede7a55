"""Connected components of an undirected graph held as a DataFrame of edges.

Rounds of *large-star* and *small-star* steps: each is a minimum per node and a
join, so no neighbour list is ever collected, and the number of rounds grows with
the logarithm of the longest chain.  Every round is settled in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docspark.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges of integers to ``(node, root)`` rows, ``root`` the smallest node reachable.

    Nodes that are their own root, or have no edge, get no row.  No edges give no rows.
    """
    now = settle(edges.select("a", "b").filter("a <> b"), "edges")
    mark = None
    while True:
        now = settle(_small_star(_large_star(now)), "edges")
        # the steps only ever move edges towards smaller nodes; equal sums of both ends mean nothing moved
        new = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
