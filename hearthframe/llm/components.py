"""Connected components of an edge table, by alternating large and small stars.

Every round keeps the number of edges or lowers it, and no node ever gathers its
neighbours in one task: a round is a minimum per node (combined before the shuffle) and a join
that adaptive execution can split at hot nodes. Rounds are written with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u")
    moved = moved.filter(F.col("v") > F.col("u")) if large else moved
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node of its component.

    ``edges``: columns a, b of one orderable type without nulls.
    """
    checkpoint_ready(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    told = None
    for _ in range(rounds):
        now = _star(_star(now, True), False).checkpoint()
        # nothing moved: the same number of edges and the same sums of hashes
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == told or seen[0] == 0:
            break
        told = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


