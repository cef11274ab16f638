"""Groups of nodes that share members: star contraction over a table of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready


def groups_of(members: DataFrame, node: str, group: str) -> DataFrame:
    """(node, root): nodes joined through shared groups get their component's least node.

    A group's members point at its least one, so no group is spread out as pairs. Then every node with the
    nodes it points at, or is pointed at from, is hung on the least of them, in turns with larger
    nodes (large star) and smaller ones (small star) moving. The edges never grow in number and chains
    halve, so rounds are logarithmic in the longest chain. Rounds are checkpointed. Null nodes and groups join nothing.
    """
    checkpoint_ready(members.sparkSession)
    pairs = members.select(F.col(node).alias("node"), F.col(group).alias("g")).filter("node IS NOT NULL AND g IS NOT NULL").distinct().checkpoint()
    least = pairs.groupBy("g").agg(F.min("node").alias("low"))
    links = pairs.join(least, "g").filter("node <> low").select(F.col("node").alias("high"), "low").distinct().checkpoint()
    state = None
    while True:
        links = _hang(_hang(links, both_ways=True), both_ways=False).checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
    return pairs.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _hang(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links (high, low): each centre's neighbours hung on its least neighbour, or on itself where it is less.

    ``both_ways``: centres see all neighbours and move the larger ones; else they see the smaller ones and move these and themselves.
    """
    seen = links.select(F.col("high").alias("centre"), F.col("low").alias("other"))
    if both_ways:
        seen = seen.unionByName(links.select(F.col("low").alias("centre"), F.col("high").alias("other")))
    hook = seen.groupBy("centre").agg(F.least(F.min("other"), F.col("centre")).alias("hook"))
    moved = seen.join(hook, "centre")
    if both_ways:
        out = moved.filter(F.col("other") > F.col("centre")).select(F.col("other").alias("high"), F.col("hook").alias("low"))
    else:
        out = moved.select(F.col("other").alias("high"), F.col("hook").alias("low")).unionByName(hook.select(F.col("centre").alias("high"), F.col("hook").alias("low")))
    return out.filter("high <> low").distinct()
