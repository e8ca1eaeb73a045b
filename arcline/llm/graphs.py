"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Rounds of contraction: every node hooks onto its smallest neighbour if that is smaller, chains
    are followed by pointer jumping, and edges are rewritten between roots until none is left.
    Each round at least halves the nodes that still have edges, and aggregates before it shuffles.
    """
    pairs = saved(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    known = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = saved(parent.join(above, "root").select("node", "up", (F.col("up") != F.col("root")).alias("moved")))
            parent = jumped.select("node", F.col("up").alias("root"))
            if jumped.where("moved").isEmpty():
                break
        if known is None:
            known = parent
        else:
            after = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            moved = known.join(after, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            fresh = parent.join(known.select("node"), "node", "left_anti")
            known = saved(moved.unionByName(fresh))
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("y"))
        pairs = saved(
            pairs.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if known is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return known
