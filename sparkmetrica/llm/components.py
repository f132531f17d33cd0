"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.session import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; nodes are longs, all nodes of a component share a root.

    Rounds of contraction: every node follows the neighbour (or itself) with the
    smallest hash of this round, edges are rewritten to the nodes followed, loops and
    repeats go. A round leaves a constant share of the nodes on average, whatever the
    shape of the graph. Only the count of edges left reaches the driver. A node with
    very many neighbours costs no more: the smallest neighbour is an aggregate, and the
    joins have one row per key on one side, so Spark may split the other.
    """
    labels = None
    turn = 0
    edges = settle(edges.select("a", "b").where("a <> b").distinct())
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        follow = both.groupBy("node").agg(F.min(rank("near")).alias("best"))
        follow = settle(follow.select("node", F.least(rank("node"), F.col("best"))["n"].alias("to")))
        if labels is None:
            labels = settle(follow.select("node", F.col("to").alias("root")))
        else:
            step = follow.select(F.col("node").alias("root"), "to")
            before = labels
            labels = settle(before.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            discard(before)
        a = follow.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = follow.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y")
        moved = settle(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(edges, follow)
        edges = moved
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
