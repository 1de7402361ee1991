"""Connected components of a graph whose edges are rows, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; nodes of a component share a root.

    In each round a node joins the neighbour with the smallest hash, itself included, under a hash
    of its own for the round, so that the graph shrinks geometrically whatever its shape. Edges,
    parents and labels stay in tables; the driver only learns whether edges are left. Tables are
    written between rounds, so both sides of every join are exchanges and hot nodes can be split.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    rounds = []
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("node", "near")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("node").agg(F.min(order("near")).alias("m"))
        parent = materialize(least.select("node", F.least("m", order("node"))["v"].alias("root")), "parents")
        rounds.append(parent)
        moved = edges.join(parent.toDF("a", "ra"), "a").join(parent.toDF("b", "rb"), "b").where("ra <> rb")
        edges = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0]
    for parent in rounds[1:]:
        step = parent.toDF("root", "above")
        labels = labels.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        labels = materialize(labels, "labels")
    return labels
