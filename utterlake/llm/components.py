"""Connected components of a graph held as an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.runtime import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b) that has a neighbour; component is the smallest node reachable.

    Each round every node points to the smallest of itself and its neighbours, pointers are doubled until all point to
    roots, and the edges between roots, distinct, are the next round's: at most half as many nodes are left, and a dense
    group is one node after one round. Tables stay distributed; the driver only learns whether one is empty.
    """
    left, labels = materialize(_ordered(edges, "a", "b"), "edges"), None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        held = root = materialize(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "roots")
        while True:
            above = root.select(F.col("node").alias("at"), F.col("root").alias("top"))
            step = materialize(root.join(above, F.col("root") == F.col("at")).select("node", F.col("root").alias("old"), F.col("top").alias("root")), "roots")
            discard(held)
            held, root = step, step.select("node", "root")
            if step.where("root <> old").isEmpty():
                break
        if labels is None:
            labels = materialize(root.select("node", F.col("root").alias("component")), "labels")
        else:
            newer = root.select(F.col("node").alias("at"), "root")
            older, labels = labels, materialize(labels.join(newer, F.col("component") == F.col("at"), "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
            discard(older)
        a, b = (root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")) for end in "ab")
        edges_before, left = left, materialize(_ordered(left.join(a, "a").join(b, "b"), "root_a", "root_b"), "edges")
        discard(held, edges_before)
        if left.isEmpty():
            return labels


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
