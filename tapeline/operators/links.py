"""Linked sets over pairs of keys: minimum labels with pointer jumping, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.scratch import Scratch


def linked_sets(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node that each of ``nodes`` is linked to by ``pairs`` (a, b), its own if by none.

    Minima combine on the map side, so a node with very many links is no burden on one task. Ends when no label changes;
    pairs may be repeated, reversed or loops, null ends link nothing. Empty in, empty out.
    """
    both = pairs.where("a <> b").select("a", "b")
    both = scratch.cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.cut(nodes.toDF("node").where("node is not null").distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("p"), F.col("root").alias("was"))
        up = lower.select(F.col("node").alias("q"), F.col("p").alias("pp"))
        jumped = lower.join(up, lower.p == up.q, "left").select("node", F.coalesce("pp", "p").alias("root"), (F.coalesce("pp", "p") != F.col("was")).alias("moved"))
        new = scratch.cut(jumped)
        scratch.drop(labels)
        labels = new
        if labels.where("moved").isEmpty():
            scratch.drop(both)
            return labels.select("node", "root")


def forest_roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) from (node, parent), where a root is its own parent: pointer jumping, logarithmic in the depth."""
    tree = scratch.cut(parents.select("node", F.col("parent").alias("root")))
    while True:
        up = tree.select(F.col("node").alias("q"), F.col("root").alias("pp"))
        jumped = tree.join(up, tree.root == up.q, "left").select("node", F.coalesce("pp", "root").alias("root"), (F.coalesce("pp", "root") != F.col("root")).alias("moved"))
        new = scratch.cut(jumped)
        scratch.drop(tree)
        tree = new.select("node", "root")
        if new.where("moved").isEmpty():
            return tree
