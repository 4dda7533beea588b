"""Consolidating pairwise matches into groups: connected components over billions of pairs.

Method: propagate minimum labels across edges and accelerate with pointer jumping, every round written to the shared
folder, until no label changes. After a round the edges are rewritten to the labels of their ends, so edges inside a
found tree vanish and the next round works on what is left: the number of rounds is logarithmic even for long chains.

Ids are replaced by order-preserving 64-bit numbers first (one global sort), so that every later step is a hash
aggregate over fixed-width columns, and the smallest number is the smallest id.

Hot records and hot matches: minima combine on the map side; joins are on one key with AQE's skew split, and none of
them feeds an aggregation on the same key alone. No group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.expr import BLANKS, col
from tapeline.scratch import Scratch


def clean_id(c: Column | str) -> Column:
    """Lower case, without blanks around, hyphens as 8-4-4-4-12; an id that isn't 32 digits keeps its own hyphens."""
    plain = F.lower(F.btrim(col(c), F.lit(BLANKS)))
    bare = F.regexp_replace(plain, "-", "")
    dashed = F.concat_ws("-", *(F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.length(bare) == 32, dashed).otherwise(plain)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) of longs to (node, label): the smallest node linked to each node of an edge, directly or through others.

    Edges may be repeated, reversed or loops; null ends are left out. Nodes of loops only have no row. Runs two to four
    jobs a round; ends when no edge joins two labels.
    """
    spark = edges.sparkSession
    live = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    live = scratch.cut(live)
    levels = []
    while not live.isEmpty():
        # the smallest neighbour of every node, where smaller than itself: a forest whose roots are local minima
        hook = live.groupBy("u").agg(F.min("v").alias("p"))
        tree = scratch.cut(hook.select(F.col("u").alias("node"), "p"))
        while True:  # pointer jumping: two doublings a job
            once = _jump(tree)
            moved = scratch.cut(_jump(once.select("node", "p")).withColumn("moved", F.col("p") != F.col("was")))
            scratch.drop(tree)
            tree = moved
            if tree.where("moved").isEmpty():
                break
        tree_map = tree.select("node", "p")
        nxt = live.alias("e").join(tree_map.alias("a"), F.col("e.u") == F.col("a.node")).join(tree_map.alias("b"), F.col("e.v") == F.col("b.node"), "left")
        nxt = nxt.select(F.col("a.p").alias("x"), F.coalesce("b.p", "e.v").alias("y")).where("x <> y")
        nxt = nxt.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        done, live = live, scratch.cut(nxt)
        scratch.drop(done)
        levels.append(tree_map)
    if not levels:
        return spark.createDataFrame([], "node bigint, label bigint")
    # a later level maps the roots of the one before; compose from the last (smallest) one back
    labels = levels[-1].select("node", F.col("p").alias("label"))
    for level in reversed(levels[:-1]):
        below = level.alias("l").join(labels.alias("r"), F.col("l.p") == F.col("r.node"), "left").select("l.node", F.coalesce("r.label", "l.p").alias("label"))
        labels = scratch.cut(below.unionByName(labels))  # nodes of a later level are roots of this one, so never both
    return labels


def _jump(tree: DataFrame) -> DataFrame:
    """p := p of p, for trees (node, p); ``was`` is the pointer before."""
    up = tree.select(F.col("node").alias("q"), F.col("p").alias("pp"))
    return tree.join(up, F.col("p") == F.col("q"), "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("p").alias("was"))


def consolidate(members: DataFrame, group: str = "duplicate_group_id", record: str = "evidence_id") -> DataFrame:
    """Every non-null record with the smallest record of its linked set: (evidence_id, group_id), ids in one form.

    Records with the same non-null group are linked. A record without a group, or alone in it, is its own group. Null
    records form no row, repeated rows and self-matches change nothing, further columns are ignored. Empty in, empty out.
    """
    scratch = Scratch(members.sparkSession, "groups")
    rows = members.where(F.col(record).isNotNull()).select(clean_id(record).alias("id"), F.col(group).alias("g"))
    nodes = scratch.cut(rows.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("n")))
    linked = scratch.cut(rows.where("g is not null").join(nodes, "id").select("g", "n"))
    lowest = linked.groupBy("g").agg(F.min("n").alias("v"))
    edges = linked.join(lowest, "g").where("n <> v").select(F.col("n").alias("u"), "v")
    labels = components(edges, scratch)
    rooted = nodes.alias("a").join(labels.alias("l"), F.col("a.n") == F.col("l.node"), "left").select("a.id", F.coalesce("l.label", "a.n").alias("root"))
    names = nodes.select(F.col("n").alias("root"), F.col("id").alias("group_id"))
    return rooted.join(names, "root").select(F.col("id").alias("evidence_id"), "group_id")
