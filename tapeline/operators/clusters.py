"""Records of one event brought together: pair scores, clusters that grow record by record, and their refinement.

Only records that name the same entity are paired, and of those only such whose times may lie close enough: entity and
time bucket are the key of the join, so a busy entity is divided by time and what is left of skew is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import text as X
from tapeline.operators.links import forest_roots, linked_sets
from tapeline.scratch import Scratch

#: Hours up to which times are compatible, weights of the five parts, and thresholds (in millionths).
HOURS = 48
WEIGHTS = {"near": 0.2, "entity": 0.25, "action": 0.2, "place": 0.1, "meaning": 0.25}
JOIN, REVIEW = 820_000, 550_000
ENTITY, PLACE = r"([0-9]{7}\.(?:SH|SZ|BJ))", r"\b(?:in|near|at|from) ([A-Z][a-z]+)"


def mentions(records: DataFrame) -> DataFrame:
    """(id, at, entities, actions, places, vector) of records (evidence_id, title, content, published_at).

    Entities are the stock codes, actions the terms of title and content without codes, places the capitalised words after
    a preposition of place, the vector counts all terms in eight buckets. Records without id are left out.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    found = lambda c, pattern: F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1))))
    rows = records.where("evidence_id is not null").select(F.col("evidence_id").alias("id"), F.col("published_at").alias("at"), text.alias("t"))
    return rows.select("id", "at", found(F.upper("t"), ENTITY).alias("entities"), X.tokens("t").alias("actions"), F.transform(found(F.col("t"), PLACE), F.lower).alias("places"), X.term_counts(X.terms("t")).alias("vector"))


def candidate_pairs(held: DataFrame, hours: int = HOURS) -> DataFrame:
    """(a, b), a the smaller: mentions with a common entity and times at most ``hours`` apart, or one without a time."""
    each = held.select("id", "at", F.explode("entities").alias("entity"))
    bucket = F.floor(F.unix_micros("at") / F.lit(hours * 3_600_000_000)).cast("bigint")
    timed = each.where("at is not null").withColumn("k", bucket)
    near = timed.select(F.col("id").alias("b"), F.col("at").alias("bt"), "entity", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    close = F.abs(F.unix_micros("at") - F.unix_micros("bt")) <= hours * 3_600_000_000
    one = timed.join(near, ["entity", "k"]).where((F.col("id") < F.col("b")) & close).select(F.col("id").alias("a"), "b")
    timeless, every = each.where("at is null").select("id", "entity"), each.select(F.col("id").alias("o"), "entity")
    two = timeless.join(every, "entity").where("id <> o").select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))
    return one.unionByName(two).distinct()


def parts(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the five parts of their score and ``hard``: the pair has a common entity and a common action."""
    side = lambda s: held.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("at", "entities", "actions", "places", "vector")))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    two = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    place = F.when((F.size("a_places") == 0) != (F.size("b_places") == 0), 0.5).otherwise(X.jaccard(*two("places")))
    hard = F.arrays_overlap(*two("entities")) & F.arrays_overlap(*two("actions"))
    return met.select("a", "b", X.time_proximity(*two("at"), HOURS).alias("near"), X.jaccard(*two("entities")).alias("entity"), X.jaccard(*two("actions")).alias("action"), place.alias("place"), X.cosine(*two("vector")).alias("meaning"), hard.alias("hard"))


def score() -> Column:
    """The weighted sum of the parts, in whole millionths, so that equal scores compare equal."""
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 1e6 + 0.5).cast("bigint")


def scored_pairs(held: DataFrame, least: int = REVIEW) -> DataFrame:
    """(a, b, score) of all pairs that meet the hard conditions with at least ``least`` millionths."""
    found = parts(held, candidate_pairs(held)).where("hard and near is not null").select("a", "b", score().alias("score"))
    return found.where(F.col("score") >= least)


def incremental(held: DataFrame, pairs: DataFrame, order: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, cluster, decision, score): clusters as they grow when mentions come in the order of ``order`` (id, seq),
    where ``seq`` is of any type with an order and no two are equal.

    A mention joins the cluster that holds its best-scoring earlier mention (``auto_join`` from 82 %, ``review`` from
    55 %), otherwise it opens one (``new``) under its own id. A cluster's score is the best of its members, so the one a
    mention joins is that of its best earlier mention (of equal scores the earliest): every mention points to one, and
    clusters are the trees of these pointers. No state is folded in sequence, whatever the size of a cluster.
    """
    a, b = order.toDF("a", "sa"), order.toDF("b", "sb")
    directed = pairs.join(a, "a").join(b, "b")
    later = F.col("sa") > F.col("sb")
    mine, other = (lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))), (lambda x, y: F.when(later, F.col(y)).otherwise(F.col(x)))
    to = directed.select(mine("a", "b").alias("id"), F.struct((-F.col("score")).alias("loss"), other("sa", "sb").alias("seq"), other("a", "b").alias("to")).alias("x"))
    best = to.groupBy("id").agg(F.min("x").alias("x")).select("id", (-F.col("x.loss")).alias("score"), F.col("x.to").alias("to"))
    pointed = scratch.cut(held.select("id").join(best, "id", "left").select("id", F.coalesce("to", "id").alias("to"), "score"))
    roots = forest_roots(pointed.select(F.col("id").alias("node"), F.col("to").alias("parent")), scratch)
    decision = F.when(F.col("score") >= JOIN, "auto_join").when(F.col("score").isNotNull(), "review").otherwise("new")
    return pointed.join(roots, pointed.id == roots.node).select("id", F.col("root").alias("cluster"), decision.alias("decision"), "score")


def refined(clusters: DataFrame, pairs: DataFrame, merges: DataFrame, splits: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, cluster): clusters merged where a cross pair scores 82 % or a user joined them, then cut to what is linked.

    ``clusters`` (id, cluster), ``merges`` and ``splits`` (a, b) of ids. Inside a merged group, mentions stay together if
    a chain of pairs of 55 %, or merges, links them. No chain may lead from one end of a split to the other: links between
    the clusters of its ends count for nothing, and a set that still holds both is divided, each mention going with the end
    it reaches in fewer steps (of equal ones the smaller). The rule depends on no order. Names are smallest ids.
    """
    own = clusters.select(F.col("id"), F.col("cluster"))
    name = lambda p: p.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b")
    barred = name(splits.select("a", "b")).select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).where("x <> y").distinct()
    across = name(pairs.where(F.col("score") >= JOIN).select("a", "b").unionByName(merges.select("a", "b"))).select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).where("x <> y").distinct()
    allowed = across.join(barred, ["x", "y"], "left_anti").toDF("a", "b")
    groups = linked_sets(own.select("cluster"), allowed, scratch).toDF("cluster", "grp")
    placed = scratch.cut(own.join(groups, "cluster").select("id", "grp", "cluster"))
    inside = pairs.select("a", "b").unionByName(merges.select("a", "b")).join(placed.toDF("a", "ga", "ca"), "a").join(placed.toDF("b", "gb", "cb"), "b").where("ga = gb")
    inside = inside.select("a", "b", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).join(barred, ["x", "y"], "left_anti").select("a", "b")
    cut = splits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    inside = scratch.cut(inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(cut, ["a", "b"], "left_anti"))
    sets = linked_sets(own.select("id"), inside, scratch).toDF("id", "root")
    both = cut.join(sets.toDF("a", "ra"), "a").join(sets.toDF("b", "rb"), "b").where("ra = rb").select("ra", "a", "b")
    ends = scratch.cut(both.select(F.col("ra").alias("root"), F.explode(F.array("a", "b")).alias("id")).distinct())
    if ends.isEmpty():
        return sets.select("id", F.col("root").alias("cluster"))
    apart = _divided(sets.join(ends.select("root").distinct(), "root", "left_semi"), inside, ends, scratch)
    named = apart.groupBy("seed").agg(F.min("id").alias("cluster"))
    moved = apart.join(named, "seed").select("id", F.col("cluster").alias("own"))
    return sets.join(moved, "id", "left").select("id", F.coalesce("own", "root").alias("cluster"))


def _divided(members: DataFrame, links: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, seed): members of sets with ends of splits, each with the end nearest by links; a round a step."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.cut(both.join(members.select(F.col("id").alias("a")), "a", "left_semi").distinct())
    reached = scratch.cut(ends.select("id", F.col("id").alias("seed")))
    while True:
        step = both.join(reached, both.b == reached.id).groupBy("a").agg(F.min("seed").alias("seed")).toDF("id", "seed")
        fresh = scratch.cut(step.join(reached.select("id"), "id", "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = scratch.cut(reached.unionByName(fresh))
