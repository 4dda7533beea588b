"""Small rules over records: navigation, live cache entries, watch lists, refresh chains, claims and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.scratch import Scratch

#: Kinds of nodes a claim graph may have.
NODE_KINDS = ("event", "entity", "fact", "amount", "date", "location")
#: Limits of the errors of a cost model that may replace the official one.
COST_ERROR, PEAK_ERROR, WINNER_ERROR, COST_P90 = 0.03, 0.03, 5.0, 0.08
GROUP_COST_ERROR, GROUP_WINNER_ERROR = 0.06, 10.0


def neighbours(keys: DataFrame, key: str) -> DataFrame:
    """(key, prev, next, place): each distinct key's neighbours and 1-based place in the order of all keys.

    Keys are range-partitioned and numbered inside their partition; counts and ends of partitions, one row each, give the
    rest. No task sees more than a partition. Null keys have no row. Empty in, empty out.
    """
    scratch = Scratch(keys.sparkSession, "order")
    rows = keys.select(F.col(key).alias("k")).where("k is not null").distinct()
    parts = scratch.cut(rows.repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    ends = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
    line = Window.orderBy("part")  # one row a partition
    ends = ends.select("part", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("behind"))
    inner = Window.partitionBy("part").orderBy("k")
    held = parts.select("part", "k", F.lag("k").over(inner).alias("p"), F.lead("k").over(inner).alias("n"), F.row_number().over(inner).alias("rn"))
    met = held.join(F.broadcast(ends), "part")
    return met.select(F.col("k").alias(key), F.coalesce("p", "before").alias("prev"), F.coalesce("n", "behind").alias("next"), (F.col("base") + F.col("rn")).alias("place"))


def live_entries(writes: DataFrame, key: str, value: str, at: str, ttl_seconds: int, now: Column) -> DataFrame:
    """(key, value, expires_at) of a cache at ``now``: the last write of each key counts until its time has run out.

    Of simultaneous writes the greatest value holds. Writes after ``now``, and such without key or time, don't exist.
    """
    seen = writes.where(F.col(key).isNotNull() & F.col(at).isNotNull() & (F.col(at) <= now))
    last = seen.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("w"))
    until = F.timestamp_micros(F.unix_micros("w.at") + ttl_seconds * 1_000_000)
    return last.select(key, F.col("w.v").alias(value), until.alias("expires_at")).where(F.col("expires_at") > now)


def watch_list(actions: DataFrame, key: str, action: str, at: str) -> DataFrame:
    """(key, since) of what is on a list after all actions: ``add`` puts a key on it, ``remove`` takes it off.

    ``since`` is the first addition after the last removal; adding again changes nothing. A removal at the moment of an
    addition comes first. Actions of other kinds, or without key or time, are left out.
    """
    known = actions.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    off = known.where(F.col(action) == "remove").groupBy(key).agg(F.max(at).alias("off"))
    on = known.where(F.col(action) == "add").join(off, key, "left").where(F.col("off").isNull() | (F.col(at) >= F.col("off")))
    return on.groupBy(key).agg(F.min(at).alias("since"))


def refreshed(known: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str], usable: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to append, ledger) of a refresh: gate, skip what is unchanged, append the rest.

    ``usable`` is the gate; rows that fail it, or repeat the latest known version of their keys in all ``values``, are not
    appended, nor are repeated rows. The ledger counts (received, rejected, unchanged, appended) in one row. Versions are
    ordered by available_at; ``known`` and ``incoming`` have the same columns.
    """
    gate = F.coalesce(usable, F.lit(False))
    latest = known.groupBy(*keys).agg(F.max(F.struct("available_at", *values)).alias("held"))
    good = incoming.where(gate).dropDuplicates([*keys, *values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"held.{v}"))
    judged = good.join(latest, list(keys), "left").withColumn("same", F.col("held").isNotNull() & same)
    append = judged.where(~F.col("same")).select(*incoming.columns)
    counts = incoming.agg(F.count(F.lit(1)).alias("received"), F.count_if(~gate).alias("rejected"))
    out = judged.agg(F.count_if("same").alias("unchanged"), F.count_if(~F.col("same")).alias("appended"))
    return append, counts.crossJoin(out)


def extraction_issues(claims: DataFrame, mentions: DataFrame, inputs: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc, item, issue): what forbids an extraction, all rules at once; no row where nothing does.

    ``claims`` (doc, item, kind, text, confidence, evidence_ids), ``mentions`` (doc, item, kind, value) of stock codes,
    amounts and dates, ``inputs`` (doc, evidence_id, text) the extraction was made from, ``codes`` (code) that exist.
    Rules: a fact names evidence; a confidence lies within 0..1; evidence named is among the inputs; what is called a
    rumour or opinion is not called a fact too (text compared without case and surplus blanks); values occur in an input's
    text, and stock codes exist. A null confidence is outside, a null value occurs nowhere.
    """
    plain = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    facts = claims.where("kind = 'fact'")
    none = facts.where(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0).select("doc", "item", F.lit("fact_without_evidence").alias("issue"))
    range_ = claims.where("confidence is null or not confidence between 0 and 1").select("doc", "item", F.lit("confidence_out_of_range").alias("issue"))
    named = claims.select("doc", "item", F.explode("evidence_ids").alias("evidence_id")).join(inputs.select("doc", "evidence_id").distinct(), ["doc", "evidence_id"], "left_anti")
    unknown = named.select("doc", "item", F.lit("unknown_evidence").alias("issue"))
    soft = claims.where("kind in ('rumor', 'opinion')").select("doc", plain.alias("t")).distinct()
    raised = facts.withColumn("t", plain).join(soft, ["doc", "t"], "left_semi").select("doc", "item", F.lit("rumour_as_fact").alias("issue"))
    met = mentions.join(inputs.select("doc", "text"), "doc", "left").groupBy("doc", "item", "kind", "value").agg(F.max(F.coalesce(F.contains("text", "value"), F.lit(False))).alias("found"))
    absent = met.where("not found").select("doc", "item", F.concat("kind", F.lit("_not_in_text")).alias("issue"))
    strange = mentions.where("kind = 'code'").join(codes.select(F.col("code").alias("value")), "value", "left_anti").select("doc", "item", F.lit("code_unknown").alias("issue"))
    return none.unionByName(range_).unionByName(unknown).unionByName(raised).unionByName(absent).unionByName(strange).distinct()


def graph_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, issue) of a claim graph: nodes (id, kind, evidence_ids) of no known kind or without evidence, edges (source,
    target, relation, evidence_ids) without evidence or to nodes that are not there."""
    bare = F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0
    name = F.concat("source", F.lit("->"), "target", F.lit(":"), "relation")
    kind = nodes.where(~F.coalesce(F.col("kind").isin(*NODE_KINDS), F.lit(False))).select(F.col("id").alias("item"), F.lit("node_kind").alias("issue"))
    node = nodes.where(bare).select(F.col("id").alias("item"), F.lit("node_without_evidence").alias("issue"))
    edge = edges.where(bare).select(name.alias("item"), F.lit("edge_without_evidence").alias("issue"))
    ends = edges.select(name.alias("item"), F.explode(F.array("source", "target")).alias("id")).join(nodes.select("id").distinct(), "id", "left_anti")
    return kind.unionByName(node).unionByName(edge).unionByName(ends.select("item", F.lit("edge_end_missing").alias("issue"))).distinct()


def cost_gate(errors: DataFrame) -> DataFrame:
    """(decision, n, cost, peak, winner, cost_p90) from errors (part, cost, peak, winner) of a cost model, one row.

    ``estimate`` if the median errors of average cost and dominant price, the mean error of the share in profit and the
    90th percentile of the cost error, and the medians of every part, keep their limits; else, and for no or non-finite
    errors, ``official``.
    """
    part = errors.groupBy("part").agg(F.median("cost").alias("c"), F.median("winner").alias("w"))
    worst = part.agg(F.max(F.when((F.col("c") <= GROUP_COST_ERROR) & (F.col("w") <= GROUP_WINNER_ERROR), 0).otherwise(1)).alias("bad"))
    odd = F.max(F.coalesce(F.isnan(F.col("cost") + F.col("peak") + F.col("winner")), F.lit(True)).cast("int"))
    whole = errors.agg(F.count(F.lit(1)).alias("n"), F.median("cost").alias("cost"), F.median("peak").alias("peak"), F.avg("winner").alias("winner"), F.percentile("cost", 0.9).alias("cost_p90"), odd.alias("odd"))
    good = (F.col("n") > 0) & (F.col("odd") == 0) & (F.col("bad") == 0) & (F.col("cost") <= COST_ERROR) & (F.col("peak") <= PEAK_ERROR) & (F.col("winner") <= WINNER_ERROR) & (F.col("cost_p90") <= COST_P90)
    return whole.crossJoin(worst).select(F.when(F.coalesce(good, F.lit(False)), "estimate").otherwise("official").alias("decision"), "n", "cost", "peak", "winner", "cost_p90")


def causal_confidence(strength: Column, timing: Column, identification: Column, others: Column) -> Column:
    """Mean of three inputs, halved if there are other events that may explain the move; six decimals."""
    return F.round((strength + timing + identification) / 3 * F.when(others > 0, 0.5).otherwise(1.0), 6)


def evening_slot(at: Column) -> Column:
    """0 to 4 for the half hours from 18:00 to 20:00 in Beijing, the last one holding 20:00 to 20:30; null outside."""
    local = F.pmod(F.floor(F.unix_micros(at) / 60_000_000) + 8 * 60, F.lit(24 * 60))
    slot = F.floor((local - 18 * 60) / 30)
    return F.when((slot >= 0) & (slot <= 4), slot).cast("int")
