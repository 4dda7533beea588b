"""Event-time aggregates that late and out-of-order records correct, up to a cut-off.

Method: conflict-free counters, in two forms that merge the same way.

* **Registers**: every delivery is a state of its own that knows one record: its source, its period and a version, which
  is the greater the earlier the delivery arrived. States merge by the greatest version of each record, and a period's
  count is the sum over its source's records. Merging is idempotent and free of order, so retries, redeliveries, and
  deltas that overlap or come out of turn change nothing, and an earlier arrival that turns up later corrects the outcome.
* **Lanes**: the counts of a writer that holds merged registers, with the writer's sequence number as version. The states
  of one writer replace each other, the later one wins; sums run over writers, whose records must not overlap.

Both combine on the map side, so redelivery storms of one id and hot sources do not skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.expr import micros

#: Beijing is UTC+8 all year.
BEIJING_US = 8 * 3_600_000_000
DAY_US = 86_400_000_000
OUTCOMES = ["on_time", "corrected", "dropped"]
REGISTERS = "evidence_id string, arrived_us bigint, published_us bigint, source_id string"
LANES = "period_day string, source_id string, n_on_time bigint, n_corrected bigint, n_dropped bigint, lane string, version bigint"


def registers(deliveries: DataFrame) -> DataFrame:
    """A state of one record from each delivery. Those without first_seen_at or id know nothing and have none."""
    rows = deliveries.where("evidence_id is not null and first_seen_at is not null")
    return rows.select("evidence_id", micros("first_seen_at").alias("arrived_us"), micros("published_at").alias("published_us"), "source_id")


def merge(*states: DataFrame) -> DataFrame:
    """The least state that contains all given ones: of each record the earliest arrival, which is the greatest version.

    If simultaneous deliveries disagree, the smallest publication, then source holds; nulls are the smallest.
    """
    every = reduce(DataFrame.unionByName, states)
    first = every.groupBy("evidence_id").agg(F.min(F.struct("arrived_us", "published_us", "source_id")).alias("r"))
    return first.select("evidence_id", "r.arrived_us", "r.published_us", "r.source_id")


def outcomes(state: DataFrame, cutoff_hours: int = 72) -> DataFrame:
    """(evidence_id, source_id, period_day, arrived_us, outcome) of a merged state's records.

    ``on_time``: it arrived before the end of the period's day (Beijing day of publication); ``corrected``: later, but
    less than ``cutoff_hours`` after that end; ``dropped``: later still. Records that are published at no known time
    belong to no period and are left out.
    """
    day = F.floor((F.col("published_us") + BEIJING_US) / F.lit(DAY_US)).cast("bigint")
    lag = F.col("arrived_us") - ((F.col("d") + 1) * DAY_US - BEIJING_US)
    outcome = F.when(lag < 0, "on_time").when(lag < cutoff_hours * 3_600_000_000, "corrected").otherwise("dropped")
    period = F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int")).cast("string")
    rows = state.where("published_us is not null").withColumn("d", day)
    return rows.select("evidence_id", "source_id", period.alias("period_day"), "arrived_us", outcome.alias("outcome"))


def arrivals(deliveries: DataFrame, cutoff_hours: int = 72) -> DataFrame:
    """Outcomes of all deliveries' merged registers. Further columns are ignored. Empty in, empty out."""
    return outcomes(merge(registers(deliveries)), cutoff_hours)


def _sums(by: str) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col(by))), F.lit(0)).cast("bigint").alias(f"n_{o}") for o in OUTCOMES]


def lane_counts(found: DataFrame, lane: str, version: int) -> DataFrame:
    """One writer's counts per period and source. ``version`` must grow with each state that the writer sends."""
    counts = found.withColumn("one", F.lit(1)).groupBy("period_day", "source_id").agg(*_sums("one"))
    return counts.select("*", F.lit(lane).alias("lane"), F.lit(version).cast("bigint").alias("version"))


def merge_lanes(*states: DataFrame) -> DataFrame:
    """Of each lane the state of the greatest version. Idempotent and free of order."""
    every = reduce(DataFrame.unionByName, states)
    latest = every.groupBy("lane").agg(F.max("version").alias("version"))
    return every.join(latest, ["lane", "version"], "left_semi").distinct()


def period_totals(counts: DataFrame) -> DataFrame:
    """Counts per source and period, of outcomes or of merged lanes: on time, corrected, dropped, and what counts in the end."""
    if "outcome" in counts.columns:
        sums = counts.withColumn("one", F.lit(1)).groupBy("source_id", "period_day").agg(*_sums("one"))
    else:
        sums = counts.groupBy("source_id", "period_day").agg(*(F.sum(f"n_{o}").cast("bigint").alias(f"n_{o}") for o in OUTCOMES))
    return sums.withColumn("n_final", F.col("n_on_time") + F.col("n_corrected"))
