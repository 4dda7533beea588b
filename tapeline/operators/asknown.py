"""Attributes as known at event time.

Method: per entity and period a snapshot of what was known when the period began, plus the log of changes inside it.
An event meets only the rows of its own (entity, period): the preceding snapshot and the period's changes. Inside a
period the versions of one key form disjoint intervals of knowledge, so replaying the changes up to the event is a
range condition on an equi-join. What is known now rides along as a flag of the last version of each key, so one join
answers both questions.

Snapshots and changes are written to the shared folder, for the periods only that hold events: a stray date adds one
period, not all between. ``known_rows`` may be used apart, to keep the
table for later events.

Hot entities: the period splits them, and an (entity, period) that still holds over 0.1 % of all events is salted; the
list of such keys has at most 1,000 rows, whatever the input, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, heavy_keys, micros
from tapeline.scratch import Scratch

DAY_US = 86_400_000_000
NEVER = 2**62
_OPEN = 2_932_896  # days from 1970 to the year 9999: an interval without an end


def status_log(master: DataFrame) -> DataFrame:
    """Change log of list_status: one row per code and moment (latest ingested_at, then smallest source)."""
    rows = master.where("code is not null and available_at is not null").select(clean_code("code").alias("entity"), micros("available_at").alias("at"), F.coalesce(micros("ingested_at"), F.lit(-NEVER)).alias("i"), F.coalesce("source", F.lit("\U0010ffff")).alias("s"), F.coalesce("list_status", F.lit("")).alias("value"))
    one = rows.groupBy("entity", "at").agg(F.min(F.struct((-F.col("i")).alias("i"), "s", "value")).alias("b"))
    null = F.lit(None)
    return one.select("entity", F.lit("status").alias("attribute"), F.lit("").alias("key"), "at", null.cast("int").alias("from_day"), null.cast("int").alias("to_day"), F.col("b.value").alias("value"))


def sector_log(membership: DataFrame, kind: str = "industry") -> DataFrame:
    """Change log of memberships of one kind; a key is (sector_code, valid_from). Of versions of one moment the one that ends last is kept, one without an end last of all."""
    rows = membership.where((F.col("sector_type") == kind) & F.col("code").isNotNull() & F.col("available_at").isNotNull() & F.col("sector_code").isNotNull() & F.col("valid_from").isNotNull())
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    picked = rows.select(clean_code("code").alias("entity"), micros("available_at").alias("at"), F.col("sector_code").alias("value"), days("valid_from").alias("from_day"), days("valid_to").alias("to_day"))
    one = picked.groupBy("entity", "at", "value", "from_day").agg(F.max("to_day").alias("to_day"))
    key = F.concat_ws("|", "value", "from_day")
    return one.select("entity", F.lit("sector").alias("attribute"), key.alias("key"), "at", "from_day", "to_day", "value")


def known_rows(log: DataFrame, period_us: int, periods: list[int]) -> DataFrame:
    """Snapshots and changes of the given periods, in ascending order: what may be known in each, with [known_from, known_to).

    A version is a change in its own period and part of every later snapshot up to, and including, the period of the
    key's next version. The last version of a key is also carried into earlier periods, flagged ``is_now``; there its
    ``known_from`` keeps it from being known too early.
    """
    key = ["entity", "attribute", "key"]
    marked = log.withColumn("p", F.floor(F.col("at") / F.lit(period_us)).cast("bigint"))
    # one row per period that has versions: where the key goes on, and its last version
    per = marked.groupBy(*key, "p").agg(F.max("at").alias("last_at"))
    line = Window.partitionBy(*key).orderBy("p")
    per = per.withColumn("next_p", F.lead("p").over(line))
    joined = marked.join(per, [*key, "p"])
    first, last = (periods[0], periods[-1]) if periods else (0, -1)
    ends, final = F.col("at") == F.col("last_at"), F.col("next_p").isNull()
    until = F.when(~ends, F.col("p")).when(final, F.lit(last)).otherwise(F.least(F.col("next_p"), F.lit(last)))
    since = F.when(ends & final, F.lit(first)).otherwise(F.greatest(F.col("p"), F.lit(first)))
    spread = joined.withColumn("is_now", ends & final).withColumn("lo", since.cast("bigint")).withColumn("hi", until.cast("bigint")).where("lo <= hi")
    spread = spread.select(*key, "at", "from_day", "to_day", "value", "is_now", F.explode(_between(periods, F.col("lo"), F.col("hi"))).alias("period"))
    within = Window.partitionBy(*key, "period").orderBy("at")
    return spread.select("entity", "period", "attribute", F.col("at").alias("known_from"), F.coalesce(F.lead("at").over(within), F.lit(NEVER)).alias("known_to"), "from_day", "to_day", "value", "is_now")


def _between(periods: list[int], low: Column, high: Column) -> Column:
    """Those of the periods that lie between two of them: a filter of one constant array."""
    held = F.array(*map(F.lit, periods)).cast("array<bigint>")
    return F.filter(held, lambda p: (p >= low) & (p <= high))


def as_known(events: DataFrame, log: DataFrame, attributes: list[str], period_days: int = 7) -> DataFrame:
    """Each distinct event (entity, day, at_us) with every attribute's value known at ``at_us`` and the one known now.

    Columns ``{attribute}_then`` and ``{attribute}_now``; null where nothing is known. Of several values valid on the
    event's day the one with the latest available_at, then latest from_day, then latest to_day (open last), then
    smallest value is taken. Events with a null entity or time are left out; a null day matches only attributes without
    validity. Runs two small aggregations to find the periods (one number each comes to the driver) and hot keys, and
    writes the snapshots. Empty in, empty out.
    """
    period_us = period_days * DAY_US
    timed = events.where("entity is not null and at_us is not null").select("entity", "day", "at_us", F.floor(F.col("at_us") / F.lit(period_us)).cast("bigint").alias("period"))
    periods = sorted(r[0] for r in timed.select("period").distinct().collect())
    hot = heavy_keys(timed, ["entity", "period"])
    salts = F.ceil(F.col("n") / F.col("per")).cast("int")
    spread = F.broadcast(hot.select("entity", "period", salts.alias("salts")))
    rows = Scratch(events.sparkSession, "known").cut(known_rows(log, period_us, periods))
    rows = rows.join(spread, ["entity", "period"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    timed = timed.join(spread, ["entity", "period"], "left").withColumn("salt", F.pmod(F.hash("day", "at_us"), F.coalesce("salts", F.lit(1))))
    e, r = timed.alias("e"), rows.alias("r")
    day = F.unix_date(F.col("e.day").cast("date"))
    known = (F.col("r.known_from") <= F.col("e.at_us")) & (F.col("e.at_us") < F.col("r.known_to"))
    valid = F.col("r.from_day").isNull() | ((F.col("r.from_day") <= day) & (day <= F.coalesce("r.to_day", F.lit(_OPEN))))
    same = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in ("entity", "period", "salt")]
    met = e.join(r, same[0] & same[1] & same[2] & (known | F.col("r.is_now")) & valid, "left")
    rank = F.struct((-F.col("r.known_from")).alias("a"), (-F.coalesce("r.from_day", F.lit(0))).alias("b"), F.coalesce(-F.col("r.to_day"), F.lit(2**31 - 1)).alias("c"), F.col("r.value").alias("value"))
    picks = []
    for name in attributes:
        own = F.col("r.attribute") == name
        picks += [F.min(F.when(own & known, rank)).alias(f"{name}_t"), F.min(F.when(own & F.col("r.is_now"), rank)).alias(f"{name}_n")]
    grouped = met.groupBy("e.entity", "e.period", "e.salt", "e.day", "e.at_us").agg(*picks)
    out = [x for n in attributes for x in (F.col(f"{n}_t.value").alias(f"{n}_then"), F.col(f"{n}_n.value").alias(f"{n}_now"))]
    return grouped.select("entity", "day", "at_us", *out)


def bars_as_known(bars: DataFrame, master: DataFrame, membership: DataFrame) -> DataFrame:
    """Bar versions with list_status and industry, then and now."""
    events = bars.select(clean_code("code").alias("entity"), F.col("trade_date").cast("date").alias("day"), micros("available_at").alias("at_us"))
    return as_known(events, status_log(master).unionByName(sector_log(membership)), ["status", "sector"])


def changed_since(known: DataFrame, attributes: list[str]) -> DataFrame:
    """Long form of the events for which an attribute known then differs from the one known now; nothing known is a value."""
    changed = [F.when(F.coalesce(f"{n}_then", F.lit("")) != F.coalesce(f"{n}_now", F.lit("")), F.struct(F.lit(n).alias("attribute"), F.coalesce(f"{n}_then", F.lit("")).alias("value"))) for n in attributes]
    rows = known.select("entity", "day", "at_us", F.explode(F.array_compact(F.array(*changed))).alias("x"))
    return rows.select(F.col("entity").alias("code"), F.col("day").cast("string").alias("trade_date"), F.col("at_us").alias("available_us"), "x.attribute", "x.value")
