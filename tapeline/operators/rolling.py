"""Rolling totals over trailing calendar periods, days without activity included.

Method: aggregate to one row per entity and day, densify to the entity's calendar, then window sums over a fixed number
of preceding rows. The entity-calendar product is generated per entity, by exploding the days from one active day up to
the next: same rows as a cross join with a calendar restricted to the entity's span, but without a join, so the one
shuffle on the entity serves both the densification and the trailing windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, micros

_LAST = 2**62


def latest_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str], available: str = "available_at") -> DataFrame:
    """One row per key: the version with the latest ``available``, then latest ingested_at, then smallest source.

    A struct minimum instead of a window: versions collapse on the map side, so a key that holds a third of all rows
    never reaches one task. Versions without ``available`` lose to any other; of versions that are equal in all three,
    the one with the smallest values is kept, so the result does not depend on row order. Empty in, empty out.
    """
    negative = lambda c: -F.coalesce(micros(c), F.lit(-_LAST))
    parts: list[Column] = [negative(available).alias("o0")]
    if "ingested_at" in df.columns:
        parts.append(negative("ingested_at").alias("o1"))
    if "source" in df.columns:
        parts.append(F.coalesce(F.col("source"), F.lit("\U0010ffff")).alias("o2"))
    best = F.min(F.struct(*parts, *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*keys, *(F.col(f"_best.v{i}").alias(v) for i, v in enumerate(values)))


def densify(daily: DataFrame, entity: str, day: str, values: Sequence[str]) -> DataFrame:
    """Every calendar day from an entity's first to its last day; ``values`` are null on added days."""
    order = Window.partitionBy(entity).orderBy(day)
    until = F.coalesce(F.date_sub(F.lead(day).over(order), 1), F.col(day))
    spread = daily.select(entity, day, *values, until.alias("_until"))
    spread = spread.select(entity, F.col(day).alias("_own"), *values, F.explode(F.sequence(day, "_until")).alias(day))
    return spread.select(entity, day, *(F.when(F.col(day) == F.col("_own"), F.col(v)).alias(v) for v in values))


def rolling_totals(daily: DataFrame, entity: str, day: str, sums: Sequence[str], averages: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing totals ``{v}_sum_{k}`` and averages of the values present ``{v}_avg_{k}`` per entity and calendar day.

    ``daily`` has one row per entity and day. Rows with a null entity or day are left out (they have no calendar). A
    null or NaN value counts as missing: a total over no value is null, so is an average. ``n_days`` numbers the days of
    an entity from 1. Other columns of ``daily`` are dropped, whatever their names. Empty in, empty out.
    """
    values = [*dict.fromkeys([*sums, *averages])]
    present = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v)).alias(v) for v in values]
    kept = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, day, *present)
    dense = densify(kept, entity, day, values)
    order = Window.partitionBy(entity).orderBy(day)
    columns = [F.row_number().over(order).alias("n_days")]
    for k in windows:
        trailing = order.rowsBetween(1 - k, 0)
        columns += [F.sum(v).over(trailing).alias(f"{v}_sum_{k}") for v in sums]
        columns += [F.avg(v).over(trailing).alias(f"{v}_avg_{k}") for v in averages]
    return dense.select(entity, day, *columns)


def daily_bars(versions: DataFrame) -> DataFrame:
    """The latest version of each code and trade date; a close of 0 is missing, as a null value is."""
    rows = versions.where(F.col("code").isNotNull() & F.col("trade_date").isNotNull())
    picked = rows.select(clean_code("code").alias("code"), F.col("trade_date").cast("date").alias("trade_date"), "available_at", "ingested_at", "source", "volume", "amount", "close")
    latest = latest_per_key(picked, ["code", "trade_date"], ["volume", "amount", "close"])
    return latest.withColumn("close", F.when(F.col("close") != 0, F.col("close")))


def bar_totals(versions: DataFrame) -> DataFrame:
    """Rolling totals of volume and amount and average close over 7 and 30 days for every code and calendar day."""
    return rolling_totals(daily_bars(versions), "code", "trade_date", ["volume", "amount"], ["close"], (7, 30))


def unusual_days(totals: DataFrame) -> DataFrame:
    """Days on which the last week runs at over twice the month's pace, or the week's average close is over 1.12 times the month's."""
    pace = lambda v: F.coalesce(F.col(f"{v}_sum_7"), F.lit(0)) / 7 > 2 * (F.coalesce(F.col(f"{v}_sum_30"), F.lit(0)) / 30)
    found = F.array_compact(F.array(F.when(pace("volume"), F.lit("volume")), F.when(pace("amount"), F.lit("amount")), F.when(F.col("close_avg_7") > 1.12 * F.col("close_avg_30"), F.lit("close"))))
    return totals.where(F.col("n_days") >= 30).select("code", F.col("trade_date").cast("string").alias("trade_day"), F.explode(found).alias("measure"))
