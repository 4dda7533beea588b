"""Point-in-time reads: latest versions, as-of joins and interval memberships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, micros


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order. The rank is limited before the exchange (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def master_now(master: DataFrame, as_of: str | None = None) -> DataFrame:
    """Latest master row per code: by available_at, ingested_at, then smallest source; only what was available at ``as_of``."""
    rows = master.where("code is not null").withColumn("code", clean_code("code"))
    if as_of:
        rows = rows.where(F.col("available_at") <= F.lit(as_of).cast("timestamp"))
    return newest(rows, ["code"], [F.desc_nulls_last("available_at"), F.desc_nulls_last("ingested_at"), F.asc_nulls_last("source")])


def memberships(sectors: DataFrame, kind: str = "industry", as_of: str | None = None) -> DataFrame:
    """Latest version of each (code, sector_code, valid_from) of one kind."""
    rows = sectors.where((F.col("sector_type") == kind) & F.col("code").isNotNull()).withColumn("code", clean_code("code"))
    if as_of:
        rows = rows.where(F.col("available_at") <= F.lit(as_of).cast("timestamp"))
    order = [F.desc_nulls_last("available_at"), F.desc_nulls_first("valid_to")]
    return newest(rows, ["code", "sector_code", "valid_from"], order)


def member_on(members: DataFrame, days: DataFrame) -> DataFrame:
    """All memberships valid on each (code, d): an equi-join on the code with a range condition."""
    m, d = members.alias("m"), days.alias("d")
    valid = (F.col("m.valid_from") <= F.col("d.d")) & (F.col("m.valid_to").isNull() | (F.col("d.d") <= F.col("m.valid_to")))
    return d.join(m, (F.col("m.code") == F.col("d.code")) & valid).select("d.*", "m.sector_code", "m.valid_from", "m.valid_to", "m.available_at")


def pick_member(matched: DataFrame) -> DataFrame:
    """One membership per (code, d): latest available, then latest begin, then latest end (open last), then smallest sector."""
    return newest(matched, ["code", "d"], [F.desc("available_at"), F.desc("valid_from"), F.desc_nulls_last("valid_to"), F.asc("sector_code")])


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row at or before it: one union, one exchange and one running last value.

    No range join: rows of both sides are ordered by (``at``, right first) and the last right value is carried on.
    ``left`` keeps its columns; right values come as ``asof_{v}``, null where nothing precedes.
    """
    names = left.columns
    packed = F.struct(*(F.col(v).alias(v) for v in values))
    schema = right.select(packed.alias("p")).schema["p"].dataType
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(schema).alias("_p"))
    b = right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("_row"), packed.alias("_p"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_row.*", *(F.col(f"_p.{v}").alias(f"asof_{v}") for v in values))


def at_us(c: str) -> Column:
    return micros(c)
