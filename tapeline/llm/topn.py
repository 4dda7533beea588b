"""Top N items within every group, with a consistent order, even where a group holds millions of items.

Method: partition lower bounds. Inside each partition only a group's N best rows can matter, and the score of the N-th
of them is a lower bound for the group's global N-th best score. The greatest bound per group is joined to the rows
left over; rows below it are dropped, and the survivors are ranked. What moves between executors is at most N rows per
partition and group, never a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, clean_word, micros


def top_n(rows: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``, equal ones in order of ``ties``; fewer if there are fewer.

    Rows with a null or NaN score are left out; null group keys form a group of their own. ``ties`` should make rows
    unique, rows equal in all of them are interchangeable. Columns _part, _local, _bound and _rank are reserved. Empty
    in, empty out.
    """
    scored = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_part", F.spark_partition_id())
    order = [F.col(score).desc(), *(F.col(t).asc_nulls_last() for t in ties)]
    # the limit by rank is applied before the exchange, per partition (WindowGroupLimit): n rows a partition and group
    local = Window.partitionBy("_part", *group).orderBy(*order)
    kept = scored.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= n)
    bounds = kept.where(F.col("_local") == n).groupBy(*group).agg(F.max(score).alias("_bound"))
    same = [F.col(f"k.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    on = same[0]
    for s in same[1:]:
        on = on & s
    bounded = kept.alias("k").join(bounds.alias("b"), on, "left").where(F.col("_bound").isNull() | (F.col(score) >= F.col("_bound"))).select("k.*")
    rank = Window.partitionBy(*group).orderBy(*order)
    return bounded.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n).drop("_part", "_local", "_rank")


def latest_candidates(rows: DataFrame) -> DataFrame:
    """Of rows with equal run_id, code and horizon the one with the latest created_at; of simultaneous ones the greatest score.

    Horizons come in lower case and codes in capitals, without blanks. A struct maximum combines on the map side. Rows
    without created_at lose to any other. A null or NaN score stays (and is left out by the ranking).
    """
    day = F.col("trade_date").cast("date").cast("string")
    score = F.when(~F.isnan("final_score"), F.col("final_score"))
    best = F.max(F.struct(F.coalesce(micros("created_at"), F.lit(-(2**62))).alias("t"), score.alias("final_score"), day.alias("trade_date"))).alias("b")
    keyed = rows.select("run_id", clean_code("code").alias("code"), clean_word("horizon").alias("horizon"), "created_at", "final_score", "trade_date")
    return keyed.groupBy("run_id", "code", "horizon").agg(best).select("run_id", "code", "horizon", "b.final_score", "b.trade_date")


def best_candidates(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best candidates of every trade date and horizon by final_score, then code, then run_id."""
    return top_n(latest_candidates(rows), ["trade_date", "horizon"], "final_score", ["code", "run_id"], n)
