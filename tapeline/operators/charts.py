"""Chart-side numerics: turning points, channels, and cost profiles of the viewer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turning_points(highs: list[int], lows: list[int], percent: float) -> list[tuple[int, str]]:
    """(index, peak or trough) of a ZigZag: a swing is confirmed once price has gone ``percent`` back from its extreme."""
    if not highs:
        return []
    found: list[tuple[int, str]] = []
    top = bottom = 0
    rising: bool | None = None
    for i in range(1, len(highs)):
        if rising is not False and highs[i] > highs[top]:
            top = i
        if rising is not True and lows[i] < lows[bottom]:
            bottom = i
        if rising is not False and lows[i] * 100 <= highs[top] * (100 - percent) and i > top:
            found.append((top, "peak"))
            rising, bottom = False, i
        elif rising is not True and highs[i] * 100 >= lows[bottom] * (100 + percent) and i > bottom:
            found.append((bottom, "trough"))
            rising, top = True, i
    return found


def zigzag(bars: DataFrame, percent: float = 5.0) -> DataFrame:
    """(code, d, kind, price): turning points of every code. Sequential per code; a code has as many bars as the calendar."""

    def run(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("d").reset_index(drop=True)
        rows = [(key[0], days["d"][i], kind, int(days["h" if kind == "peak" else "l"][i])) for i, kind in turning_points(days["h"].tolist(), days["l"].tolist(), percent)]
        return pd.DataFrame(rows, columns=["code", "d", "kind", "price"])

    return bars.select("code", "d", "h", "l").groupBy("code").applyInPandas(run, "code string, d date, kind string, price bigint")


def channel(bars: DataFrame, days: int = 60, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(code, slope, intercept, below, above): line through the last ``days`` closes and quantiles of what is left over."""
    newest = Window.partitionBy("code").orderBy(F.desc("d"))
    recent = bars.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= days).withColumn("x", F.lit(days) - F.col("k"))
    n, sx, sy = F.count(F.lit(1)), F.sum("x"), F.sum("c")
    sums = recent.groupBy("code").agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("x") * F.col("c")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx")).where("n >= 2")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    line = sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).select("code", "slope", "intercept")
    rest = recent.join(line, "code").withColumn("r", F.col("c") - F.col("slope") * F.col("x") - F.col("intercept"))
    return rest.groupBy("code").agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.percentile("r", low).alias("below"), F.percentile("r", high).alias("above"))


def cost_profile(bars: DataFrame, buckets: int = 40, decay: float = 0.02, floor: float = 0.1, days: int = 120) -> DataFrame:
    """(code, bucket, weight): the viewer's profile. A day's volume, fading linearly with age, is spread evenly over the price buckets it touches."""
    newest = Window.partitionBy("code").orderBy(F.desc("d"))
    recent = bars.withColumn("age", F.row_number().over(newest) - 1).where(F.col("age") < days)
    span = recent.groupBy("code").agg(F.min("l").alias("lo"), F.greatest(F.max("h") - F.min("l"), F.lit(1)).alias("width"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) * buckets / F.col("width")), F.lit(buckets - 1))
    touched = recent.join(span, "code").withColumn("b0", at("l")).withColumn("b1", at("h"))
    share = F.col("v") * F.greatest(1 - F.col("age") * decay, F.lit(floor)) / (F.col("b1") - F.col("b0") + 1)
    return touched.withColumn("share", share).withColumn("bucket", F.explode(F.sequence("b0", "b1"))).groupBy("code", "bucket").agg(F.sum("share").alias("weight"))
