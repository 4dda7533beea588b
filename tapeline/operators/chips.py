"""Cost-basis (chip) distributions.

``legacy`` has a closed form: decay is linear, so a day's mass is multiplied by the product of later retention rates,
taken as a windowed sum of logarithms; no user function. ``model`` re-grids every day and is sequential by nature: a
grouped fold, one code's bars at a time (bounded by the calendar, not by versions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 30


def legacy(bars: DataFrame, days: int = 120) -> DataFrame:
    """(code, bucket, price, weight): share of each of 30 price buckets at the last bar, from the last ``days`` bars.

    ``bars`` has code, d, o, h, l, c, v, t with t the turnover in hundredths of a percent; at most 95 % turn over a day.
    A day puts 60 % of its volume on the body and 20 % on each shadow, by bucket middle. Prices are in thousandths.
    """
    newest = Window.partitionBy("code").orderBy(F.desc("d"))
    recent = bars.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= days)
    kept = F.least(F.coalesce("t", F.lit(0)) / 1000000.0, F.lit(0.95))
    later = newest.rowsBetween(Window.unboundedPreceding, -1)
    recent = recent.withColumn("log_left", F.coalesce(F.sum(F.log(1 - kept)).over(later), F.lit(0.0)))
    span = recent.groupBy("code").agg(F.min("l").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    spread = F.greatest(F.col("hi") - F.col("lo"), F.lit(10))
    low = F.greatest(F.col("lo") - 0.1 * spread, F.lit(10.0))
    span = span.withColumn("low", low).withColumn("size", F.greatest((F.col("hi") + 0.1 * spread - low) / BUCKETS, F.lit(10.0))).select("code", "low", "size")
    grid = recent.join(span, "code").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))).withColumn("mid", F.col("low") + (F.col("bucket") + 0.5) * F.col("size"))
    top, bottom = F.greatest("o", "c"), F.least("o", "c")
    per = lambda share, width: share * F.col("v") / F.greatest(width / F.col("size"), F.lit(1.0))
    m = F.col("mid")
    mass = F.when((m >= bottom) & (m <= top), per(0.6, top - bottom)).when((m >= F.col("l")) & (m < bottom), per(0.2, bottom - F.col("l"))).when((m > top) & (m <= F.col("h")), per(0.2, F.col("h") - top)).otherwise(0.0)
    summed = grid.groupBy("code", "bucket").agg(F.sum(mass * F.exp("log_left")).alias("w"), F.max("mid").alias("price"))
    total = F.sum("w").over(Window.partitionBy("code"))
    return summed.select("code", "bucket", "price", (F.col("w") / F.when(total > 0, total)).alias("weight"))


def regrid(prices: np.ndarray, weights: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Point masses moved to grid points: linearly between neighbours, to the ends outside."""
    place = np.clip(np.interp(prices, grid, np.arange(len(grid))), 0, len(grid) - 1)
    low = np.floor(place).astype(int)
    high = np.minimum(low + 1, len(grid) - 1)
    out = np.bincount(low, weights * (1 - (place - low)), len(grid))
    return out + np.bincount(high, weights * (place - low), len(grid))


def anchored_grid(low: float, high: float, anchor: float, points: int) -> np.ndarray:
    """Evenly spaced points; the interior one nearest to the anchor price is put on it."""
    grid = np.linspace(low, high, points)
    if points > 2 and high > low and not np.any(np.isclose(grid, anchor, rtol=0, atol=1e-12)):
        nearest = 1 + int(np.argmin(np.abs(grid[1:-1] - anchor)))
        grid[nearest] = anchor
        grid.sort()
    return grid


def fold(days: pd.DataFrame, points: int = BUCKETS) -> pd.DataFrame:
    """The model over one code's days (o, h, l, c, turnover in percent, factor), in order; the last day's distribution."""
    prices, weights, factor = np.zeros(0), np.zeros(0), None
    for day in days.itertuples(index=False):
        left = 0.0 if factor is None else min(max(1 - day.turnover / 100, 0.0), 1.0)
        if factor is not None and day.factor > 0:
            prices = prices * (factor / day.factor)
        weights = weights * left
        alive = weights > 0
        typical = min(max((day.o + day.h + day.l + 2 * day.c) / 5, day.l), day.h)
        grid = anchored_grid(min([day.l, *prices[alive]]), max([day.h, *prices[alive]]), typical, points)
        moved = regrid(prices[alive], weights[alive], grid) if alive.any() else np.zeros(points)
        if day.h > day.l:
            rise = np.where(grid <= typical, (grid - day.l) / max(typical - day.l, 1e-12), (day.h - grid) / max(day.h - typical, 1e-12))
            shape = np.where((grid >= day.l) & (grid <= day.h), np.clip(rise, 0, None), 0.0)
            shape[np.abs(grid - typical) < 1e-12] = 1.0
        else:
            shape = np.zeros(points)
            shape[int(np.argmin(np.abs(grid - day.l)))] = 1.0
        weights = moved + (1 - left) * shape / shape.sum()
        prices, weights, factor = grid, weights / weights.sum(), day.factor
    return pd.DataFrame({"price": prices, "weight": weights})


def model(bars: DataFrame, points: int = BUCKETS) -> DataFrame:
    """(code, price, weight): the sequential model at each code's last bar; weights sum to 1."""

    def run(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        out = fold(days.sort_values("d"), points)
        out.insert(0, "code", key[0])
        return out

    cols = [(F.col(x) / 1000.0).alias(x) for x in ("o", "h", "l", "c")]
    rows = bars.select("code", "d", *cols, F.coalesce(F.col("t") / 10000.0, F.lit(0.0)).alias("turnover"), F.lit(1.0).alias("factor"))
    return rows.groupBy("code").applyInPandas(run, "code string, price double, weight double")


def metrics(chips: DataFrame, closes: DataFrame) -> DataFrame:
    """Average cost, share in profit at the close, dominant price (lowest bucket on a tie), and weight of the five largest."""
    rank = Window.partitionBy("code").orderBy(F.desc("weight"), F.asc("price"))
    rows = chips.join(closes, "code").withColumn("k", F.row_number().over(rank))
    return rows.groupBy("code").agg(
        F.sum(F.col("price") * F.col("weight")).alias("avg_cost"),
        F.sum(F.when(F.col("price") <= F.col("c"), F.col("weight")).otherwise(0.0)).alias("winner"),
        F.max(F.when(F.col("k") == 1, F.col("price"))).alias("dominant"),
        F.sum(F.when(F.col("k") <= 5, F.col("weight")).otherwise(0.0)).alias("top5"),
    )


def wasserstein(a: DataFrame, b: DataFrame) -> DataFrame:
    """First Wasserstein distance per code: signed masses over the merged support, absolute running sum times step."""
    both = a.select("code", "price", F.col("weight").alias("w")).unionByName(b.select("code", "price", (-F.col("weight")).alias("w")))
    points = both.groupBy("code", "price").agg(F.sum("w").alias("w"))
    line = Window.partitionBy("code").orderBy("price")
    steps = points.withColumn("gap", F.abs(F.sum("w").over(line)) * (F.lead("price").over(line) - F.col("price")))
    return steps.groupBy("code").agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("w1"))
