"""Daily bars: the clean scan, trailing windows over them, and resampling.

Prices are kept as whole thousandths and amounts as whole cents, so sums over any window are exact whatever the order of
addition; ratios and comparisons do not depend on the unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code
from tapeline.operators.rolling import latest_per_key

VALUES = ["open", "high", "low", "close", "volume", "amount", "turnover", "pe", "pb"]
UNITS = {"open": ("o", 1000), "high": ("h", 1000), "low": ("l", 1000), "close": ("c", 1000), "volume": ("v", 1), "amount": ("a", 100), "turnover": ("t", 10000), "pe": ("pe", 100), "pb": ("pb", 100)}


def whole(c: Column, unit: int) -> Column:
    return F.floor(c * float(unit) + 0.5).cast("bigint")


def latest_bars(versions: DataFrame) -> DataFrame:
    """(code, d, o, h, l, c, v, a, t, pe, pb): the latest version of each code and date; nulls stay null."""
    rows = versions.where("code is not null and trade_date is not null")
    picked = rows.select(clean_code("code").alias("code"), F.col("trade_date").alias("d"), "available_at", "ingested_at", "source", *VALUES)
    latest = latest_per_key(picked, ["code", "d"], VALUES)
    return latest.select("code", "d", *(whole(F.col(v), u).alias(n) for v, (n, u) in UNITS.items()))


def usable_bars(versions: DataFrame) -> DataFrame:
    """Latest bars with all four prices and the volume above zero; a missing amount counts as 0."""
    return latest_bars(versions).where("o > 0 and h > 0 and l > 0 and c > 0 and v > 0").withColumn("a", F.coalesce("a", F.lit(0)))


def by_code() -> Window:
    return Window.partitionBy("code").orderBy("d")


def last_n(n: int) -> Window:
    return by_code().rowsBetween(1 - n, 0)


def prev_n(n: int) -> Window:
    return by_code().rowsBetween(-n, -1)


def sma(c: str, n: int) -> Column:
    """Mean of the last n; null if there are fewer."""
    return F.when(F.count(c).over(last_n(n)) == n, F.sum(c).over(last_n(n)) / n)


def prev_mean(c: str, n: int) -> Column:
    """Mean of the n before today; 0 if there are fewer."""
    return F.when(F.count(c).over(prev_n(n)) == n, F.sum(c).over(prev_n(n)) / n).otherwise(0.0)


def gains(n: int) -> tuple[Column, Column]:
    """Sums of rises and of falls over the last n changes."""
    up, down = F.greatest(F.col("c") - F.col("pc"), F.lit(0)), F.greatest(F.col("pc") - F.col("c"), F.lit(0))
    return F.sum(up).over(last_n(n)), F.sum(down).over(last_n(n))


def features(bars: DataFrame) -> DataFrame:
    """One wide frame of trailing features over one partitioning: one exchange and one sort for all of them."""
    w = by_code()
    one = bars.select("*", F.row_number().over(w).alias("rn"), *(F.lag(x, k).over(w).alias(n) for x, k, n in (("c", 1, "pc"), ("c", 2, "ppc"), ("o", 1, "po"), ("h", 1, "ph"), ("l", 1, "pl"))))
    up, down = gains(14)
    high, low = (lambda n: F.max("h").over(prev_n(n))), (lambda n: F.min("l").over(prev_n(n)))
    five = last_n(5)
    two = one.select(
        "*",
        *(sma("c", n).alias(f"ma{n}") for n in (5, 10, 20, 25, 50, 60)),
        *(prev_mean("v", n).alias(f"av{n}") for n in (5, 10, 15, 20)),
        prev_mean("a", 20).alias("aa20"),
        *(high(n).alias(f"hi{n}") for n in (10, 15, 20, 60)),
        *(low(n).alias(f"lo{n}") for n in (10, 15, 20, 59, 60)),
        F.sum(F.when(F.col("c") >= F.col("o"), F.col("v")).otherwise(0)).over(five).alias("upv5"),
        F.sum("v").over(five).alias("v5"),
        F.min("c").over(w.rowsBetween(-4, -1)).alias("minc4"),
        F.sum(F.when((F.col("c") > F.col("o")) & ((F.col("c") - F.col("o")) * 1000 < F.col("o") * 25), 1).otherwise(0)).over(last_n(3)).alias("small3"),
        F.sum(F.when(F.col("c") > F.col("o"), 1).otherwise(0)).over(last_n(3)).alias("bull3"),
        F.when(F.col("rn") > 14, F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / F.when(down != 0, down)))).alias("rsi14"),
        F.when(F.col("rn") >= 20, 20 * F.sum(F.col("c") * F.col("rn")).over(last_n(20)) - F.sum("c").over(last_n(20)) * F.sum("rn").over(last_n(20))).alias("cov20"),
    )
    three = two.select(
        "*",
        F.lag("ma20").over(w).alias("ma20p"),
        F.sum(F.when((F.col("c") > F.col("ma5")) & (F.col("ma5") > F.col("ma10")), 1).otherwise(0)).over(five).alias("bull_days"),
        F.min("rsi14").over(five).alias("minrsi5"),
        (F.col("cov20") / 13300.0).alias("slope20"),
        ((F.col("c") / F.col("pc") - 1) * 100).alias("gain"),
        F.when(F.col("h") > F.col("l"), (F.col("c") - F.col("l")) / (F.col("h") - F.col("l"))).otherwise(0.5).alias("cp"),
    )
    return three.drop("cov20")


def resample(bars: DataFrame, unit: str, valuation: str = "last") -> DataFrame:
    """Bars per ``unit`` (week: Monday on; month): first open, highest, lowest, last close, sums of volume and amount.

    ``valuation`` is the rule for turnover, pe and pb: ``last`` the value at the last date even if null, ``present`` the
    last one that is not null, ``none`` always null. The date is the last one in the bucket.
    """
    bucket = F.date_trunc(unit, "d").cast("date")
    value = {"last": lambda c: F.max_by(c, "d"), "present": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("d"))), "none": lambda c: F.max(F.lit(None).cast("bigint"))}[valuation]
    grouped = bars.groupBy("code", bucket.alias("bucket"))
    return grouped.agg(
        F.max("d").alias("d"), F.min_by("o", "d").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "d").alias("c"),
        F.sum("v").alias("v"), F.sum("a").alias("a"), *(value(x).alias(x) for x in ("t", "pe", "pb")),
    ).drop("bucket")
