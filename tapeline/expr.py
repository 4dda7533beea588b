"""Column helpers shared by all operators; every one stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters counted as blanks around a key: white space of any kind.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_code(c: Column | str) -> Column:
    """A key in capitals without blanks around."""
    return F.upper(F.btrim(col(c), F.lit(BLANKS)))


def clean_word(c: Column | str) -> Column:
    """A word in lower case without blanks around."""
    return F.lower(F.btrim(col(c), F.lit(BLANKS)))


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def round_half(c: Column, digits: int) -> Column:
    """IEEE half-away rounding: sign(x) * floor(|x| * 10^d + 0.5) / 10^d. Not the decimal-string round()."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def round2(c: Column) -> Column:
    return round_half(c, 2)


def round6(c: Column) -> Column:
    return round_half(c, 6)


def pct_change(value: Column, base: Column) -> Column:
    return F.when(F.abs(base) < EPS, F.lit(0.0)).otherwise((value - base) / base * 100.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def triangular(v: Column, centre: float, low: float, high: float) -> Column:
    """1 at the centre, falling off linearly by the wider side, 0 outside [low, high]."""
    width = max(centre - low, high - centre, 0.01)
    inside = (v >= low) & (v <= high)
    return F.when(inside, F.greatest(F.lit(0.0), 1.0 - F.abs(v - centre) / width)).otherwise(0.0)


def close_position(c: Column, low: Column, high: Column) -> Column:
    """Where the close lies between low and high; 0.5 on a flat bar."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(0.5)


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, with their number of rows ``n`` and the limit ``per``.

    At most 1/share keys can hold that much, so the result is small at any size of input and safe to broadcast. Runs
    one count and one aggregation with map-side combine; the few rows come to the driver. No rows in, no rows out.
    """
    per = math.ceil(df.count() * share)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") > per).select(*keys, "n", F.lit(per).cast("bigint").alias("per")).collect()
    schema = df.select(*keys).schema.add("n", T.LongType()).add("per", T.LongType())
    return df.sparkSession.createDataFrame(rows, schema)
