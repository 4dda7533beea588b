"""Pattern features by name: a name such as ``return_20d`` is parsed and compiled to a window column."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tapeline.operators.bars import by_code, gains, last_n, sma


def _ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b) - 1


def _full(n: int, c: Column) -> Column:
    return F.when(F.count("c").over(last_n(n)) == n, c)


def _rsi(n: int) -> Column:
    up, down = gains(n)
    value = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / F.when(down != 0, down)))
    return F.when(F.row_number().over(by_code()) > n, value)


_FAMILIES = (
    (r"(?:return|breakout|reversal)_(\d+)d", lambda n: _ratio(F.col("c"), F.lag("c", n).over(by_code()))),
    (r"price_vs_ma(\d+)", lambda n: _ratio(F.col("c"), sma("c", n))),
    (r"ma20_vs_ma(\d+)", lambda n: _ratio(sma("c", 20), sma("c", n))),
    (r"consolidation_range_(\d+)d", lambda n: _full(n, (F.max("h").over(last_n(n)) - F.min("l").over(last_n(n))) / F.col("c"))),
    (r"volume_ratio_(\d+)d", lambda n: _full(n, F.col("v") / (F.sum("v").over(last_n(n)) / n))),
    (r"distance_from_(\d+)d_low", lambda n: _full(n, _ratio(F.col("c"), F.min("l").over(last_n(n))))),
    (r"rsi_(\d+)", _rsi),
)


def compile_feature(name: str) -> Column | None:
    """The column of a feature over bars (code, d, o, h, l, c, v, pc); None if the name is not supported."""
    for pattern, build in _FAMILIES:
        found = re.fullmatch(pattern, name)
        if found and 0 < int(found[1]) <= 1000:
            return build(int(found[1])).alias(name)
    return None


def relative_strength(n: int) -> tuple[Column, Column]:
    """(own ratio over n bars, the median of all codes' on the date): the second is a window by date over the first."""
    own = F.col("c") / F.lag("c", n).over(by_code())
    return own, F.median("own").over(Window.partitionBy("d"))
