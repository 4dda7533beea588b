"""Signal detectors: a registry of name to (bars needed, condition over the feature frame).

A condition is a boolean SQL expression over the columns of ``operators.bars.features``; it is compiled to a Column, so
all detectors together are one projection. Further detectors are added with ``register``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bars needed and thresholds of each detector.
DETECTORS: dict[str, tuple[int, str]] = {
    "volume_surge": (22, "av20 > 0 and v >= 2.0 * av20 and c > o"),
    "volume_price": (10, "v5 = upv5 or upv5 >= 0.65 * v5"),
    "ma_bullish": (21, "ma5 > ma10 and ma10 > ma20"),
    "ma_pullback": (25, "(l <= ma20 * 1.01 or pl <= ma20 * 1.01) and c > ma20 and c > o"),
    "strong_pullback": (65, "c > ma60 and l <= ma20 * 1.02 and c > o"),
    "uptrend_breakout": (21, "c > hi20 and c > o"),
    "downtrend_reversal": (30, "ma5 < ma10 and c > ma5 and c > o and v > av10 * 1.2"),
    "linreg": (21, "slope20 > 0 and slope20 / ma20 * 100 > 0.1"),
    "t_trade": (60, "h > l and c >= ma20 and ma10 >= ma20 * 0.995 and (h - l) * 100 between 3.5 * pc and 12 * pc and (c - pc) * 100 between -2.5 * pc and 5.5 * pc and v between 1.1 * greatest(av10, 1) and 4.5 * greatest(av10, 1) and cp between 0.35 and 0.9"),
    "slow_bull": (25, "bull_days >= 4"),
    "small_bullish": (21, "small3 = 3"),
    "triple_bullish": (21, "bull3 = 3 and c > pc and pc > ppc"),
    "fanbao": (21, "pc < po and c > o and o <= pc and c >= po"),
    "weekly_monthly_bullish": (60, "ma25 > ma50"),
    "broken_board": (21, "ph * 1000 >= ppc * 1098 and pc * 100 < ph * 98 and c > o and c > pc"),
    "strong_first_neg": (5, "pc * 1000 >= ppc * 1098 and c < o and (o - c) * 100 < 3 * o and c > ma5"),
    "breakout": (21, "c > hi20"),
    "startup": (30, "v > av10 * 1.5 and ma5 > ma10 and c > ma5 and c > o"),
    "kuangbiao": (21, "c * 100 >= pc * 107 and v >= 3 * greatest(av20, 1)"),
    "oversold_rebound": (35, "h > l and minrsi5 <= 30 and rsi14 <= 58 and c * 100 <= hi20 * 85 and c <= ma20 * 1.06 and c > o and c > ma5 and c * 1000 between pc * 1020 and pc * 1093 and cp >= 0.65 and v between 1.2 * greatest(av10, 1) and 3.8 * greatest(av10, 1) and a >= 5000000000 and aa20 >= 3000000000"),
    "bottom_quick_start": (30, "minc4 < ma20 and c > ma20 and v > av10 * 1.8"),
    "bottom_early_start": (80, "h > l and hi60 > lo60 and hi15 > lo15 and (c - lo60) * 100 <= 45 * (hi60 - lo60) and c * 100 <= lo60 * 122 and (hi15 - lo15) * 100 <= 14 * lo15 and av5 <= greatest(av20, 1) * 1.15 and v between 1.6 * greatest(av20, 1) and 5 * greatest(av20, 1) and c > o and c * 1000 between pc * 1018 and pc * 1078 and cp >= 0.65 and c > ma5 and c >= ma20 * 0.985 and c <= ma20 * 1.08 and ma20 <= ma60 * 1.04 and a >= 5000000000 and aa20 >= 3000000000"),
    "long_cycle_reversal": (65, "(l - lo59) * 10 < lo59 and c > o and c > ma5"),
    "low_accumulation": (25, "(hi15 - lo15) * 100 < 8 * lo15 and c > hi15 and c > o and v > av15 * 1.5"),
}
#: A code is scanned once it has so many bars.
SCAN_BARS = 60


def register(name: str, bars: int, condition: str) -> None:
    DETECTORS[name] = (bars, condition)


def condition(name: str) -> str:
    bars, text = DETECTORS[name]
    return f"rn >= {max(bars, 1)} and ({text})"


def hits(frame: DataFrame, names: list[str] | None = None, scan_bars: int = SCAN_BARS, carried: list[str] | None = None) -> DataFrame:
    """Long form (code, d, signal_id) of every bar a detector fires on, with the columns in ``carried``."""
    picked = names or [*DETECTORS]
    fired = [F.when(F.expr(f"rn >= {scan_bars} and {condition(n)}"), F.lit(n)) for n in picked]
    return frame.select("code", "d", *(carried or []), F.explode(F.array_compact(F.array(*fired))).alias("signal_id"))


def multi_signal(found: DataFrame, least: int = 3) -> DataFrame:
    """Codes and dates with at least ``least`` different signals."""
    return found.groupBy("code", "d").agg(F.countDistinct("signal_id").alias("n_signals")).where(F.col("n_signals") >= least)
