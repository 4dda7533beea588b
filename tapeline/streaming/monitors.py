"""Monitors over streams: windows with a watermark, sudden moves, and an append-only log without repeated keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BURSTS = "code long, session string, event_id long, value double, previous double"


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late_by: str = "10 minutes") -> DataFrame:
    """Counts and sums in cents per window and event type; late rows count until the watermark passes the window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    kept = events.withWatermark("ts", late_by)
    return kept.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents")).select(F.col("w.start").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late_by: str = "10 minutes") -> DataFrame:
    """Sessions per user that end after ``gap`` without an event."""
    g = events.withWatermark("ts", late_by).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n")


def bursts(events: DataFrame, least_percent: float = 3.0) -> DataFrame:
    """Moves of ``least_percent`` and more from the last price of the code in the session; the state is one price per key.

    Rows of a micro-batch are taken in order of (ts, event_id). A session's state goes a day after its last event.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = pd.Series([state.get[0] if state.exists else None], dtype="float64")
        previous = pd.concat([last, rows["value"].iloc[:-1]]).to_numpy()
        state.update((float(rows["value"].iloc[-1]),))
        state.setTimeoutDuration(86_400_000)
        moved = (previous > 0) & (abs(rows["value"].to_numpy() - previous) * 100 >= least_percent * previous)
        yield pd.DataFrame({"code": key[0], "session": key[1], "event_id": rows["event_id"].to_numpy()[moved], "value": rows["value"].to_numpy()[moved], "previous": previous[moved]})

    keyed = events.select(F.col("user_id").cast("long").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("session"), "ts", F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    return keyed.groupBy("code", "session").applyInPandasWithState(step, BURSTS, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_versions(versions: DataFrame, keys: list[str], at: str = "available_at", keep: str = "30 days") -> DataFrame:
    """An append-only log: a key delivered again within ``keep`` is skipped; a late correction is a new key and stays."""
    return versions.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)
