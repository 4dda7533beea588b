"""Streams run to their end give the rows of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import late
from tapeline.plans import evidence
from tapeline.session import ship
from tapeline.streaming import counters, monitors
from tapeline.sources.tables import table

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, frame, parts=4, files=1):
    source = str(tmp_path / "in")
    frame.repartition(parts).write.parquet(source)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(source)


def _collect(spark, query_frame, tmp_path, name, mode="append"):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_tumbling_windows(spark, tmp_path):
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _stream(spark, tmp_path, events)
    out = monitors.windowed_counts(stream, late_by="3650 days").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    assert _collect(spark, out, tmp_path, "tumbling", "complete") == {tuple(r) for r in evidence.stream_tumbling_1h(spark, SF).collect()}


def test_sessions(spark, tmp_path):
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = monitors.sessions(_stream(spark, tmp_path, events), late_by="3650 days").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))
    assert _collect(spark, out, tmp_path, "sessions", "complete") == {tuple(r) for r in evidence.stream_session(spark, SF).collect()}


def test_bursts(spark, tmp_path):
    ship(spark)
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _collect(spark, monitors.bursts(_stream(spark, tmp_path, events, 1)).select("code", "event_id", "value", "previous"), tmp_path, "bursts")
    assert out == {tuple(r) for r in evidence.stream_burst(spark, SF).collect()}


def test_append_log_skips_redeliveries(spark, tmp_path):
    rows = table(spark, SF, "stock_daily_bar_versions").select("code", "trade_date", "available_at")
    stream = _stream(spark, tmp_path, rows)
    out = _collect(spark, monitors.append_versions(stream, ["code", "trade_date", "available_at"], keep="3650 days"), tmp_path, "versions")
    assert len(out) == rows.distinct().count() < rows.count()


def test_counters_of_a_stream(spark, tmp_path):
    """Deliveries as they are: redelivered, out of order and late; then a retried micro-batch and a compaction."""
    rows = table(spark, SF, "market_event_evidence").select("evidence_id", "source_id", "published_at", "first_seen_at")
    log = counters.CounterLog(spark, str(tmp_path / "state"))
    query = counters.run_counters(_stream(spark, tmp_path, rows.orderBy(F.hash("evidence_id", "first_seen_at"))), log, str(tmp_path / "cp"), compact_every=3)
    assert query.awaitTermination(120) and query.exception() is None
    as_set = lambda df: {tuple(r) for r in df.collect()}
    want = as_set(late.period_totals(late.arrivals(rows)))
    assert sum(r[4] for r in want) > 20  # dropped ones are counted, not lost
    assert as_set(late.period_totals(late.outcomes(log.state()))) == want
    log.add(late.registers(rows.limit(50)), 0)  # a retry, whose first result was folded away already
    assert as_set(late.period_totals(late.outcomes(log.state()))) == want
    log.compact()
    assert len(log.parts()) == 1 and as_set(late.period_totals(late.outcomes(log.state()))) == want
