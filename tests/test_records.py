"""Rules over records, and providers."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeline.operators import records as R
from tapeline.sources.market import MarketData, PointInTimeData, Unsupported, feed_after, parquet_tables
from tapeline.sources.providers import FileProvider, fallback

UTC = timezone.utc
START = datetime(2024, 1, 1, tzinfo=UTC)
SF = "/root/testdata/sf0.001"


def test_neighbours(spark):
    keys = random.Random(1).sample([f"k{i:04d}" for i in range(2000)], 500)
    frame = spark.createDataFrame([(k, 1) for k in [*keys, *keys[:20], None]], "code string, part int").repartition(5)
    out = {r.code: (r.prev, r.next, r.place) for r in R.neighbours(frame, "code").collect()}
    order = [None, *sorted(keys), None]
    assert out == {k: (order[i], order[i + 2], i + 1) for i, k in enumerate(order[1:-1])}
    assert R.neighbours(frame.where("1 = 0"), "code").count() == 0


def test_live_entries(spark):
    rows = [("a", 1, START), ("a", 2, START + timedelta(seconds=50)), ("b", 3, START), ("c", 4, START + timedelta(seconds=200)), ("d", 5, None), (None, 6, START), ("e", 7, START + timedelta(seconds=90)), ("e", 9, START + timedelta(seconds=90))]
    frame = spark.createDataFrame(rows, "k string, v int, at timestamp")
    now = F.lit("2024-01-01 00:01:40").cast("timestamp")
    assert {(r.k, r.v) for r in R.live_entries(frame, "k", "v", "at", 60, now).collect()} == {("a", 2), ("e", 9)}


def test_watch_list(spark):
    at = lambda k: START + timedelta(hours=k)
    rows = [("a", "add", at(1)), ("a", "add", at(2)), ("b", "add", at(1)), ("b", "remove", at(2)), ("c", "add", at(1)), ("c", "remove", at(2)), ("c", "add", at(3)), ("d", "remove", at(1)), ("d", "add", at(1)), ("e", "look", at(1)), (None, "add", at(1)), ("f", "add", None)]
    out = {r.k: r.since for r in R.watch_list(spark.createDataFrame(rows, "k string, act string, at timestamp"), "k", "act", "at").select("k", F.unix_micros("since").alias("since")).collect()}
    us = lambda t: int(t.timestamp() * 1_000_000)
    assert out == {"a": us(at(1)), "c": us(at(3)), "d": us(at(1))}


def test_refresh_gates_skips_and_appends(spark):
    fields = "code string, available_at timestamp, x int, y string"
    known = spark.createDataFrame([("a", START, 1, "p"), ("a", START + timedelta(1), 2, None), ("b", START, 5, "q")], fields)
    new = START + timedelta(5)
    rows = [("a", new, 2, None), ("b", new, 6, "q"), ("b", new, 6, "q"), ("c", new, 1, "z"), ("d", new, -1, "z"), ("e", new, None, "z")]
    append, ledger = R.refreshed(known, spark.createDataFrame(rows, fields), ["code"], ["x", "y"], F.col("x") > 0)
    assert sorted((r.code, r.x) for r in append.collect()) == [("b", 6), ("c", 1)]
    assert tuple(ledger.first()) == (6, 2, 1, 2)


def test_claims(spark):
    claims = [("d", 0, "fact", "It  Rose", 0.5, ["e1"]), ("d", 1, "fact", "x", 0.5, []), ("d", 2, "fact", "y", 1.5, ["e9"]), ("d", 3, "rumor", "it rose ", 0.0, []), ("d", 4, "opinion", "z", None, None)]
    c = spark.createDataFrame(claims, "doc string, item int, kind string, text string, confidence double, evidence_ids array<string>")
    m = spark.createDataFrame([("d", 10, "code", "1.SH"), ("d", 11, "code", "2.SH"), ("d", 12, "amount", "40"), ("d", 13, "date", "9 May"), ("x", 14, "date", "9 May"), ("d", 15, "amount", None)], "doc string, item int, kind string, value string")
    inputs = spark.createDataFrame([("d", "e1", "1.SH rose by 40"), ("d", "e2", "on 9 May 2.SH")], "doc string, evidence_id string, text string")
    codes = spark.createDataFrame([("1.SH",)], "code string")
    out = {(r.item, r.issue) for r in R.extraction_issues(c, m, inputs, codes).collect()}
    assert out == {(0, "rumour_as_fact"), (1, "fact_without_evidence"), (2, "confidence_out_of_range"), (2, "unknown_evidence"), (4, "confidence_out_of_range"), (11, "code_unknown"), (14, "date_not_in_text"), (15, "amount_not_in_text")}
    nodes = spark.createDataFrame([("n1", "fact", ["e"]), ("n2", "guess", ["e"]), ("n3", "event", [])], "id string, kind string, evidence_ids array<string>")
    edges = spark.createDataFrame([("n1", "n2", "of", ["e"]), ("n1", "n9", "of", None)], "source string, target string, relation string, evidence_ids array<string>")
    assert {(r.item, r.issue) for r in R.graph_issues(nodes, edges).collect()} == {("n2", "node_kind"), ("n3", "node_without_evidence"), ("n1->n9:of", "edge_without_evidence"), ("n1->n9:of", "edge_end_missing")}


def test_cost_gate(spark):
    rows = [("SH", 0.01, 0.01, 1.0), ("SH", 0.02, 0.02, 2.0), ("SZ", 0.03, 0.01, 3.0)]
    gate = lambda rs: R.cost_gate(spark.createDataFrame(rs, "part string, cost double, peak double, winner double")).first().decision
    assert gate(rows) == "estimate" and gate([]) == "official"
    assert gate([*rows, ("BJ", 0.07, 0.01, 1.0)]) == "official"  # a part beyond its own limit
    assert gate([*rows, ("SH", float("nan"), 0.01, 1.0)]) == "official"
    assert gate([(p, c, 0.05, w) for p, c, _, w in rows]) == "official"


def test_evening_slots(spark):
    rows = spark.createDataFrame([(START + timedelta(minutes=m),) for m in (599, 600, 629, 630, 749, 750)], "at timestamp")
    assert [r[0] for r in rows.orderBy("at").select(R.evening_slot(F.col("at"))).collect()] == [None, 0, 0, 1, 4, None]


def test_feed(spark):
    rows = [("a", START), ("b", START), ("c", START + timedelta(1)), ("c", START + timedelta(9)), (None, START), ("d", None)]
    frame = spark.createDataFrame(rows, "evidence_id string, first_seen_at timestamp")
    us = int(START.timestamp() * 1_000_000)
    assert {r[0] for r in feed_after(frame, us, "a").collect()} == {"b", "c"}
    assert {r[0] for r in feed_after(frame, 0, "", 3_600_000_000).collect()} == {"c"}


def test_providers(spark):
    market, pit = MarketData(spark, parquet_tables(SF)), PointInTimeData(spark, parquet_tables(SF))
    assert market.stock_list().count() > 0 and market.sector_data(date(2024, 3, 5)).count() > 0
    with pytest.raises(Unsupported):
        market.index_daily("x", date(2024, 3, 5))
    with pytest.raises(Unsupported):
        pit.corporate_actions(date(2024, 1, 1), date(2024, 2, 1))
    assert pit.capabilities()["daily_basic"] and not pit.capabilities()["adjustment_factors"]
    assert pit.daily_basics(date(2024, 3, 5), "2024-03-01 00:00:00").count() == 0 < pit.daily_basics(date(2024, 3, 5), "2024-12-01 00:00:00").count()
    first = FileProvider("none", SF, {})
    assert fallback(spark, [first, parquet_tables(SF)], "security_master_versions", "true")[0] == "files"
    assert fallback(spark, [first], "security_master_versions", "true") is None
