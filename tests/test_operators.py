"""Core operators and functions against hand-worked cases and brute force."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.expr import clean_code, heavy_keys, round2, triangular
from tapeline.functions import detectors
from tapeline.functions import text as X
from tapeline.functions.conditions import compile_condition
from tapeline.functions.pattern_features import compile_feature
from tapeline.functions.splits import walk_forward
from tapeline.operators import bars as B
from tapeline.operators import charts, chips, pit, sinks
from tapeline.scratch import Scratch, release, shared_dir

BAR = "code string, d date, o bigint, h bigint, l bigint, c bigint, v bigint, a bigint, t bigint, pe bigint, pb bigint"


def series(spark, closes, code="A", volume=1000, spread=50):
    start = date(2024, 1, 1)
    rows = [(code, start + timedelta(days=i), c - 10, c + spread, c - spread, c, volume, c * volume, 5000, None, None) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def test_feature_frame_is_one_shuffle(spark):
    plan = B.features(series(spark, range(1000, 1100)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_moving_averages_need_all_their_bars(spark):
    f = {r.rn: r for r in B.features(series(spark, [1000, 2000, 3000, 4000, 5000, 6000])).collect()}
    assert f[4].ma5 is None and f[5].ma5 == 3000.0 and f[6].ma5 == 4000.0 and f[6].av5 == 1000.0 and f[5].av5 == 0.0


def test_detectors_fire_and_do_not(spark):
    rising = B.features(series(spark, range(10000, 13500, 50)))
    hits = {r.signal_id for r in detectors.hits(rising).where("d = '2024-03-10'").collect()}
    assert {"ma_bullish", "slow_bull", "triple_bullish", "small_bullish", "weekly_monthly_bullish", "linreg"} <= hits
    falling = B.features(series(spark, range(13500, 10000, -50)))
    assert not {r.signal_id for r in detectors.hits(falling).collect()} & {"ma_bullish", "slow_bull", "linreg", "breakout"}


def test_registered_detector(spark):
    detectors.register("test_only", 3, "c > 10100")
    try:
        found = detectors.hits(B.features(series(spark, range(10000, 10400, 100))), ["test_only"], scan_bars=1)
        assert found.count() == 2
    finally:
        del detectors.DETECTORS["test_only"]


def test_condition_statuses():
    cols = ["c"]
    say = lambda text: compile_condition(text, cols)[1]
    assert [say(x) for x in ("[]", '{"column": "x", "operator": "gte", "value": 1}', '{"field": "c", "operator": "~", "value": 1}', '{"field": "c", "operator": "lt", "value": "1"}', '{"field": "c", "operator": "lt", "value": 1}')] == ["unsupported_condition", "missing_feature", "unsupported_operator", "non_numeric_value", "evaluated"]


def test_feature_names(spark):
    assert compile_feature("return_5d") is not None
    assert all(compile_feature(x) is None for x in ("return_5", "return_0d", "wave", "rsi_", "price_vs_ma9999"))


def test_walk_forward_purges_and_embargoes():
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    found = walk_forward(days, 10, 5, 3)
    assert [len(s["train"]) for s in found] == [10] * len(found) and len(found) == 4
    for s in found:
        assert s["train"][-1] < s["purge"][0] <= s["purge"][-1] < s["validate"][0] and s["validate"][-1] < s["embargo"][0] and len(s["embargo"]) == 3
    assert walk_forward(days[:20], 10, 5, 3) == []


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.choice("ab"), rng.randrange(50), i) for i in range(60)]
    right = {(rng.choice("abc"), rng.randrange(50)): rng.randrange(99) for _ in range(30)}
    out = pit.as_of_join(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, t int, v int"), "k", "t", ["v"]).collect()
    for r in out:
        before = [(t, v) for (k, t), v in right.items() if k == r.k and t <= r.t]
        assert r.asof_v == (max(before)[1] if before else None)
    assert len(out) == 60


def test_upsert_keeps_fields(spark):
    schema = "k int, x double, pe double"
    out = sinks.upsert_positive(spark.createDataFrame([(1, 5.0, 1.0), (2, 6.0, None)], schema), spark.createDataFrame([(1, 0.0, None), (2, 7.0, 3.0), (3, None, None)], schema), ["k"], ["x"], ["pe"])
    assert {tuple(r) for r in out.collect()} == {(1, 5.0, 1.0), (2, 7.0, 3.0), (3, None, None)}


def test_append_is_idempotent_and_unchanged_is_skipped(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "z"), (3, "z")], "k int, v string")
    once = sinks.append_new(a, b, ["k"])
    assert once.count() == 3 and sinks.append_new(once, b, ["k"]).count() == 3
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "p"), (1, 4, "p"), (1, 5, None)], "k int, t int, v string")
    assert sorted(r.t for r in sinks.skip_unchanged(rows, ["k"], [F.asc("t")], ["v"]).collect()) == [1, 3, 5]
    assert sinks.conflicts(rows, ["k"], ["v"]).first().n_payloads == 2


def test_resample_rules_differ(spark):
    rows = [("A", date(2024, 1, d), 1, 2, 1, 1, 1, 1, t, None, None) for d, t in ((1, 5), (2, None), (8, 7))]
    b = spark.createDataFrame(rows, BAR)
    by = {v: [r.t for r in B.resample(b, "week", v).orderBy("d").collect()] for v in ("last", "present", "none")}
    assert by == {"last": [None, 7], "present": [5, 7], "none": [None, None]}


def test_chip_model_mass_and_regrid():
    grid = chips.anchored_grid(10.0, 20.0, 14.4, 11)
    assert 14.4 in grid and len(grid) == 11 and list(grid) == sorted(grid)
    moved = chips.regrid(np.array([5.0, 12.5, 30.0]), np.array([1.0, 2.0, 3.0]), np.arange(10.0, 21.0))
    assert moved.sum() == pytest.approx(6.0) and moved[0] == 1 and moved[2] == moved[3] == 1 and moved[-1] == 3
    days = pd.DataFrame({"o": [10, 11, 11.0], "h": [11, 12, 11.0], "l": [9, 10, 11.0], "c": [10.5, 11.5, 11.0], "turnover": [3, 100, 0.0], "factor": [1, 1, 1.0]})
    out = chips.fold(days.iloc[:2])
    assert out["weight"].sum() == pytest.approx(1.0)
    assert (out["price"][out["weight"] > 1e-12] >= 10).all()  # everything turned over on the second day
    kept = chips.fold(days)
    assert (kept["price"] * kept["weight"]).sum() == pytest.approx((out["price"] * out["weight"]).sum(), rel=1e-6)


def test_chip_legacy_weights(spark):
    out = chips.legacy(series(spark, range(10000, 12000, 100)))
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(1.0) and out.count() == 30
    assert chips.legacy(series(spark, [10000] * 5)).count() == 0


def test_wasserstein(spark):
    a = spark.createDataFrame([("A", 1.0, 0.5), ("A", 3.0, 0.5)], "code string, price double, weight double")
    b = spark.createDataFrame([("A", 2.0, 1.0)], "code string, price double, weight double")
    assert chips.wasserstein(a, b).first().w1 == pytest.approx(1.0) and chips.wasserstein(a, a).first().w1 == 0


def test_zigzag():
    highs, lows = [10, 12, 11, 9, 8, 10, 13], [9, 11, 9, 8, 7, 9, 12]
    assert charts.turning_points(highs, lows, 10) == [(0, "trough"), (1, "peak"), (4, "trough")]
    assert charts.turning_points([], [], 5) == [] and charts.turning_points([5, 5], [5, 5], 5) == []


def test_text_expressions(spark):
    rows = [("HTTP://Ex.COM:80/a?b=1#c", " a \n b "), ("https://x.y:8443", None), ("ftp://x", ""), (None, "q")]
    out = spark.createDataFrame(rows, "u string, t string").select(X.canonical_url("u").alias("u"), X.squeeze("t").alias("t")).collect()
    assert [r.u for r in out] == ["http://ex.com/a?b=1", "https://x.y:8443/", None, None] and [r.t for r in out] == ["a b", "", "", "q"]
    t = spark.createDataFrame([("Big 600519 news, big 7000001.SH ab",)], "s string").select(X.tokens("s").alias("t")).first().t
    assert t == ["600519", "big", "news"]  # a number is a term, a code with its exchange is not
    j = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), ([], ["a"])], "a array<string>, b array<string>").select(X.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.j for r in j] == [0.5, 1.0, 0.0]
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in c] == [1.0, 0.0, 0.0]


def test_rounding_and_codes(spark):
    r = spark.range(1).select(round2(F.lit(1.005)).alias("a"), round2(F.lit(-2.345)).alias("b"), triangular(F.lit(2.0), 2.2, 0.5, 4.5).alias("t"), clean_code(F.lit("  9000001.sh　")).alias("c")).first()
    assert (r.a, r.c) == (1.0, "9000001.SH") and r.b in (-2.34, -2.35) and 0.9 < r.t < 1


def test_heavy_keys(spark):
    df = spark.createDataFrame([("hot",)] * 50 + [(str(i),) for i in range(50)], "k string")
    out = heavy_keys(df, ["k"], 0.1).collect()
    assert [(r.k, r.n, r.per) for r in out] == [("hot", 50, 10)] and heavy_keys(df.where("1 = 0"), ["k"]).count() == 0


def test_scratch_tables(spark):
    kept = Scratch(spark, "t")
    table = kept.cut(spark.range(5))
    assert table.count() == 5 and shared_dir(spark) in table.inputFiles()[0]
    kept.drop(table)
    release(spark)


def test_master_now_and_membership(spark):
    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    m = spark.createDataFrame([("a ", "L", at(1), at(1), "x"), ("A", "P", at(2), at(3), "y"), ("A", "D", at(2), at(3), "x"), ("B", "L", at(5), None, None)], "code string, list_status string, available_at timestamp, ingested_at timestamp, source string")
    assert {(r.code, r.list_status) for r in pit.master_now(m).collect()} == {("A", "D"), ("B", "L")}
    assert {(r.code, r.list_status) for r in pit.master_now(m, "2024-01-01 12:00:00").collect()} == {("A", "L")}
