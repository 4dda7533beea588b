"""The general problems' operators on small tables with nulls, ties, repeated rows, late rows and clashing extra columns."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeline.operators import asknown, history, late, rolling

UTC = timezone.utc
BARS = "code string, trade_date date, close double, volume bigint, amount double, available_at timestamp, source string, ingested_at timestamp, idx int, period int"
MASTER = "code string, name string, list_status string, available_at timestamp, source string, ingested_at timestamp, value string, bucket int"
SECTOR = "code string, sector_code string, sector_type string, valid_from date, valid_to date, available_at timestamp, entity string, key int"


def at(day, hour=0):
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=day, hours=hour)


def on(day):
    return date(2024, 1, 1) + timedelta(days=day)


def bars(spark, rows):
    return spark.createDataFrame([(*r, "s", at(0), 1, 2) for r in rows], BARS)


def test_rolling_latest_version_gaps_and_missing(spark):
    rows = [("a ", on(0), 10.0, 7, 1.0, at(0)), ("A", on(0), 20.0, 14, 2.0, at(1)), ("A", on(0), 20.0, 14, 2.0, at(1)), ("A", on(3), 0.0, None, float("nan"), at(3)), ("A", on(9), 30.0, 1, 1.0, at(9)), (None, on(1), 1.0, 1, 1.0, at(1)), ("B", on(2), None, None, None, None)]
    out = {(r.code, r.trade_date): r for r in rolling.bar_totals(bars(spark, rows)).collect()}
    assert len([k for k in out if k[0] == "A"]) == 10 and ("B", on(2)) in out and not any(k[0] is None for k in out)
    assert (out["A", on(6)].volume_sum_7, out["A", on(7)].volume_sum_7, out["A", on(9)].volume_sum_30) == (14, None, 15)
    assert out["A", on(3)].close_avg_7 == 20.0 and out["A", on(9)].close_avg_30 == 25.0
    assert out["B", on(2)].volume_sum_7 is None and out["B", on(2)].close_avg_30 is None


def test_rolling_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), on(rng.randrange(60)), float(rng.randrange(1, 9)), rng.randrange(100), 1.0, at(rng.randrange(99))) for _ in range(80)]
    latest = {}
    for r in sorted(rows, key=lambda r: (r[5], -r[2], -r[3]), reverse=False):
        k = (r[0].upper(), r[1])
        if k not in latest or r[5] > latest[k][5]:
            latest[k] = r
    unique = list(latest.values())
    for row in rolling.bar_totals(bars(spark, unique)).collect():
        for k in (7, 30):
            inside = [r for (c, d), r in latest.items() if c == row.code and 0 <= (row.trade_date - d).days < k]
            assert (row[f"volume_sum_{k}"] or 0) == sum(r[3] for r in inside)
            assert row[f"close_avg_{k}"] == pytest.approx(sum(r[2] for r in inside) / len(inside)) if inside else row[f"close_avg_{k}"] is None


def test_rolling_empty(spark):
    assert rolling.unusual_days(rolling.bar_totals(bars(spark, []))).count() == 0


def master(spark, rows):
    return spark.createDataFrame([(*r, "v", 1) for r in rows], MASTER)


def sector(spark, rows):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], SECTOR)


def test_as_known_never_sees_the_future(spark):
    m = master(spark, [("a", "n", "L", at(0), "x", at(0)), ("A", "n", "P", at(20), "y", at(20)), ("A", "n", "D", at(20), "x", at(20)), ("A", "n", None, at(50), "x", at(50)), (None, "n", "L", at(1), "x", at(1)), ("A", "n", "L", None, "x", at(1))])
    s = sector(spark, [("A", "S1", "industry", on(0), None, at(1)), ("A", "S1", "industry", on(0), on(5), at(30)), ("A", "S2", "industry", on(6), None, at(30)), ("A", "T", "theme", on(0), None, at(0)), ("A", "S0", "industry", on(9), on(3), at(0))])
    b = bars(spark, [("A", on(4), 1.0, 1, 1.0, at(0, 1)), ("A", on(8), 1.0, 1, 1.0, at(10)), ("A", on(8), 1.0, 1, 1.0, at(10)), ("A", on(8), 1.0, 1, 1.0, at(20)), ("A", on(8), 1.0, 1, 1.0, at(40)), ("A", on(8), 1.0, 1, 1.0, None), ("Z", on(1), 1.0, 1, 1.0, at(3))])
    got = sorted(((r.entity, str(r.day), r.at_us, r.status_then, r.status_now, r.sector_then, r.sector_now) for r in asknown.bars_as_known(b, m, s).collect()), key=str)
    us = lambda d, h=0: int(at(d, h).timestamp() * 1_000_000)
    assert got == sorted(
        [("A", "2024-01-05", us(0, 1), "L", "", None, "S1"), ("A", "2024-01-09", us(10), "L", "", "S1", "S2"), ("A", "2024-01-09", us(20), "D", "", "S1", "S2"), ("A", "2024-01-09", us(40), "D", "", "S2", "S2"), ("Z", "2024-01-02", us(3), None, None, None, None)], key=str
    )


def _brute_known(versions, t, d):
    """Sector known at t for day d (t None: now)."""
    keep = {}
    for code, begin, end, known in versions:
        if (t is None or known <= t) and ((code, begin) not in keep or known > keep[code, begin][1]):
            keep[code, begin] = (end, known)
    valid = [(-known.timestamp(), -begin.toordinal(), -end.toordinal() if end else 1, code) for (code, begin), (end, known) in keep.items() if begin <= d and (end is None or d <= end)]
    return min(valid)[3] if valid else None


@pytest.mark.parametrize("seed", range(3))
def test_as_known_against_brute_force(spark, seed):
    rng = random.Random(seed)
    versions = {}
    for _ in range(14):
        begin = on(rng.randrange(40))
        versions[rng.choice("PQR"), begin, at(rng.randrange(60), rng.randrange(24))] = on(rng.randrange(60)) if rng.random() < 0.6 else None
    rows = [(c, b, e, k) for (c, b, k), e in versions.items()]
    s = sector(spark, [("A", c, "industry", b, e, k) for c, b, e, k in rows])
    events = [(on(rng.randrange(50)), at(rng.randrange(70), rng.randrange(24))) for _ in range(60)]
    known = asknown.bars_as_known(bars(spark, [("A", d, 1.0, 1, 1.0, t) for d, t in events]), master(spark, []), s)
    found = {(r.day, r.at_us): (r.sector_then, r.sector_now) for r in known.collect()}
    assert found == {(d, int(t.timestamp()) * 1_000_000): (_brute_known(rows, t, d), _brute_known(rows, None, d)) for d, t in events}


def test_as_known_hot_entity_is_salted(spark):
    many = [("HOT", on(1), 1.0, i, 1.0, at(1) + timedelta(seconds=i)) for i in range(400)] + [(f"C{i}", on(1), 1.0, 1, 1.0, at(1)) for i in range(50)]
    m = master(spark, [("HOT", "n", "L", at(0), "x", at(0)), ("HOT", "n", "P", at(1) + timedelta(seconds=100), "x", at(1))])
    out = asknown.bars_as_known(bars(spark, many), m, sector(spark, []))
    counts = {r.status_then: r["count"] for r in out.groupBy("status_then").count().collect()}
    assert counts == {"L": 100, "P": 300, None: 50}


def test_as_known_empty(spark):
    assert asknown.bars_as_known(bars(spark, []), master(spark, []), sector(spark, [])).count() == 0


def test_runs_over_word_edges(spark):
    wanted = {("a", "x"): [(0, 200), (203, 203)], ("a", "y"): [(62, 63)], ("b", "x"): [(125, 126), (189, 190)]}
    rows = [(e, v, i) for (e, v), spans in wanted.items() for a, b in spans for i in range(a, b + 1)]
    out = history.runs(spark.createDataFrame(rows + rows[:5], "entity string, value string, idx bigint")).collect()
    found = {}
    for r in out:
        found.setdefault((r.entity, r.value), []).append((r.first_idx, r.last_idx))
    assert {k: sorted(v) for k, v in found.items()} == wanted


def test_listing_history(spark):
    m = master(spark, [("A", " n ", "L", at(0), "x", at(0)), ("a", "n", "L", at(40), "x", at(40)), ("A", "n", "P", at(80), "y", at(80)), ("A", "n", "L", at(80), "x", at(80)), ("A", "n", "D", at(80), "y", at(79)), ("A", "m", "D", at(90), "x", at(90)), ("A", "n", "L", at(95), "x", at(95)), ("A", None, None, at(96), "x", at(96)), (None, "q", "L", at(1), "x", at(1))])
    out = history.attribute_history(m, sector(spark, [])).orderBy("period_from").collect()
    stamp = lambda d: at(d).strftime("%Y-%m-%d %H:%M:%S")
    assert [(r.code, r.value, r.period_from, r.period_to) for r in out] == [("A", "n|L", stamp(0), stamp(90)), ("A", "m|D", stamp(90), stamp(95)), ("A", "n|L", stamp(95), stamp(96)), ("A", "|", stamp(96), "")]


@pytest.mark.parametrize("seed", range(3))
def test_sector_history_against_brute_force(spark, seed):
    rng = random.Random(seed)
    versions = {}
    for _ in range(12):
        versions[rng.choice("PQR"), on(rng.randrange(40)), at(rng.randrange(60), rng.randrange(24))] = on(rng.randrange(60)) if rng.random() < 0.8 else None
    rows = [(c, b, e, k) for (c, b, k), e in versions.items()]
    out = history.sector_history(sector(spark, [("A", c, "industry", b, e, k) for c, b, e, k in rows])).collect()
    days = {}
    for r in out:
        last = on(70).toordinal() - date(1970, 1, 1).toordinal() if r.to_day is None else r.to_day
        for d in range(r.from_day, last + 1):
            assert d not in days
            days[d] = r.value
    base = date(1970, 1, 1).toordinal()
    assert days == {on(i).toordinal() - base: v for i in range(71) if (v := _brute_known(rows, None, on(i)))}
    spans = sorted((r.from_day, r.to_day if r.to_day is not None else 10**9, r.value) for r in out)
    assert all(not (a[1] + 1 == b[0] and a[2] == b[2]) for a, b in zip(spans, spans[1:], strict=False))


def test_history_empty(spark):
    assert history.attribute_history(master(spark, []), sector(spark, [])).count() == 0


EVENTS = "evidence_id string, source_id string, published_at timestamp, first_seen_at timestamp, lane int, n int"


def test_late_outcomes(spark):
    end = datetime(2024, 1, 1, 16, tzinfo=UTC)  # the end of Beijing's 1 January
    pub = end - timedelta(hours=3)
    rows = [("a", "s", pub, end - timedelta(microseconds=1)), ("b", "s", pub, end), ("b", "s", pub, end + timedelta(hours=80)), ("c", "s", pub, end + timedelta(hours=72)), ("d", None, pub, end + timedelta(hours=72) - timedelta(microseconds=1)), ("e", "s", None, end), (None, "s", pub, end), ("f", "s", pub, None)]
    out = late.arrivals(spark.createDataFrame([(*r, 1, 2) for r in rows], EVENTS))
    assert {r.evidence_id: (r.period_day, r.outcome) for r in out.collect()} == {"a": ("2024-01-01", "on_time"), "b": ("2024-01-01", "corrected"), "c": ("2024-01-01", "dropped"), "d": ("2024-01-01", "corrected")}
    totals = {r.source_id: (r.n_on_time, r.n_corrected, r.n_dropped, r.n_final) for r in late.period_totals(out).collect()}
    assert totals == {"s": (1, 1, 1, 2), None: (0, 1, 0, 1)}


def _deliveries(seed, n=200):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"e{i}", rng.choice("st"), start + timedelta(hours=rng.randrange(90)), start + timedelta(hours=rng.randrange(400)), 1, 2) for i in range(n)]
    rows += [(*r[:3], r[3] + timedelta(hours=rng.randrange(-60, 200)), 1, 2) for r in rng.sample(rows, n // 3)]  # redelivered, seen earlier elsewhere
    rng.shuffle(rows)
    return rows


def test_registers_merge_in_any_order_and_again(spark):
    rows = _deliveries(1)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    whole = as_set(late.arrivals(spark.createDataFrame(rows, EVENTS)))
    deltas = [late.registers(spark.createDataFrame(part, EVENTS)) for part in (rows[:90], rows[60:200], rows[200:])]  # disjoint and overlapping
    states = [late.merge(d) for d in deltas]
    assert as_set(late.outcomes(late.merge(states[2], deltas[0], states[1], states[2], states[0]))) == whole
    assert as_set(late.outcomes(late.merge(late.merge(states[0], states[1]), states[2]))) == whole


def test_disjoint_deltas_of_one_day_add_up(spark):
    day = datetime(2024, 1, 1, 2, tzinfo=UTC)
    rows = [(f"e{i}", "s", day, day + timedelta(hours=20, minutes=i), 1, 2) for i in range(8)]
    one, two = (late.registers(spark.createDataFrame(part, EVENTS)) for part in (rows[:5], rows[5:]))
    assert [tuple(r) for r in late.period_totals(late.outcomes(late.merge(one, two))).collect()] == [("s", "2024-01-01", 0, 8, 0, 8)]


def test_lanes_of_writers(spark):
    rows = _deliveries(2)
    found = late.arrivals(spark.createDataFrame(rows, EVENTS)).cache()
    mine, yours = found.where("evidence_id < 'e5'"), found.where("evidence_id >= 'e5'")
    early = late.lane_counts(mine.where("arrived_us % 3 = 0"), "a", 1)  # an older state of the same writer
    states = [late.lane_counts(yours, "b", 1), early, late.lane_counts(mine, "a", 2)]
    as_set = lambda df: {tuple(r) for r in df.collect()}
    want = as_set(late.period_totals(found))
    assert as_set(late.period_totals(late.merge_lanes(*states, states[1], states[0]))) == want
    assert as_set(late.period_totals(late.merge_lanes(late.merge_lanes(states[2], states[0]), states[1]))) == want


def test_late_empty(spark):
    assert late.period_totals(late.arrivals(spark.createDataFrame([], EVENTS))).count() == 0
