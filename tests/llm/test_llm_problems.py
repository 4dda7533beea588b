"""Operators of the llm subpackage against brute force, with nulls, ties, copies, empty and long texts, clashing columns."""

from __future__ import annotations

import random
import string
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest

from tapeline.llm import batches, encode, groups, leaks, lookalike, topn
from tapeline.llm import queries as llm_queries
from tapeline.llm.text import one_form
from tapeline.scratch import Scratch, new_path
from tapeline.session import ship
from tests.oracle import same

UTC = timezone.utc


@pytest.fixture(scope="module", autouse=True)
def _ship(spark):
    ship(spark)


# groups


def uid(n: int) -> str:
    h = f"{n:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def _roots(members):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for g, i in members:
        if i is None:
            continue
        parent.setdefault(i, i)
        if g is not None:
            a, b = find(i), find(first.setdefault(g, i))
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _consolidated(spark, members, seed=0):
    rng = random.Random(seed)
    dirty = [(g, i if i is None else rng.choice((i, i.upper(), i.replace("-", ""), f" {i} ")), True, 5) for g, i in members]
    frame = spark.createDataFrame(dirty, "duplicate_group_id string, evidence_id string, n boolean, label int")
    return {r.evidence_id: r.group_id for r in groups.consolidate(frame).collect()}


def test_groups_chain_star_and_dirt(spark):
    rng = random.Random(1)
    order = list(range(300))
    rng.shuffle(order)
    members = [(f"c{k}", uid(order[k + j])) for k in range(299) for j in (0, 1)]  # a long chain in random order
    members += [(f"s{k}", uid(n)) for k, pair in enumerate((1000, 1000 + j) for j in range(1, 200)) for n in pair]  # a star
    members += [("all", uid(5000 + j)) for j in range(50)] + [("self", uid(7000)), ("self", uid(7000)), (None, uid(7001)), ("x", None), (None, None), ("s0", uid(1000))]
    assert _consolidated(spark, members) == _roots(members)


@pytest.mark.parametrize("seed", range(2))
def test_groups_random(spark, seed):
    rng = random.Random(seed)
    members = [(f"g{rng.randrange(150)}", uid(rng.randrange(260))) for _ in range(300)]
    assert _consolidated(spark, members, seed) == _roots(members)


def test_groups_sorted_chain_needs_few_rounds(spark):
    members = [(f"c{k}", uid(k + j)) for k in range(400) for j in (0, 1)]
    assert set(_consolidated(spark, members).values()) == {uid(0)}


def test_groups_empty(spark):
    assert _consolidated(spark, []) == {}
    edges = spark.createDataFrame([(1, 1)], "u bigint, v bigint")
    assert groups.components(edges, Scratch(spark, "t")).count() == 0


# top n

CANDIDATES = "run_id string, trade_date date, code string, horizon string, final_score double, created_at timestamp, _x int, b int"


def test_top_n_ties_corrections_and_hot_group(spark):
    rng = random.Random(2)
    day, start = datetime(2024, 1, 1).date(), datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"r{i % 7}", day, f"{i:03d}.sz ", rng.choice((" Short", "short")), float(rng.randrange(4)), start, 1, 2) for i in range(500)]
    rows += [(r[0], r[1], r[2], r[3], rng.choice((9.0, float("nan"), None)), start + timedelta(hours=1), 1, 2) for r in rows[:30]]
    rows += rows[100:120] + [("q", day, "A", "mid", 1.0, start, 1, 2), ("q", day, "A", None, 1.0, start, 1, 2), ("q", None, "A", "mid", 1.0, start, 1, 2)]
    latest = {}
    for r in rows:
        k = (r[0], r[2].strip().upper(), r[3] and r[3].strip().lower())
        if k not in latest or r[5] > latest[k][0]:
            latest[k] = (r[5], r[4], r[1])
    want = defaultdict(list)
    for (run, code, horizon), (_, score, d) in latest.items():
        if score is not None and score == score:
            want[d and str(d), horizon].append((-score, code, run))
    want = {(d, h, code, run) for (d, h), v in want.items() for _, code, run in sorted(v)[:10]}
    frame = spark.createDataFrame(rows, CANDIDATES).repartition(7)
    out = topn.best_candidates(frame).select("trade_date", "horizon", "code", "run_id").collect()
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert topn.best_candidates(frame.where("1 = 0")).count() == 0


# batches

EVIDENCE = "evidence_id string, batch_no int, first_seen_at timestamp, title string, content string, f1 int, kept string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def _letters(title, content):
    return "".join(c for c in f"{title or ''} {content}".lower() if c.isalnum())


def _runs(text):
    return {text[i : i + 5] for i in range(len(text) - 4)}


def _brute_repeats(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[2]):
        first.setdefault(r[0], r)
    kept = [(r[1], r[0], _runs(_letters(r[3], r[4]))) for r in first.values() if r[4] and r[4].strip()]
    accepted, found = [], set()
    for batch, name, own in sorted(kept, key=lambda x: x[0]):
        hits = [o for o in accepted if o[0] < batch and own and o[2] and len(own & o[2]) >= 0.55 * len(own | o[2])] if batch > 0 else []
        found |= {tuple(sorted((name, o[1]))) for o in hits}
        if not hits:
            accepted.append((batch, name, own))
    return found


def _evidence(seed, n=160):
    rng = random.Random(seed)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 10))) for _ in range(900)]
    phrase = " ".join(words[:12])
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(25, 60)))
        if rows and rng.random() < 0.4:
            base = rng.choice(rows)[4] or text
            parts = base.split()
            for _ in range(rng.randrange(0, max(1, len(parts) // 9))):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        if rng.random() < 0.3:
            text += " " + phrase
        rows.append((f"e{i:04d}", rng.randrange(3), START + timedelta(minutes=i), rng.choice((None, "Title", "TITLE")), text, 1, "x"))
    rows += [(r[0], rng.randrange(3), r[2] + timedelta(days=1), r[3], r[4], 1, "x") for r in rows[::9]]
    rows += [("n1", 1, START, "t", None, 1, "x"), ("n2", 1, START, "t", "  ", 1, "x"), ("n5", 1, START, "a title long enough to be compared with", "\t\u3000\n", 1, "x"), ("n6", 2, START, "a title long enough to be compared with", "\u00a0", 1, "x"), ("n3", 2, START, None, "...", 1, "x"), ("n4", None, START, "t", "abc", 1, "x"), (None, 1, START, "t", "abc", 1, "x")]
    return rows


@pytest.mark.parametrize("seed", [0])
def test_batches_against_brute_force(spark, seed):
    rows = _evidence(seed)
    out = [tuple(r) for r in batches.batch_repeats(spark.createDataFrame(rows, EVIDENCE)).collect()]
    want = _brute_repeats([r for r in rows if r[0] and r[1] is not None])
    assert len(out) == len(set(out)) and set(out) == want and len(want) > 20


def test_batches_one_by_one_agree_with_the_table_at_once(spark):
    rows = [r for r in _evidence(7) if r[0] and r[1] is not None]
    first = {}
    for r in sorted(rows, key=lambda r: r[2]):
        first.setdefault(r[0], r)
    rows = list(first.values())
    at_once = {tuple(r) for r in batches.batch_repeats(spark.createDataFrame(rows, EVIDENCE)).collect()}
    store = batches.History(spark, new_path(spark, "history"))
    store.start(spark.createDataFrame([r for r in rows if r[1] == 0], EVIDENCE))
    found = set()
    for b in (1, 2):
        found |= {tuple(r) for r in store.check(spark.createDataFrame([r for r in rows if r[1] == b], EVIDENCE), b).collect()}
    assert found == at_once and found
    again = {tuple(r) for r in store.check(spark.createDataFrame([r for r in rows if r[1] == 2], EVIDENCE), 2).collect()}
    assert again <= at_once


def test_batches_hot_copies_and_empty(spark):
    text = "the same notice goes out to every reader of the venue today"
    rows = [(f"a{i:03d}", 0 if i < 40 else 1, START, "t", text, 1, "x") for i in range(60)]
    assert batches.batch_repeats(spark.createDataFrame(rows, EVIDENCE)).count() == 40 * 20
    assert batches.batch_repeats(spark.createDataFrame([], EVIDENCE)).count() == 0


def _family(seed, n=300, letters=200, edits=(2, 7)):
    rng = random.Random(seed)
    base = "".join(rng.choice(string.ascii_lowercase) for _ in range(letters))
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(letters), rng.randrange(*edits)):
            own[at] = rng.choice(string.ascii_lowercase)
        rows.append((f"e{i:04d}", i % 2, START + timedelta(minutes=i), None, "".join(own), 1, "x"))
    return rows


def test_batches_large_family_of_near_copies(spark):
    """More than RARE near-copies of one text with scattered edits: all that they share is common, the rest is unique."""
    rows = _family(12)
    frame = spark.createDataFrame(rows, EVIDENCE)
    want = _brute_repeats(rows)
    out = {tuple(r) for r in batches.batch_repeats(frame).collect()}
    assert out <= want and len(out) >= 0.9 * len(want) and len(want) > 5000
    exact = [tuple(r) for r in batches.batch_repeats(frame, exact=True).collect()]
    assert len(exact) == len(set(exact)) and set(exact) == want


def test_batches_lose_no_pair_of_a_large_family_unasked(spark, monkeypatch):
    """By default, and with the new texts sent in several blocks, and accepted texts taken a few at a time."""
    rows = _family(12) + [("s1", 0, START, None, "abcdefg", 1, "x"), ("s2", 1, START, None, "abcdefgh", 1, "x"), ("s3", 1, START, None, "abcdexyz", 1, "x")]
    want = _brute_repeats(rows)
    for name, value in (("NEW_AT_ONCE", 4000), ("OLD_TEXTS", 20), ("AT_ONCE", 1000), ("CELLS", 50)):
        monkeypatch.setattr(batches, name, value, raising=False)
    out = [tuple(r) for r in batches.batch_repeats(spark.createDataFrame(rows, EVIDENCE)).collect()]
    assert len(out) == len(set(out)) and set(out) == want and ("s1", "s2") in want


def test_batches_small_families_lose_nothing(spark):
    rows = []
    for k in range(12):
        rows += [(f"{r[0]}-{k}", *r[1:]) for r in _family(20 + k, n=24, letters=120 + 30 * k, edits=(1, 6))]
    out = {tuple(r) for r in batches.batch_repeats(spark.createDataFrame(rows, EVIDENCE)).collect()}
    want = _brute_repeats(rows)
    assert out == want and len(want) > 1000


def test_batches_full_bitmaps(spark, monkeypatch):
    """Bitmaps far too small for the table let everything through, and change nothing."""
    rows = _evidence(11)
    frame = spark.createDataFrame(rows, EVIDENCE)
    monkeypatch.setattr(batches, "SLOTS", 2)
    out = {tuple(r) for r in batches.batch_repeats(frame).collect()}
    assert out == _brute_repeats([r for r in rows if r[0] and r[1] is not None])


def test_a_batch_reads_the_chunks_it_compares_only(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(300))
    old = [(f"a{i:03d}", 0, START, None, text(), 1, "x") for i in range(300)]
    store = batches.History(spark, new_path(spark, "history"))
    store.start(spark.createDataFrame(old, EVIDENCE))
    table = store._read("chunks", batches._CHUNKS, 1)
    own = batches.chunk_rows(batches.text_classes(batches.digest(spark.createDataFrame(old[:3], EVIDENCE))), store.rule)
    read = batches.marked(table, "h", batches.bitmap(own.select("h"))).count()
    want = table.join(own.select("h").distinct(), "h", "left_semi").count()
    assert want <= read <= 1.05 * want and table.count() > 20 * want


def test_redelivery_of_a_refused_record_is_decided_once(spark):
    body = "the same notice goes out to every reader of the venue today"
    store = batches.History(spark, new_path(spark, "history"))
    one = lambda name, b, text: spark.createDataFrame([(name, b, START, "t", text, 1, "x")], EVIDENCE)
    store.start(one("a", 0, body))
    assert store.check(one("b", 1, body), 1).count() == 1
    assert store.check(one("b", 2, body), 2).count() == 0
    assert [tuple(r) for r in store.check(one("c", 3, body + " and tomorrow"), 3).collect()] == [("a", "c")]


def test_rule_follows_from_the_threshold():
    low, high = batches.Rule(0.55), batches.Rule(0.8)
    assert low.both_ways > high.both_ways >= batches.SHORT / 0.8 and 0.59 < low.left_out < 0.61 < high.left_out < high.common


# encoding


def test_encoding_is_exact(spark):
    rng = random.Random(4)
    pieces = ["it's", " don't", "'s", "''", "  ", "\t", "\n\n", " ", "hello", "World", "123", "4,5", "涨停", "公告,", "。", "é", "é", "​", "<|endoftext|>", "🚀", "👩‍💻", "\x00", "ʼs", "’s", "   x", "!!", "_", "½", "ﬁ", "ΑΒ", "\x85", "\x1c"]
    texts = [None, "", " ", "'", "x" * 30_000, "涨" * 5_000, "a " * 20_000] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    texts += ["A filing shows that " + t for t in texts[20:60] if t] * 2
    frame = spark.createDataFrame([(i, t, 7, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, h1 int, chunk string")
    out = {r.doc_id: r.ids for r in encode.encode(frame).collect()}
    plain = encode.encoding(encode.tokenizer_path())
    assert out == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode.encode(frame.where("1 = 0")).count() == 0


def test_chunks_are_reused_and_joins_repaired(spark):
    rng = random.Random(9)
    text = " ".join(f"On {rng.randrange(30)} July, lender {rng.randrange(99999)} forecast a plan to sell {rng.randrange(999)} data racks; 研究所表示,编号{rng.randrange(9999)}将调整。" for _ in range(200))
    texts = [text, "", "one two three. " + text, text[17:] + " end", text.replace("data", "date"), "y" * 2_000, "don't " * 300]
    own = encode.Dictionary(encode.tokenizer_path())
    out = encode.encode_texts(texts, own)
    assert out == [encode.encoding(encode.tokenizer_path()).encode_ordinary(t) for t in texts] and own.whole == 0
    points, starts = encode.code_points(texts[:1])
    chunks = len(encode.chunk_begins(points, starts))
    joins = set(encode.chunk_begins(points, starts).tolist()) - set(encode.safe_places(points).tolist())
    assert chunks > 20 and len(joins) > 10
    before = own.encoded
    encode.encode_texts([text + " again"], own)
    assert own.encoded - before < 0.1 * chunks


def test_a_full_dictionary_changes_nothing(monkeypatch):
    monkeypatch.setattr(encode, "DICTIONARY", 100)
    rng = random.Random(10)
    texts = ["".join(rng.choice("ab c'1!涨 ") for _ in range(300)) for _ in range(50)]
    own = encode.Dictionary(encode.tokenizer_path())
    assert encode.encode_texts(texts, own) == [encode.encoding(encode.tokenizer_path()).encode_ordinary(t) for t in texts] and len(own.held) < 50


# leaks


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh涨跌é") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)] + [(90, None), (91, ""), (92, "short"), (None, "x" * 80)]
    items.append((12, items[0][1][:120] + " other end of the item"))
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(50))
        if i % 3 == 0:
            whole = items[rng.randrange(12)][1]
            a = rng.randrange(len(whole) // 2)
            part = whole[a : a + rng.randrange(60, 130)]
            part = part.upper() if i % 2 else part.replace("e", "е").replace("a", "ａ").replace(" ", "-​\n")
            text += part + " " + word()
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, items[3][1] * 500)]
    clean = lambda t: "".join(c for c in one_form(t).lower() if c.isalnum())
    want = set()
    for i, t in docs:
        body = clean(t or "")
        for k, it in items:
            if k is not None and it:
                own = clean(it)
                want |= {(i, k) for a in range(len(own) - 59) if own[a : a + 60] in body}
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    out = [tuple(r) for r in leaks.leaks(d, e).collect()]
    assert len(out) == len(set(out)) and set(out) == want and len(want) > 15
    spans = leaks.leaks(d, e, spans=True).where("doc_id = 202 and item_id = 3").collect()
    assert [(s.span_from, s.span_to) for s in spans] == [(0, len(clean(items[3][1])) * 500)]
    assert {r.doc_id for r in leaks.without_leaks(d, leaks.leaks(d, e)).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert leaks.leaks(d, e.where("1 = 0")).count() == 0 and leaks.leaks(d.where("1 = 0"), e).count() == 0


def test_passages_are_cut_out_and_the_rest_stays(spark):
    rng = random.Random(8)
    one, two = ("".join(rng.choice(string.ascii_lowercase) for _ in range(90)) for _ in range(2))
    shown = one.upper().replace("A", "\u0410").replace("E", "E\u200b") + "\u00ad"
    texts = {
        1: f"before, {shown}; between: {two[5:80]} after.", 2: "nothing here", 3: None, 4: "", 5: one, 6: f"{one[:70]} {one[20:]}",
        7: f"e\u200b\u0301 \u1112\u1161\u11ab {' '.join(two)}\u0130 end", 8: one[:59],
    }
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in texts.items()], "doc_id bigint, text string, span_from int, _spans2 string")
    items = spark.createDataFrame([(1, one), (2, two), (3, one + two)], "item_id bigint, text string")
    out = {r.doc_id: r.text for r in leaks.without_passages(docs, items).collect()}
    gone = two[5:80]
    assert out == {1: "before, \u00ad; between:  after.", 2: "nothing here", 3: None, 4: "", 5: "", 6: "", 7: "e\u200b\u0301 \u1112\u1161\u11ab \u0130 end", 8: one[:59]} and gone not in out[1]
    assert leaks.without_passages(docs, items).columns == docs.columns
    spans = leaks.leaks(docs, items, spans=True).where("doc_id = 1 and item_id in (1, 2)").collect()
    assert len(spans) == 2 and all(s.span_to - s.span_from in (90, 75) for s in spans)
    assert leaks.leaks(docs, leaks.without_passages(docs, items).selectExpr("doc_id as item_id", "text").where("1 = 0")).count() == 0
    assert leaks.leaks(leaks.without_passages(docs, items), items).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, f"item {i} " + "".join(rng.choice(string.ascii_lowercase) for _ in range(100))) for i in range(6)], "item_id bigint, text string")
    docs = items.selectExpr("item_id + 100 as doc_id", "concat('before ', text, ' after') as text")
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 150)
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == {(100 + i, i) for i in range(6)}


# look-alikes


def test_lookalikes(spark):
    texts = {
        1: "Café nord", 2: "Café nord", 3: "Сafé nord", 4: "Cafe nord", 5: "Cafe nord", 6: "café nord", 7: "Ca​fé nord", 8: "Café nord.", 9: "Café nord",
        10: None, 11: "", 12: "  ", 13: "  ", 14: "Ｃafé　nord", 15: "Ca\x01fé nord", 16: "ё", 17: "ë", 18: "m²", 19: "m2", 20: "ß", 21: "ss", 22: "β", 23: "b", 24: "Ο1", 25: "O1",
        26: "x" * 20_000 + "é", 27: "x" * 20_000 + "é", 28: "A\nB", 29: "A B", 30: "1", 31: "１", 32: "ё", 33: "a­b", 34: "ab", 35: "q̣̇", 36: "q̣̇",
        37: "wire text \u2764", 38: "wire text \u2764\ufe0f", 39: "a\u17b4b c", 40: "ab c", 41: "a\u0640z", 42: "az", 43: "x\u0591y", 44: "xy",
    }
    frame = spark.createDataFrame([(k, v, 1, "z") for k, v in texts.items()], "doc_id bigint, text string, skel int, form string")
    by = defaultdict(list)
    for k, v in texts.items():
        if v and one_form(v).strip():
            by[one_form(v)].append(k)
    want = {(a, b) for ids in by.values() for a in ids for b in ids if a < b and texts[a] != texts[b]}
    out = [tuple(r) for r in lookalike.pairs(lookalike.variants(frame)).collect()]
    assert len(out) == len(set(out)) and set(out) == want
    assert {(1, 2), (1, 3), (1, 14), (16, 17), (24, 25), (26, 27), (30, 31), (16, 32), (17, 32), (33, 34), (35, 36)} <= want and not {(1, 4), (1, 6), (1, 15), (18, 19), (20, 21), (22, 23), (28, 29)} & want
    canonical = {r.doc_id: r.canonical_id for r in lookalike.variants(frame).collect()}
    assert {(37, 38), (39, 40)} <= want and not {(41, 42), (43, 44)} & want
    assert all(canonical[x] == 1 for x in (1, 2, 3, 7, 9, 14)) and canonical[5] == 4 and 8 not in canonical
    assert lookalike.variants(frame.where("1 = 0")).count() == 0


# registered queries


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(spark, llm_queries.QUERIES[name], llm_queries.ORACLES[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(llm_queries.QUERIES) - set(llm_queries.ORACLES)))
def test_query_runs(spark, name):
    assert llm_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
