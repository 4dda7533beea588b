"""Queries of this subpackage's problems, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from tapeline.llm import batches, encode, groups, leaks, lookalike, topn
from tapeline.llm.text import char_map
from tapeline.sources.tables import table


def p1_found(spark, sf):
    return groups.consolidate(table(spark, sf, "market_event_duplicate_members"))


P1_FOUND = """with recursive r as (select lower(trim(evidence_id)) p, replace(lower(trim(evidence_id)), '-', '') b, duplicate_group_id g from market_event_duplicate_members where evidence_id is not null),
m as (select case when length(b) = 32 then b[1:8] || '-' || b[9:12] || '-' || b[13:16] || '-' || b[17:20] || '-' || b[21:32] else p end id, g from r),
low as (select g, min(id) lo from m where g is not null group by g), e as (select distinct m.id a, low.lo b from m join low using (g) where m.id <> low.lo), ee as (select a, b from e union select b, a from e),
cc(id, label) using key (id) as (select distinct id, id from m union (select ee.a, min(cc.label) from cc join ee on ee.b = cc.id join recurring.cc cur on cur.id = ee.a where cc.label < cur.label group by ee.a))
select id evidence_id, label group_id from cc"""


def p2_found(spark, sf):
    return topn.best_candidates(table(spark, sf, "analysis_decision_candidates")).select("trade_date", "horizon", "code", "run_id")


P2_FOUND = """with o as (select run_id, upper(trim(code)) code, lower(trim(horizon)) horizon, trade_date, final_score, row_number() over
 (partition by run_id, upper(trim(code)), lower(trim(horizon)) order by created_at desc, final_score desc) rn from analysis_decision_candidates),
s as (select * from o where rn = 1 and final_score is not null and not isnan(final_score)),
r as (select *, row_number() over (partition by trade_date, horizon order by final_score desc, code, run_id) k from s)
select trade_date::date::varchar trade_date, horizon, code, run_id from r where k <= 10"""


def p4_found(spark, sf):
    return batches.batch_repeats(table(spark, sf, "market_event_evidence"))


_STEPS = ", ".join(
    f"x{k} as materialized (select b.id, c.a old from r b join c on c.id = b.id where b.batch_no = {k} and c.a_batch < {k} and c.a not in (select id from gone{k - 1})), gone{k} as materialized (select id from gone{k - 1} union select id from x{k})"
    for k in range(1, 7)
)
P4_FOUND = f"""with f as (select * from market_event_evidence qualify row_number() over (partition by evidence_id order by first_seen_at, batch_no) = 1),
r as materialized (select evidence_id id, batch_no, regexp_replace(lower(coalesce(title, '') || ' ' || content), '[^\\p{{L}}\\p{{N}}]', '', 'g') t from f where length(trim(content)) > 0),
g as materialized (select distinct id, batch_no, substr(t, k.k, 5) g from r, lateral (select unnest(generate_series(1, length(t) - 4)) k) k), n as (select id, count(*) n from g group by 1),
s as (select a.id x, b.id y, count(*) k from g a join g b on a.g = b.g and a.batch_no < b.batch_no group by 1, 2),
c as materialized (select s.y id, s.x a, ra.batch_no a_batch from s join n na on na.id = s.x join n nb on nb.id = s.y join r ra on ra.id = s.x where s.k >= 0.55 * (na.n + nb.n - s.k)),
gone0 as (select '' id), {_STEPS} {" union ".join(f"select least(id, old) evidence_a, greatest(id, old) evidence_b from x{k}" for k in range(1, 7))}"""


def p8_ids(spark, sf):
    return encode.encode(table(spark, sf, "documents"))


def _sql_text(points: list[int]) -> str:
    return "concat(" + ", ".join(f"chr({c})" for c in points) + ")"


_KEPT, _GONE = sorted(k for k, v in char_map().items() if v is not None), sorted(k for k, v in char_map().items() if v is None)
_FORM = f"nfc_normalize(translate(text, {_sql_text(_KEPT + _GONE)}, {_sql_text([char_map()[k] for k in _KEPT])}))"
_LETTERS = f"regexp_replace(lower({_FORM}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
P9_FOUND = f"""with i as (select item_id, {_LETTERS} t from eval_items where text is not null), d as (select doc_id, {_LETTERS} t from documents where text is not null),
gi as (select distinct item_id, substr(t, k.k, 60) g from i, lateral (select unnest(generate_series(1, length(t) - 59)) k) k), gd as (select doc_id, substr(t, k.k, 60) g from d, lateral (select unnest(generate_series(1, length(t) - 59)) k) k)
select distinct doc_id, item_id from gd join gi using (g)"""
P10_FOUND = f"""with f as (select doc_id, text, {_FORM} form from documents where text is not null), k as (select * from f where length(trim(regexp_replace(form, '\\s', '', 'g'))) > 0)
select a.doc_id doc_a, b.doc_id doc_b from k a join k b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""


def p9_found(spark, sf):
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark, sf):
    return lookalike.pairs(lookalike.variants(table(spark, sf, "documents")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
ORACLES = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p9_found": P9_FOUND, "p10_found": P10_FOUND}
