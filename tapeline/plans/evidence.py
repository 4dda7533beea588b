"""Queries of the evidence pipeline, decision merge, and event streams replayed as batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, clean_word, round_half
from tapeline.functions import text as X
from tapeline.operators import bars as B
from tapeline.operators import pit
from tapeline.plans import sql as S
from tapeline.plans.market import MASTER, SECTOR_ON, day, master_of, r4
from tapeline.plans.signals import bars_of
from tapeline.scratch import Scratch
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}
E = "market_event_evidence"


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def ev(spark, sf):
    return table(spark, sf, E)


SQUEEZE = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_T, _C = SQUEEZE.format("title"), SQUEEZE.format("content")
_HASH = f"sha256({_T} || chr(0) || {_C})"
_FIRST = f"first as (select * from {E} qualify row_number() over (partition by evidence_id order by first_seen_at, batch_no) = 1)"


def first(spark, sf):
    return pit.newest(ev(spark, sf), ["evidence_id"], [F.asc("first_seen_at"), F.asc("batch_no")])


@query("evt_normalize_text", f"select evidence_id, {_T} title, length({_C}) n from {E}")
def evt_normalize_text(spark, sf):
    return ev(spark, sf).select("evidence_id", X.squeeze("title").alias("title"), F.length(X.squeeze("content")).cast("bigint").alias("n"))


@query("evt_content_hash", f"select evidence_id, {_HASH} hash from {E}")
def evt_content_hash(spark, sf):
    return ev(spark, sf).select("evidence_id", X.content_hash("title", "content").alias("hash"))


@query("evt_title_derive", f"select evidence_id, substr(content, 1, 120) title from {E}")
def evt_title_derive(spark, sf):
    return ev(spark, sf).select("evidence_id", F.substring("content", 1, 120).alias("title"))


@query("evt_latest_version", f"select source_id, source_item_id, version, evidence_id from {E} qualify row_number() over (partition by source_id, source_item_id order by version desc, created_at desc, evidence_id, first_seen_at) = 1")
def evt_latest_version(spark, sf):
    order = [F.desc("version"), F.desc("created_at"), F.asc("evidence_id"), F.asc("first_seen_at")]
    return pit.newest(ev(spark, sf), ["source_id", "source_item_id"], order).select("source_id", "source_item_id", "version", "evidence_id")


@query("evt_lineage_group", f"select source_id, source_item_id, string_agg(version::varchar || ':' || evidence_id, ',' order by version, evidence_id) lineage from (select distinct source_id, source_item_id, version, evidence_id from {E}) group by 1, 2")
def evt_lineage_group(spark, sf):
    rows = ev(spark, sf).select("source_id", "source_item_id", "version", "evidence_id").distinct()
    line = F.transform(F.sort_array(F.collect_list(F.struct("version", "evidence_id"))), lambda s: F.concat_ws(":", s["version"].cast("string"), s["evidence_id"]))
    return rows.groupBy("source_id", "source_item_id").agg(F.array_join(line, ",").alias("lineage"))


@query("evt_cosine", f"with e as (select label, vec_id, embedding::double[] a, lag(embedding::double[]) over (partition by label order by vec_id) b from embeddings) select vec_id, {S.r4('greatest(0, least(1, list_cosine_similarity(a, b)))')} similarity from e where b is not null")
def evt_cosine(spark, sf):
    """Each vector with the one before it under the same label."""
    e = table(spark, sf, "embeddings").withColumn("b", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.where("b is not null").select("vec_id", r4(X.cosine(F.col("embedding"), F.col("b"))).alias("similarity"))


NEAR = 0.92
_LONG, _BEGIN = 20, 16  # letters of content from which two that are near share so many letters at their beginning


def near_duplicates(rows):
    """One row a record: its class of equal texts, its number of links to other records with a score of NEAR, and the best score.

    The score is the mean of the Jaccard share of the titles' words and the common prefix of the contents (256 letters),
    or the titles' alone where a content is null. Records equal in both are one class. The mean reaches NEAR only if both
    parts reach 2 * NEAR - 1, so such titles share one of their rarest words and such contents their beginning; classes
    meet on these, in any source and on any date. Links are counted by class, copies within it included. The score of a
    record without a link is null.
    """
    least = 2 * NEAR - 1
    normal = lambda c: F.lower(X.squeeze(c))
    words = F.sort_array(F.array_distinct(F.split(normal("title"), " ")))
    prefix = F.when(F.col("content").isNotNull(), F.substring(normal("content"), 1, 256))
    scratch = Scratch(rows.sparkSession, "near")
    digest = lambda *c: F.unhex(F.sha2(F.concat_ws("\x00", *c), 256))
    texts = rows.select("evidence_id", words.alias("w"), prefix.alias("c"))
    members = scratch.cut(texts.select("evidence_id", digest("w").alias("t"), digest("w", F.lit(""), F.col("c").isNull().cast("string"), "c").alias("h"), "w", "c"))
    classes = scratch.cut(members.groupBy("h").agg(F.min("evidence_id").alias("k"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("t", "w", "c")).alias("x")).select("h", "k", "copies", "x.*"))
    words_of = classes.groupBy("t").agg(F.min("w").alias("w")).select("t", F.size("w").alias("size"), F.explode("w").alias("word"))
    common = words_of.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    first_few = F.slice(F.sort_array(F.collect_list(F.struct("n", "word"))), F.lit(1), F.first(F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1).cast("int"))
    rare = words_of.join(common, "word").groupBy("t").agg(first_few.alias("r")).select("t", F.explode("r.word").alias("word"))
    size = F.length("c")
    short, long = F.concat(F.lit("S"), F.substring("c", 1, 1)), F.when(size >= _LONG, F.concat(F.lit("L"), F.substring("c", 1, _BEGIN)))
    own = F.when(F.col("c").isNull(), "N").when(size >= _LONG, long).when(size > 0, short)
    met_as = F.array_compact(F.array(F.lit("N"), F.when(size > 0, short), long))
    keyed = classes.select("t", "k", F.size("w").alias("size"), own.alias("own"), met_as.alias("keys")).join(rare, "t")
    a = keyed.where("own is not null").select(F.col("k").alias("a"), F.col("size").alias("sa"), "word", F.col("own").alias("key"))
    b = keyed.select(F.col("k").alias("b"), F.col("size").alias("sb"), "word", F.explode("keys").alias("key"))
    near = F.least("sa", "sb") >= least * F.greatest("sa", "sb") - 1e-6
    pairs = a.join(b, ["word", "key"]).where(near & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [classes.select(F.col("k").alias(x), F.col("w").alias(f"w{x}"), F.col("c").alias(f"c{x}"), F.col("copies").alias(f"n{x}")) for x in "ab"]
    title = X.jaccard(F.col("wa"), F.col("wb"))
    score = F.when(F.col("ca").isNull() | F.col("cb").isNull(), title).otherwise((title + X.common_prefix(F.col("ca"), F.col("cb"))) / 2)
    scored = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", score.alias("score")).where(F.col("score") >= NEAR)
    copies = classes.where((F.col("copies") > 1) & (F.col("c").isNull() | (size > 0))).select("k", (F.col("copies") - 1).alias("links"), F.lit(1.0).alias("score"))
    each = scored.select(F.col("a").alias("k"), F.col("nb").alias("links"), "score").unionByName(scored.select(F.col("b").alias("k"), F.col("na").alias("links"), "score")).unionByName(copies)
    links = each.groupBy("k").agg(F.sum("links").alias("links"), F.max("score").alias("score"))
    out = members.select("evidence_id", "h").join(classes.select("h", "k"), "h").join(links, "k", "left")
    decision = F.when(F.col("links") > 0, "near_duplicate").otherwise("distinct")
    return out.select("evidence_id", F.col("k").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), r4(F.col("score")).alias("score"), decision.alias("decision"))


@query("evt_source_entropy", f"with g as (select effective_trade_date d, source_id, count(*) n from {E} where effective_trade_date is not null group by 1, 2), t as (select *, sum(n) over (partition by d) t from g) select d::varchar trade_date, {S.r4('(sum(-(n / t) * log2(n / t)) + 0.00000001)')} entropy from t group by d")
def evt_source_entropy(spark, sf):
    g = ev(spark, sf).where("effective_trade_date is not null").groupBy("effective_trade_date", "source_id").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("effective_trade_date"))
    return g.withColumn("p", p).groupBy("effective_trade_date").agg(F.sum(-F.col("p") * F.log2("p")).alias("e")).select(day("effective_trade_date"), r4(F.col("e") + 1e-8).alias("entropy"))


@query("evt_representative", f"with {_FIRST} select lower(content_hash) hash, evidence_id from first where content_hash is not null qualify row_number() over (partition by lower(content_hash) order by published_at nulls last, evidence_id) = 1")
def evt_representative(spark, sf):
    rows = first(spark, sf).where("content_hash is not null").withColumn("hash", F.lower("content_hash"))
    return pit.newest(rows, ["hash"], [F.asc_nulls_last("published_at"), F.asc("evidence_id")]).select("hash", "evidence_id")


@query("evt_delta", f"""with {_FIRST}, a as (select source_id s, lower(content_hash) h, row_number() over (partition by source_id, lower(content_hash) order by evidence_id) k, evidence_id i, status st from first where batch_no = 0 and content_hash is not null),
b as (select source_id s, lower(content_hash) h, row_number() over (partition by source_id, lower(content_hash) order by evidence_id) k, evidence_id i, status st from first where batch_no > 0 and content_hash is not null)
select case when a.i is null then 'new' when b.i is null then 'removed' when a.st = b.st then 'repeated' else 'status' end delta, count(*) n from a full join b on a.s = b.s and a.h = b.h and a.k = b.k group by 1""")
def evt_delta(spark, sf):
    """History against later batches by (source, hash); duplicates pair by position, then a full outer join."""
    k = F.row_number().over(Window.partitionBy("s", "h").orderBy("i"))
    rows = first(spark, sf).where("content_hash is not null").select("batch_no", F.col("source_id").alias("s"), F.lower("content_hash").alias("h"), F.col("evidence_id").alias("i"), F.col("status").alias("st"))
    a, b = (rows.where(c).drop("batch_no").withColumn("k", k).alias(n) for n, c in (("a", "batch_no = 0"), ("b", "batch_no > 0")))
    on = (F.col("a.s") == F.col("b.s")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.k") == F.col("b.k"))
    kind = F.when(F.col("a.i").isNull(), "new").when(F.col("b.i").isNull(), "removed").when(F.col("a.st") == F.col("b.st"), "repeated").otherwise("status")
    return a.join(b, on, "full_outer").groupBy(kind.alias("delta")).agg(F.count(F.lit(1)).alias("n"))


_CODE_IN = "regexp_extract(title, '[0-9]{7}\\.(SH|SZ|BJ)')"


@query("evt_entity_link", f"""with {MASTER}, {_FIRST}, e as (select evidence_id, {_CODE_IN} c, regexp_extract(title, '[0-9]{{7}}') short from first), sh as (select split_part(code, '.', 1) short, count(*) n, min(code) code from master group by 1)
select evidence_id, case when m.code is not null then m.code when sh.n = 1 then sh.code end code, case when m.code is not null then 1.0::double when sh.n = 1 then 0.95::double when sh.n > 1 then 0.5::double else 0.0::double end confidence
from e left join master m on m.code = e.c left join sh on sh.short = e.short""")
def evt_entity_link(spark, sf):
    """Cascade: exact code, unique short code, ambiguous, unresolved."""
    m = master_of(spark, sf).select("code").withColumn("exact", F.col("code"))
    short = m.groupBy(F.split_part("code", F.lit("."), F.lit(1)).alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("s_code"))
    e = first(spark, sf).select("evidence_id", F.regexp_extract("title", r"[0-9]{7}\.(SH|SZ|BJ)", 0).alias("code"), F.regexp_extract("title", "[0-9]{7}", 0).alias("short"))
    j = e.join(m, "code", "left").join(short, "short", "left")
    code = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("s_code"))
    trust = F.when(F.col("exact").isNotNull(), 1.0).when(F.col("n") == 1, 0.95).when(F.col("n") > 1, 0.5).otherwise(0.0)
    return j.select("evidence_id", code.alias("code"), trust.alias("confidence"))


QUERIES["join_entity_link"], ORACLES["join_entity_link"] = evt_entity_link, ORACLES["evt_entity_link"]


@query("evt_trading_date_map", f"select evidence_id, strftime(effective_trade_date + case dayofweek(effective_trade_date) when 5 then 3 when 6 then 2 else 1 end + interval 1 hour, '%Y-%m-%d %H:%M:%S') available from {E} where effective_trade_date is not null")
def evt_trading_date_map(spark, sf):
    rows = ev(spark, sf).where("effective_trade_date is not null")
    return rows.select("evidence_id", F.date_format(X.next_weekday_morning(F.col("effective_trade_date")), "yyyy-MM-dd HH:mm:ss").alias("available"))


QUERIES["pit_estimated_quality"], ORACLES["pit_estimated_quality"] = evt_trading_date_map, ORACLES["evt_trading_date_map"]


@query("evt_extract_validate", f"select evidence_id, json_extract_string(raw_payload, '$.feed') feed, coalesce(json_extract_string(raw_payload, '$.feed') = source_id, false) ok from {E}")
def evt_extract_validate(spark, sf):
    """A field extracted from the payload must agree with the row; what cannot be read does not."""
    feed = F.get_json_object("raw_payload", "$.feed")
    return ev(spark, sf).select("evidence_id", feed.alias("feed"), F.coalesce(feed == F.col("source_id"), F.lit(False)).alias("ok"))


@query("evt_hypothesis_template", f"select evidence_id, case when regexp_matches(lower(title), 'halt|suspend|停牌') then 'halt' when regexp_matches(lower(title), 'doubled|raised|extended|上调|延长') then 'increase' when regexp_matches(lower(title), 'trimmed|cut|fell|下调') then 'decrease' when regexp_matches(lower(title), 'notice|公告') then 'notice' else 'other' end template from {E} where title is not null")
def evt_hypothesis_template(spark, sf):
    t = F.lower("title")
    kind = F.when(t.rlike("halt|suspend|停牌"), "halt").when(t.rlike("doubled|raised|extended|上调|延长"), "increase").when(t.rlike("trimmed|cut|fell|下调"), "decrease").when(t.rlike("notice|公告"), "notice").otherwise("other")
    return ev(spark, sf).where("title is not null").select("evidence_id", kind.alias("template"))


_RET = f"{SECTOR_ON}, r as (select code, d, sector_code, floor((c / lag(c) over (partition by code order by d) - 1) * 1000000::double)::bigint r from sect), x as (select *, r - sum(r) over (partition by d) / count(r) over (partition by d) am, r - sum(r) over (partition by d, sector_code) / count(r) over (partition by d, sector_code) ai from r where r is not null)"


def _returns(spark, sf):
    members = pit.memberships(table(spark, sf, "stock_sector_membership"))
    sect = pit.pick_member(pit.member_on(members, bars_of(spark, sf).select("code", "d", "c")))
    r = sect.withColumn("r", F.floor((F.col("c") / F.lag("c").over(B.by_code()) - 1) * 1000000.0)).where("r is not null")
    m, i = Window.partitionBy("d"), Window.partitionBy("d", "sector_code")
    return r.withColumn("am", F.col("r") - F.sum("r").over(m) / F.count("r").over(m)).withColumn("ai", F.col("r") - F.sum("r").over(i) / F.count("r").over(i))


@query("evt_stock_return", f"with {_RET} select code, d::varchar trade_date, r, {S.r4('am')} vs_market, {S.r4('ai')} vs_industry from x")
def evt_stock_return(spark, sf):
    return _returns(spark, sf).select("code", day(), "r", r4(F.col("am")).alias("vs_market"), r4(F.col("ai")).alias("vs_industry"))


@query("evt_market_alignment", f"with {_RET} select d::varchar trade_date, count(*) filter (am > 0 and ai > 0) aligned, count(*) filter (am < 0 and ai < 0) contradicted, count(*) filter (not ((am > 0 and ai > 0) or (am < 0 and ai < 0))) ambiguous from x group by d")
def evt_market_alignment(spark, sf):
    n = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    return _returns(spark, sf).groupBy(day()).agg(n("am > 0 and ai > 0", "aligned"), n("am < 0 and ai < 0", "contradicted"), n("not ((am > 0 and ai > 0) or (am < 0 and ai < 0))", "ambiguous"))


@query("evt_brief", f"with {_FIRST} select effective_trade_date::varchar trade_date, count(*) n, count(distinct source_id) n_sources, count(*) filter (version > 1) n_revisions, min(title) first_title from first where effective_trade_date is not null group by 1")
def evt_brief(spark, sf):
    rows = first(spark, sf).where("effective_trade_date is not null")
    return rows.groupBy(day("effective_trade_date")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("n_sources"), F.count(F.when(F.col("version") > 1, 1)).alias("n_revisions"), F.min("title").alias("first_title"))


_CAND = f"select run_id, trade_date, {S.CODE} code, lower(trim(horizon)) horizon, base_score, pattern_score, event_adjustment, final_score, support_tier, risk_flags, created_at from analysis_decision_candidates"


_TIER = "case support_tier when 'A' then 3 when 'B' then 2 when 'watch' then 1 else 0 end"


@query("decision_tier_merge", f"with k as (select trade_date, {S.CODE} code, lower(trim(horizon)) horizon, base_source, {_TIER} t from analysis_decision_candidates), g as (select trade_date, code, horizon, max(t) tier, max(t) filter (base_source = 'scan_ranker') scan, max(t) filter (base_source = 'pattern_shadow') pattern from k group by 1, 2, 3), f as (select *, coalesce(scan > 0 and pattern = 0, false) bad from g) select trade_date::varchar trade_date, code, horizon, case when bad then 1 else tier end tier, case when bad then 'scan_pattern_disagreement' else '' end flag from f")
def decision_tier_merge(spark, sf):
    """The highest tier of a date, code and horizon; a scan that is for it and a pattern that rejects it leave it watched, and flagged."""
    rows = table(spark, sf, "analysis_decision_candidates").select("trade_date", clean_code("code").alias("code"), clean_word("horizon").alias("horizon"), "base_source", F.expr(_TIER).alias("t"))
    of = lambda source: F.max(F.when(F.col("base_source") == source, F.col("t")))
    g = rows.groupBy("trade_date", "code", "horizon").agg(F.max("t").alias("tier"), of("scan_ranker").alias("scan"), of("pattern_shadow").alias("pattern"))
    g = g.withColumn("bad", F.expr("coalesce(scan > 0 and pattern = 0, false)"))
    return g.select(F.col("trade_date").cast("date").cast("string").alias("trade_date"), "code", "horizon", F.when(F.col("bad"), 1).otherwise(F.col("tier")).alias("tier"), F.when(F.col("bad"), "scan_pattern_disagreement").otherwise("").alias("flag"))


@query("json_risk_flags", f"with k as ({_CAND}), f as (select horizon, unnest(from_json(risk_flags, '[\"VARCHAR\"]')) flag from k where json_valid(risk_flags)) select horizon, flag, count(*) n from f group by 1, 2")
def json_risk_flags(spark, sf):
    """Flags out of a JSON array."""
    rows = table(spark, sf, "analysis_decision_candidates").select(clean_word("horizon").alias("horizon"), F.explode(F.from_json("risk_flags", "array<string>")).alias("flag"))
    return rows.groupBy("horizon", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("set_dedup_ordered", f"select evidence_id, array_to_string(list_distinct_ordered, ' ') words from (select evidence_id, list_reduce(list_prepend([]::varchar[], list_transform(string_split(title, ' '), lambda w: [w])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) list_distinct_ordered from {E} where title is not null)")
def set_dedup_ordered(spark, sf):
    """The first occurrence of each word is kept, in order."""
    return ev(spark, sf).where("title is not null").select("evidence_id", F.array_join(F.array_distinct(F.split("title", " ")), " ").alias("words"))


# events replayed as batches; tapeline.streaming runs the same plans over streams


_TICKS = "x as (select user_id code, ts, event_id, value, lag(value) over (partition by user_id, ts::date order by ts, event_id) p from events)"


@query("stream_burst", f"with {_TICKS} select code, event_id, value, p as previous from x where p > 0 and abs(value - p) * 100 >= 3 * p")
def stream_burst(spark, sf):
    """Moves of 3 % and more from the last price in the session."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    x = table(spark, sf, "events").withColumn("p", F.lag("value").over(w))
    return x.where("p > 0 and abs(value - p) * 100 >= 3 * p").select(F.col("user_id").alias("code"), "event_id", "value", F.col("p").alias("previous"))


@query("stream_tumbling_1h", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') window_start, event_type, count(*) n, sum(floor(value * 100 + 0.5)::bigint)::bigint cents from events group by 1, 2")
def stream_tumbling_1h(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "cents")


@query("stream_sliding", "select strftime(date_trunc('hour', ts) - interval 1 hour * k.k, '%Y-%m-%d %H:%M:%S') window_start, count(*) n from events, (select unnest([0, 1]) k) k group by 1")
def stream_sliding(spark, sf):
    """Two-hour windows every hour."""
    g = table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("stream_session", "with x as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end s from events window w as (partition by user_id order by ts)), g as (select user_id, ts, sum(s) over (partition by user_id order by ts) g from x) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') session_start, count(*) n from g group by user_id, g")
def stream_session(spark, sf):
    """Sessions that end after 30 minutes without an event."""
    g = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("stream_daban_live", "with h as (select event_type, date_trunc('hour', ts) h, count(*) n from events group by 1, 2), l as (select *, lag(n) over (partition by event_type order by h) p from h) select event_type, strftime(h, '%Y-%m-%d %H:%M:%S') at_hour, n from l where p is null or p <> n")
def stream_daban_live(spark, sf):
    """A report is emitted only when its signature changes."""
    h = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    line = h.withColumn("p", F.lag("n").over(Window.partitionBy("event_type").orderBy("h")))
    return line.where("p is null or p <> n").select("event_type", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("at_hour"), "n")


@query("stream_version_append", f"select count(*) n from (select distinct {S.CODE}, trade_date, available_at from stock_daily_bar_versions)")
def stream_version_append(spark, sf):
    """The append-only log: one row per key, however often a version is delivered."""
    rows = table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code"), "trade_date", "available_at")
    return rows.dropDuplicates(["code", "trade_date", "available_at"]).agg(F.count(F.lit(1)).alias("n"))


@query("win_version_latest", f"select {S.CODE} code, trade_date::varchar trade_date, epoch_us(available_at) at_us, source from stock_daily_bar_versions qualify row_number() over (partition by {S.CODE}, trade_date order by available_at desc, ingested_at desc, source) = 1")
def win_version_latest(spark, sf):
    rows = table(spark, sf, "stock_daily_bar_versions").withColumn("code", clean_code("code"))
    return pit.newest(rows, ["code", "trade_date"], [F.desc("available_at"), F.desc("ingested_at"), F.asc("source")]).select("code", day("trade_date"), pit.at_us("available_at").alias("at_us"), "source")


QUERIES["win_version_latest_research"], ORACLES["win_version_latest_research"] = win_version_latest, ORACLES["win_version_latest"]


@query("win_revision_count", f"select {S.CODE} code, trade_date::varchar trade_date, count(*) n_revisions, max(epoch_us(available_at)) last_us from stock_daily_bar_versions group by all")
def win_revision_count(spark, sf):
    """Revisions of each key and the latest one; an aggregation instead of a count and a rank over one window."""
    rows = table(spark, sf, "stock_daily_bar_versions")
    return rows.groupBy(clean_code("code").alias("code"), day("trade_date")).agg(F.count(F.lit(1)).alias("n_revisions"), F.max(pit.at_us("available_at")).alias("last_us"))


def _recursive(name, fn):
    """Recursive smoothing has no SQL form worth running here; a fold over one code's ordered closes (bounded by the calendar)."""

    def run(spark, sf):
        closes = F.transform(F.sort_array(F.collect_list(F.struct("d", "c", "h", "l"))), lambda s: s)
        return bars_of(spark, sf).groupBy("code").agg(closes.alias("bars")).select("code", fn().alias("x"))

    QUERIES[name] = run


def _ema(n, bars="bars"):
    a = 2.0 / (n + 1)
    return F.aggregate(F.col(bars), F.lit(None).cast("double"), lambda s, b: F.when(s.isNull(), b["c"] / 1000.0).otherwise(s + a * (b["c"] / 1000.0 - s)))


def _wilder(n=14):
    start = F.struct(F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("u"), F.lit(0.0).alias("d"))

    def step(s, b):
        c = b["c"] / 1000.0
        move = F.coalesce(c - s["p"], F.lit(0.0))
        return F.struct(c.alias("p"), ((s["u"] * (n - 1) + F.greatest(move, F.lit(0.0))) / n).alias("u"), ((s["d"] * (n - 1) + F.greatest(-move, F.lit(0.0))) / n).alias("d"))

    return F.aggregate(F.col("bars"), start, step, lambda s: 100 - 100 / (1 + F.when(s["d"] > 0, s["u"] / F.when(s["d"] > 0, s["d"])).otherwise(100.0)))


_recursive("win_macd", lambda: round_half(_ema(12) - _ema(26), 6))
_recursive("win_rsi_wilder", lambda: round_half(_wilder(), 6))
ORACLES["win_macd"] = f"""with recursive {S.BARS}, b as (select code, c / 1000 x, row_number() over (partition by code order by d) k from bars), e as (select code, k, x f, x s from b where k = 1 union all select b.code, b.k, e.f + 2.0::double / 13 * (b.x - e.f), e.s + 2.0::double / 27 * (b.x - e.s) from e join b on b.code = e.code and b.k = e.k + 1)
select code, {S.r6('arg_max(f - s, k)')} x from e group by code"""
ORACLES["win_rsi_wilder"] = f"""with recursive {S.BARS}, b as (select code, c / 1000 x, row_number() over (partition by code order by d) k from bars), e as (select code, k, x, 0.0::double u, 0.0::double d from b where k = 1 union all select b.code, b.k, b.x, (e.u * 13 + greatest(b.x - e.x, 0)) / 14, (e.d * 13 + greatest(e.x - b.x, 0)) / 14 from e join b on b.code = e.code and b.k = e.k + 1)
select code, {S.r6('arg_max(100 - 100 / (1 + case when d > 0 then u / d else 100 end), k)')} x from e group by code"""
