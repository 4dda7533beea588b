"""Queries of event clustering and of the duplicate decision: terms, pair scores, clusters, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import text as X
from tapeline.operators import clusters as C
from tapeline.plans import sql as S
from tapeline.plans.evidence import _FIRST, E, ev, first, near_duplicates
from tapeline.plans.market import r4
from tapeline.scratch import Scratch
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


TERMS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^A-Za-z0-9.]+'), lambda w: length(w) > 2)"
TOKENS = f"list_sort(list_distinct(list_filter({TERMS}, lambda w: not regexp_matches(w, '^[0-9]{{{{6,7}}}}\\.(sh|sz|bj)$'))))"
_COUNTS = f"list_transform(range(8), lambda k: len(list_filter(list_transform({TERMS}, lambda w: list_sum(list_transform(string_split(w, ''), lambda ch: ascii(ch))) % 8), lambda x: x = k)))"


@query("evt_tokens", f"select evidence_id, array_to_string({TOKENS.format('title')}, ' ') tokens from {E}")
def evt_tokens(spark, sf):
    return ev(spark, sf).select("evidence_id", F.array_join(X.tokens("title"), " ").alias("tokens"))


@query("evt_semantic_vector", f"with t as (select evidence_id, {_COUNTS.format('title')} n from {E}), u as (select evidence_id, n, sqrt(list_sum(list_transform(n, lambda x: x * x))::double) z from t) select evidence_id, array_to_string(list_transform(n, lambda x: case when z > 0 then floor(x / z * 10000 + 0.5)::bigint else 0 end), ',') vec from u")
def evt_semantic_vector(spark, sf):
    """All terms of the title in eight buckets, scaled to length 1, in ten-thousandths."""
    vector = F.transform(X.unit_vector(X.term_counts(X.terms("title"))), lambda x: F.floor(x * 10000 + 0.5).cast("string"))
    return ev(spark, sf).select("evidence_id", F.array_join(vector, ",").alias("vec"))


_MENTIONS = f"""{_FIRST}, tx as (select evidence_id id, published_at p, first_seen_at fs, coalesce(title, '') || ' ' || coalesce(content, '') t from first where evidence_id is not null),
m as materialized (select id, p, fs, list_sort(list_distinct(regexp_extract_all(upper(t), '[0-9]{{7}}\\.(?:SH|SZ|BJ)'))) ent, {TOKENS.format('t')} act, list_distinct(regexp_extract_all(t, '\\b(?:in|near|at|from) ([A-Z][a-z]+)', 1)) plc, {_COUNTS.format('t')}::double[] v from tx),
en as (select id, p, unnest(ent) entity from m), cp as (select distinct x.id a, y.id b from en x join en y on x.entity = y.entity and x.id < y.id and (x.p is null or y.p is null or abs(epoch_us(x.p) - epoch_us(y.p)) <= 172800000000))"""
_JAC = "case when len(list_distinct({0} || {1})) = 0 then 1.0::double else len(list_intersect({0}, {1})) / len(list_distinct({0} || {1})) end"
_PARTS = f"""{_MENTIONS}, pt as (select a, b, case when x.p is null or y.p is null then 0.5::double else 1 - abs(epoch_us(x.p) - epoch_us(y.p)) / 172800000000.0::double end near, {_JAC.format('x.ent', 'y.ent')} entity, {_JAC.format('x.act', 'y.act')} action,
case when (len(x.plc) = 0) <> (len(y.plc) = 0) then 0.5::double else {_JAC.format('x.plc', 'y.plc')} end place,
coalesce(greatest(0, least(1, list_dot_product(x.v, y.v) / nullif(sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)), 0))), 0) meaning, len(list_intersect(x.act, y.act)) > 0 hard from cp join m x on x.id = a join m y on y.id = b),
sc as (select a, b, floor(greatest(0, least(1, near * 0.2::double + entity * 0.25::double + action * 0.2::double + place * 0.1::double + meaning * 0.25::double)) * 1000000::double + 0.5::double)::bigint score from pt where hard)"""


def _parts(spark, sf):
    held = C.mentions(first(spark, sf))
    return C.parts(held, C.candidate_pairs(held))


@query("evt_jaccard", f"with {_PARTS} select a, b, {S.r4('entity')} entity, {S.r4('action')} action from pt")
def evt_jaccard(spark, sf):
    """Shares of common entities and actions of records with a common entity, 48 hours apart at most."""
    return _parts(spark, sf).select("a", "b", r4(F.col("entity")).alias("entity"), r4(F.col("action")).alias("action"))


@query("evt_time_proximity", f"with {_PARTS} select a, b, {S.r4('near')} proximity from pt")
def evt_time_proximity(spark, sf):
    return _parts(spark, sf).select("a", "b", r4(F.col("near")).alias("proximity"))


@query("evt_location_overlap", f"with {_PARTS} select a, b, {S.r4('place')} overlap from pt")
def evt_location_overlap(spark, sf):
    """Shares of common places: 1 if both name none, a half if one does."""
    return _parts(spark, sf).select("a", "b", r4(F.col("place")).alias("overlap"))


@query("evt_pair_score", f"with {_PARTS} select a, b, score from sc where score >= {C.REVIEW}")
def evt_pair_score(spark, sf):
    """All pairs that share an entity and an action within 48 hours and reach the lower threshold, in millionths."""
    return C.scored_pairs(C.mentions(first(spark, sf)))


QUERIES["join_theta_pairs"], ORACLES["join_theta_pairs"] = evt_pair_score, ORACLES["evt_pair_score"]


def _clusters(spark, sf, scratch):
    records = first(spark, sf)
    held = scratch.cut(C.mentions(records))
    pairs = scratch.cut(C.scored_pairs(held))
    order = records.select(F.col("evidence_id").alias("id"), F.struct(F.unix_micros("first_seen_at").alias("us"), "evidence_id").alias("seq"))
    return pairs, C.incremental(held, pairs, order, scratch)


@query("evt_cluster_incremental", f"""with recursive {_PARTS}, ss as (select a, b, score from sc where score >= {C.REVIEW}), dr as (select case when (x.fs, x.id) > (y.fs, y.id) then a else b end id, case when (x.fs, x.id) > (y.fs, y.id) then b else a end other, score from ss join m x on x.id = a join m y on y.id = b),
best as (select dr.id, arg_min(other, (-score, m.fs, m.id)) parent, max(score) score from dr join m on m.id = other group by 1), walk(id, node) as (select id, id from m union all select walk.id, best.parent from walk join best on best.id = walk.node)
select walk.id, walk.node as cluster, case when best.score >= {C.JOIN} then 'auto_join' when best.score is not null then 'review' else 'new' end decision, best.score from walk left join best on best.id = walk.id where walk.node not in (select id from best)""")
def evt_cluster_incremental(spark, sf):
    return _clusters(spark, sf, Scratch(spark, "clusters"))[1]


@query("evt_cluster_refine", None)
def evt_cluster_refine(spark, sf):
    """Clusters of all records, refined with the matches that users locked; there are no locked splits in the tables."""
    scratch = Scratch(spark, "clusters")
    pairs, found = _clusters(spark, sf, scratch)
    groups = table(spark, sf, "market_event_duplicate_groups").where("locked_by_user and duplicate_group_id is not null").select("duplicate_group_id")
    members = table(spark, sf, "market_event_duplicate_members").join(groups, "duplicate_group_id", "left_semi").where("evidence_id is not null")
    low = members.groupBy("duplicate_group_id").agg(F.min("evidence_id").alias("a"))
    merges = members.join(low, "duplicate_group_id").select("a", F.col("evidence_id").alias("b")).where("a <> b").distinct()
    none = spark.createDataFrame([], "a string, b string")
    return C.refined(found, pairs, merges, none, scratch)


# candidates for the duplicate decision

_URL = "case when lower(split_part(u, '://', 1)) in ('http', 'https') and auth <> '' then lower(split_part(u, '://', 1)) || '://' || case when auth like '%' || dp then auth[:length(auth) - length(dp)] else auth end || case when tail = '' then '/' when tail[1] = '?' then '/' || tail else tail end end"
_CANON = f"""ur as (select evidence_id, split_part(trim(source_url), '#', 1) u from first), up as (select evidence_id, u, lower(split_part(split_part(split_part(u, '://', 2), '/', 1), '?', 1)) auth, case when lower(split_part(u, '://', 1)) = 'http' then ':80' else ':443' end dp from ur),
ut as (select *, u[length(split_part(u, '://', 1)) + 4 + length(auth):] tail from up), canon as (select evidence_id, {_URL} url from ut)"""


@query("evt_canonical_url", f"with {_FIRST}, {_CANON} select evidence_id, url from canon where evidence_id is not null")
def evt_canonical_url(spark, sf):
    return first(spark, sf).select("evidence_id", X.canonical_url("source_url").alias("url"))


_KEYS = "select evidence_id, 'hash' kind, lower(content_hash) k from first union all select evidence_id, 'url', url from canon union all select evidence_id, 'item', source_id || '|' || source_item_id || '|' || version::varchar from first"


def exact_keys(rows):
    """(evidence_id, kind, k): content hash, canonical URL, and source item with version of each record."""
    item = F.when(F.col("source_id").isNotNull() & F.col("source_item_id").isNotNull() & F.col("version").isNotNull(), F.concat_ws("|", "source_id", "source_item_id", F.col("version").cast("string")))
    keys = (("hash", F.lower("content_hash")), ("url", X.canonical_url("source_url")), ("item", item))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), k.alias("k")) for n, k in keys))).alias("x")
    return rows.select("evidence_id", each).select("evidence_id", "x.kind", "x.k").where("k is not null and evidence_id is not null")


@query("evt_dedup_exact", f"with {_FIRST}, {_CANON}, k as ({_KEYS}), m as (select kind, k, min(evidence_id) rep from k where k is not null group by 1, 2) select k.evidence_id, k.kind, m.rep from k join m using (kind, k) where m.rep <> k.evidence_id")
def evt_dedup_exact(spark, sf):
    """Records that share a hash, URL or source item, each with its key's smallest record, never with every other one."""
    keyed = exact_keys(first(spark, sf))
    reps = keyed.groupBy("kind", "k").agg(F.min("evidence_id").alias("rep"))
    return keyed.join(reps, ["kind", "k"]).where("rep <> evidence_id").select("evidence_id", "kind", "rep")


_REPS = "rp as (select duplicate_group_id g, min(case when is_representative then evidence_id end) rep from market_event_duplicate_members where duplicate_group_id is not null group by 1), gm as (select evidence_id, min(rep) rep from market_event_duplicate_members join rp on rp.g = duplicate_group_id where evidence_id is not null group by 1)"


@query("join_dup_candidates", f"with {_FIRST}, {_CANON}, k as ({_KEYS} union all select evidence_id, 'date', effective_trade_date::varchar from first), {_REPS}, c as (select kind, k, count(*) n from k where k is not null and evidence_id is not null group by 1, 2) select k.evidence_id, kind, k, n - 1 others, coalesce(gm.rep, k.evidence_id) representative from k join c using (kind, k) left join gm using (evidence_id) where n > 1")
def join_dup_candidates(spark, sf):
    """Membership of every record in the classes of all four keys, with how many others it meets there and its representative.

    A class is given by its key; its members are not multiplied, so a busy date gives as many rows as it has records.
    """
    rows = first(spark, sf)
    dates = rows.where("evidence_id is not null and effective_trade_date is not null").select("evidence_id", F.lit("date").alias("kind"), F.col("effective_trade_date").cast("string").alias("k"))
    keyed = exact_keys(rows).unionByName(dates)
    counts = keyed.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = table(spark, sf, "market_event_duplicate_members").where("duplicate_group_id is not null")
    reps = members.groupBy("duplicate_group_id").agg(F.min(F.when(F.col("is_representative"), F.col("evidence_id"))).alias("rep"))
    own = members.where("evidence_id is not null").join(reps, "duplicate_group_id").groupBy("evidence_id").agg(F.min("rep").alias("rep"))
    met = keyed.join(counts, ["kind", "k"]).join(own, "evidence_id", "left")
    return met.select("evidence_id", "kind", "k", (F.col("n") - 1).alias("others"), F.coalesce("rep", "evidence_id").alias("representative"))


@query("evt_dedup_near", None)
def evt_dedup_near(spark, sf):
    """The decision of every record: exact if it shares a hash, URL or source item, near if a score reaches the threshold."""
    rows = first(spark, sf)
    keyed = exact_keys(rows)
    shared = keyed.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    exact = keyed.join(shared, ["kind", "k"]).select("evidence_id").distinct().withColumn("exact", F.lit(True))
    found = near_duplicates(rows).join(exact, "evidence_id", "left")
    return found.withColumn("decision", F.when(F.col("exact"), "exact_duplicate").otherwise(F.col("decision"))).drop("exact")
