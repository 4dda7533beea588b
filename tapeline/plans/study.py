"""Queries of research steps: labels, baselines, matched controls, walk-forward splits, validation, vector models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.functions.splits import month_splits
from tapeline.operators import bars as B
from tapeline.operators import pit, study, vectors
from tapeline.plans import sql as S
from tapeline.plans.market import SECTOR_ON, day, r4
from tapeline.plans.signals import bars_of
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}
_CODE_DAY = "code, d::varchar trade_date"
_BY = "partition by code order by d"


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# whole vectors

_X = "x as (select vec_id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings)"


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings")


@query("pat_sim_euclid", f"with {_X}, m as (select label, i, avg(v) m from x group by all) select vec_id, {S.r4('(1 / (1 + sqrt(sum((v - m) * (v - m)))))')} sim from x join m using (label, i) group by vec_id")
def pat_sim_euclid(spark, sf):
    """Similarity of each vector to the centroid of its label, over all dimensions."""
    import numpy as np

    rows = _embeddings(spark, sf)
    parts = vectors.moments(rows, "embedding", "label")
    measured = vectors.squared_distances(rows, "embedding", {k: m.mean for k, m in parts.items()}, {k: np.eye(len(m.mean)) for k, m in parts.items()}, "label")
    return measured.select("vec_id", r4(1 / (1 + F.sqrt("_d2"))).alias("sim"))


@query("pat_sim_mahalanobis", None)
def pat_sim_mahalanobis(spark, sf):
    return vectors.mahalanobis_similarity(_embeddings(spark, sf), "embedding").select("vec_id", r4(F.col("sim")).alias("sim"))


@query("pat_sim_gmm", None)
def pat_sim_gmm(spark, sf):
    return vectors.mixture_similarity(_embeddings(spark, sf), "embedding", "label").select("vec_id", "label", "sim")


def _ledger(spark, sf, model):
    fields = "model string, k int, cluster int, status string, n bigint, stability double, silhouette double, bic double, top array<int>"
    names = [f.split()[0] for f in fields.split(", ")]
    rows = vectors.archetypes(_embeddings(spark, sf), "vec_id", "embedding", vectors.Archetypes(models=(model,)))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)


@query("res_kmeans", None)
def res_kmeans(spark, sf):
    """Accepted and rejected k-means models over whole vectors."""
    return _ledger(spark, sf, "kmeans")


@query("res_gmm", None)
def res_gmm(spark, sf):
    """Accepted and rejected mixtures with full covariances over whole vectors."""
    return _ledger(spark, sf, "gmm")


@query(
    "res_high_contribution",
    f"""with {_X}, g as (select i, avg(v) g, stddev_pop(v) s from x group by i), m as (select label, i, avg(v) m from x group by all), z as (select label, i, (m - g) / s z from m join g using (i))
select label, i::int dim, {S.r4('z')} scaled from z qualify row_number() over (partition by label order by abs(z) desc, i) <= 5""",
)
def res_high_contribution(spark, sf):
    """The five dimensions in which a label's scaled centre lies farthest out."""
    rows = _embeddings(spark, sf)
    whole, parts = vectors.moments(rows, "embedding")[None], vectors.moments(rows, "embedding", "label")
    found = []
    for label, m in parts.items():
        z = (m.mean - whole.mean) / whole.scale
        found += [(int(label), int(i) + 1, float(z[i])) for i in sorted(range(len(z)), key=lambda i: (-abs(z[i]), i))[:5]]
    return spark.createDataFrame(found, "label bigint, dim int, scaled double").select("label", "dim", r4(F.col("scaled")).alias("scaled"))


# returns as whole millionths, so that their sums and squares are exact in any order

_GAIN = f"g0 as (select *, lag(c) over ({_BY}) pc0 from bars), g as (select *, floor((c / pc0 - 1) * 1000000::double + 0.5::double)::bigint g from g0)"


def _spread(n: int) -> str:
    """n^2 times the population variance of the last n returns; null if there are fewer."""
    w = f"over ({_BY} rows between {n - 1} preceding and current row)"
    return f"case when count(g) {w} = {n} then ({n} * sum(g::hugeint * g) {w} - sum(g) {w} * sum(g) {w})::double / {n * n} end"


# baselines


@query("res_baseline_ma", f"with {S.FEATURES} select {_CODE_DAY}, {S.r4('(c / ma20 - 1 + (ma20 / ma60 - 1) + (ma20 / ma20p - 1))')} score from f where c > ma20 and ma20 > ma60 and ma20 > ma20p")
def res_baseline_ma(spark, sf):
    x = B.features(bars_of(spark, sf)).where("c > ma20 and ma20 > ma60 and ma20 > ma20p")
    c, m, n, p = (F.col(k) for k in ("c", "ma20", "ma60", "ma20p"))
    return x.select("code", day(), r4(c / m - 1 + (m / n - 1) + (m / p - 1)).alias("score"))


_PAST = f"past as (select code, d, floor((c / lag(c, 20) over ({_BY}) - 1) * 1000000::double + 0.5::double)::bigint r20, floor((c / lag(c, 60) over ({_BY}) - 1) * 1000000::double + 0.5::double)::bigint r60 from bars)"


@query(
    "res_baseline_rs",
    f"""with {S.BARS}, {_PAST}, x as (select *, r20 + r60 own from past where r20 is not null and r60 is not null), y as (select *, own - (sum(own) over (partition by d)) / count(*) over (partition by d) excess,
row_number() over (partition by d order by own desc, code) k, count(*) over (partition by d) n from x) select {_CODE_DAY}, {S.r4('(excess / 1000000)')} score from y where k <= greatest(1, ceil(n * 0.1))""",
)
def res_baseline_rs(spark, sf):
    """The tenth of a date's codes with the greatest excess of 20 and 60 days over the market, which is the mean of the codes."""
    past = lambda n: F.floor((F.col("c") / F.lag("c", n).over(B.by_code()) - 1) * 1e6 + 0.5)
    x = bars_of(spark, sf).select("code", "d", (past(20) + past(60)).alias("own")).where("own is not null")
    by_date = Window.partitionBy("d")
    y = x.withColumn("n", F.count(F.lit(1)).over(by_date)).withColumn("excess", F.col("own") - F.sum("own").over(by_date) / F.col("n")).withColumn("k", F.row_number().over(by_date.orderBy(F.desc("own"), "code")))
    return y.where("k <= greatest(1, ceil(n * 0.1))").select("code", day(), r4(F.col("excess") / 1000000).alias("score"))


@query("res_baseline_vcb", f"with {S.BARS}, {_GAIN}, v as (select *, {_spread(5)} v5, {_spread(20)} v20, {_spread(60)} v60, {S._prev('max(h)', 20)} hi from g) select {_CODE_DAY} from v where v5 < v20 and v20 < v60 and c > hi")
def res_baseline_vcb(spark, sf):
    """Volatility that narrows over 60, 20 and 5 days, and a close above the highest price of the 20 days before."""
    x = study.with_gain(bars_of(spark, sf))
    x = x.select("code", "d", "c", *(study.variance(n).alias(f"v{n}") for n in (5, 20, 60)), F.max("h").over(B.prev_n(20)).alias("hi"))
    return x.where("v5 < v20 and v20 < v60 and c > hi").select("code", day())


@query("res_baseline_ranker", f"""with c as (select {S.CODE} code, trade_date d, max(final_score) score from analysis_decision_candidates where base_source = 'scan_ranker' and final_score is not null and not isnan(final_score) and lower(trim(horizon)) in ('short', 'mid', 'long') group by 1, 2)
select {_CODE_DAY}, {S.r4('score')} score from c""")
def res_baseline_ranker(spark, sf):
    """What the scan's own ranking proposes for the three pools, with its best score."""
    rows = table(spark, sf, "analysis_decision_candidates").where("base_source = 'scan_ranker' and final_score is not null and not isnan(final_score)")
    return study.ranked_pools(rows).select("code", day(), r4(F.col("score")).alias("score"))


# labels

H = study.HORIZONS["month"]
_P = "case when count(*) over (partition by d) = 1 then 100.0::double else 100.0::double * (row_number() over (partition by d order by {0}, code) - 1) / greatest(count(*) over (partition by d) - 1, 1) end"
LABELS = f"""{SECTOR_ON}, {_GAIN}, mk as (select d, (sum(g) / count(g))::double m from g where g is not null group by d),
a as (select s.code, s.d, s.c, s.a amt, s.sector_code, lead(s.c, {H}) over w cf, min(s.l) over nx lf, max(s.h) over nx hf, sum(ln(1 + mk.m / 1000000)) over nx lm from sect s left join mk using (d)
window w as (partition by s.code order by s.d), nx as (partition by s.code order by s.d rows between 1 following and {H} following)),
b as (select *, floor((cf / c - 1) * 1000000::double)::bigint r, floor((cf / c - exp(lm)) * 10000::double)::bigint mex, least(floor((lf / c - 1) * 1000000::double)::bigint, 0) dd, greatest(floor((hf / c - 1) * 1000000::double)::bigint, 0) fe from a where cf is not null),
c as (select *, r - sum(r) over (partition by d, sector_code) / count(*) over (partition by d, sector_code) iex from b),
lab as (select *, ({" + ".join(_P.format(x) for x in ("r", "mex", "iex", "dd", "fe"))}) / 5 strength from c), labelled as (select *, amt > 0 and r > 0 and mex > 0 and iex > 0 and strength >= 90 pos from lab)"""


def labelled(spark, sf):
    members = pit.memberships(table(spark, sf, "stock_sector_membership"))
    bars = bars_of(spark, sf)
    return study.labels(pit.pick_member(pit.member_on(members, bars)), study.market_gain(bars), H)


@query("res_labels", f"with {LABELS} select {_CODE_DAY}, r, mex, {S.r4('iex')} iex, dd, fe, floor(strength * 100)::bigint strength, pos from labelled")
def res_labels(spark, sf):
    return labelled(spark, sf).select("code", day(), "r", "mex", r4(F.col("iex")).alias("iex"), "dd", "fe", F.floor(F.col("strength") * 100).alias("strength"), "pos")


# controls


@query("res_control_metrics", f"with {S.BARS}, {_GAIN} select {_CODE_DAY}, {S.r4('(' + S._last('sum(a)', 20) + ' / ' + S._last('count(a)', 20) + ')')} avg_amount, {S.r4('(coalesce(sqrt(greatest((' + S._last('count(g)', 20) + ' * ' + S._last('sum(g::hugeint * g)', 20) + ' - ' + S._last('sum(g)', 20) + ' * ' + S._last('sum(g)', 20) + ')::double / nullif(' + S._last('count(g)', 20) + ' * ' + S._last('count(g)', 20) + ', 0), 0)), 0))')} volatility from g")
def res_control_metrics(spark, sf):
    """Mean amount and deviation of daily returns (in millionths) over the last 20 bars, as many as there are."""
    x = study.with_gain(bars_of(spark, sf))
    return x.select("code", day(), r4(F.sum("a").over(B.last_n(20)) / F.count("a").over(B.last_n(20))).alias("avg_amount"), r4(study.deviation(20)).alias("volatility"))


_BUCKET = "least(4, floor((dense_rank() over (partition by d order by {0}) - 1) * 5 / nullif(nd_{0}, 0)))::bigint"
_METRICS = ("cap", "c", "am", "vo")
_REL = " + ".join(f"abs(p.{m} - n.{m}) / greatest(abs(p.{m}), abs(n.{m}), 0.000000001::double)" for m in _METRICS)
CONTROLS = f"""{LABELS}, met as (select code, d, c cc, case when t > 0 then a * 1000000::double / t else 0 end cap, {S._last('sum(a)', 20)} / {S._last('count(a)', 20)} am,
coalesce(sqrt(greatest(({S._last('count(g)', 20)} * {S._last('sum(g::hugeint * g)', 20)} - {S._last('sum(g)', 20)} * {S._last('sum(g)', 20)})::double / nullif({S._last('count(g)', 20)} * {S._last('count(g)', 20)}, 0), 0)), 0) vo from g),
j as (select l.*, m.cap, m.am, m.vo from labelled l join met m using (code, d)), nd as (select d, {', '.join(f'count(distinct {m}) nd_{m}' for m in _METRICS)} from j group by d),
bk as (select j.*, {', '.join(f'{_BUCKET.format(m)} b_{m}' for m in _METRICS)}, case when r <= 0 and fe > 0 then 'failed_breakout' when mex < 0 then 'negative_excess' else 'ordinary' end kind from j join nd using (d)),
pr as (select p.code, p.d, n.code control, n.kind, {_REL} dist from bk p join bk n on n.d = p.d and n.sector_code = p.sector_code and (n.amt > 0) = (p.amt > 0) and {' and '.join(f'n.b_{m} = p.b_{m}' for m in _METRICS)} where p.pos and not n.pos and n.code <> p.code)"""


@query("res_controls", f"with {CONTROLS} select {_CODE_DAY}, kind, arg_min(control, (floor(dist * 1000000::double), control)) control, floor(min(dist) * 1000000::double)::bigint dist from pr group by code, d, kind")
def res_controls(spark, sf):
    """For each positive the nearest control of each kind, of the same date, sector and four buckets."""
    return study.controls(labelled(spark, sf), bars_of(spark, sf)).select("code", day(), "kind", "control", "dist")


QUERIES["join_control_match"], ORACLES["join_control_match"] = res_controls, ORACLES["res_controls"]


# splits and validation


@query("res_walk_forward", None)
def res_walk_forward(spark, sf):
    """Purged and embargoed splits by calendar months over the distinct dates; the split map is as small as the calendar."""
    dates = [r[0] for r in bars_of(spark, sf).select("d").distinct().orderBy("d").collect()]
    rows = [(i, str(d), part) for i, split in enumerate(month_splits(dates, 3, 1, 1, 5)) for part, days in split.items() for d in days]
    return spark.createDataFrame(rows, "split int, trade_date string, part string")


@query("res_validate", None)
def res_validate(spark, sf):
    """Metrics and release gate of the moving-average baseline, against the return of the others; splits are the windows."""
    lab = labelled(spark, sf)
    dates = [r[0] for r in lab.select("d").distinct().collect()]
    windows = {d: i for i, s in enumerate(month_splits(dates, 2, 1, 1, 5)) for d in s["validation"]}
    feats = B.features(bars_of(spark, sf)).select("code", "d", F.coalesce(F.expr("c > ma20 and ma20 > ma60 and ma20 > ma20p"), F.lit(False)).alias("signal"), F.coalesce(F.expr("c / ma20 - 1 + ma20 / ma60 - 1 + ma20 / ma20p - 1"), F.lit(0.0)).alias("score"))
    calendar = spark.createDataFrame(list(windows.items()) or [], "d date, split int")
    rows = lab.join(feats, ["code", "d"]).join(F.broadcast(calendar), "d", "left").withColumn("split", F.coalesce("split", F.lit(-1)))
    return study.validation(rows)


@query("res_export", None)
def res_export(spark, sf):
    """Archetypes, accepted and rejected, as a document for each horizon that may be published."""
    rows = vectors.archetypes(_embeddings(spark, sf), "vec_id", "embedding", vectors.Archetypes(models=("kmeans",)))
    return spark.createDataFrame([(x,) for x in study.payloads(rows, ["week", "month", "quarter"])], "payload string")
