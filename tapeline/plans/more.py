"""Queries of scalar functions, dashboards, refresh ledgers, samples and further research steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, pct_change, round2, triangular
from tapeline.functions import detectors
from tapeline.operators import bars as B
from tapeline.operators import chips as C
from tapeline.operators import pit
from tapeline.plans import sql as S
from tapeline.plans.evidence import _CODE_IN, _FIRST, first
from tapeline.plans.market import CUT, MASTER, MEMBERS, day, master_of, r4
from tapeline.plans.signals import _HITS, _hits, bars_of
from tapeline.scratch import new_path
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}
W = "over (partition by code order by d)"


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# scalar functions


@query("fn_math", f"with {S.BARS} select code, d::varchar trade_date, {S.r4('sqrt(c::double)')} root, {S.r4('ln(v::double)')} log_v, {S.r4('log2(v::double)')} log2_v, {S.r4('exp(-(h - l) / c)')} decay, power(h - l, 2)::bigint square, greatest(least(c, 50000), 10000) clamped from bars")
def fn_math(spark, sf):
    return bars_of(spark, sf).select("code", day(), r4(F.sqrt("c")).alias("root"), r4(F.log("v")).alias("log_v"), r4(F.log2("v")).alias("log2_v"), r4(F.exp(-(F.col("h") - F.col("l")) / F.col("c"))).alias("decay"), F.pow(F.col("h") - F.col("l"), 2).cast("bigint").alias("square"), F.greatest(F.least("c", F.lit(50000)), F.lit(10000)).alias("clamped"))


@query("pct_change", f"with {S.BARS}, x as (select *, lag(c) {W} pc from bars) select code, d::varchar trade_date, (sign(p) * floor(abs(p) * 100::double + 0.5::double) / 100::double) change from (select code, d, case when abs(pc) < 1e-9::double then 0.0::double else (c - pc) / pc * 100 end p from x where pc is not null)")
def fn_pct_change(spark, sf):
    x = bars_of(spark, sf).withColumn("pc", F.lag("c").over(B.by_code())).where("pc is not null")
    return x.select("code", day(), round2(pct_change(F.col("c").cast("double"), F.col("pc").cast("double"))).alias("change"))


@query("triangular_score", f"with {S.FEATURES}, g as (select code, d, gain from f where gain is not null) select code, d::varchar trade_date, {S.r4('(case when gain >= 0.5 and gain <= 4.5 then greatest(0, 1 - abs(gain - 2.2) / 2.3::double) else 0 end)')} score from g")
def fn_triangular(spark, sf):
    return B.features(bars_of(spark, sf)).where("gain is not null").select("code", day(), r4(triangular(F.col("gain"), 2.2, 0.5, 4.5)).alias("score"))


@query("fn_string", "select distinct evidence_id, upper(split_part(source_url, '/', 3)) host, replace(source_id, '_', '-') source, starts_with(source_url, 'https') secure, length(trim(title)) n, substr(title, 1, 5) head from market_event_evidence")
def fn_string(spark, sf):
    t = F.col("title")
    return table(spark, sf, "market_event_evidence").select("evidence_id", F.upper(F.split_part("source_url", F.lit("/"), F.lit(3))).alias("host"), F.replace("source_id", F.lit("_"), F.lit("-")).alias("source"), F.startswith("source_url", F.lit("https")).alias("secure"), F.length(F.trim(t)).cast("bigint").alias("n"), F.substring("title", 1, 5).alias("head")).distinct()


@query("fn_date", f"with {S.BARS} select distinct d::varchar trade_date, date_trunc('week', d)::date::varchar week_start, date_trunc('month', d)::date::varchar month_start, weekofyear(d) iso_week, dayofweek(d) weekday, (d + interval 1 month)::date::varchar month_on, date_diff('day', date '2024-01-01', d) n_days from bars")
def fn_date(spark, sf):
    s = lambda c, n: c.cast("date").cast("string").alias(n)
    big = lambda c, n: c.cast("bigint").alias(n)
    return bars_of(spark, sf).select(day(), s(F.date_trunc("week", "d"), "week_start"), s(F.date_trunc("month", "d"), "month_start"), big(F.weekofyear("d"), "iso_week"), big(F.dayofweek("d") - 1, "weekday"), s(F.add_months("d", 1), "month_on"), big(F.datediff("d", F.lit("2024-01-01").cast("date")), "n_days")).distinct()


@query("fn_json", "select event_id, json_extract(props, '$.k')::bigint k, json_valid(props) ok from events")
def fn_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@query("fn_array", f"with {S.BARS}, g as (select code, list(c order by d) cs from bars group by code) select code, cs[1] first_close, cs[-1] last_close, list_max(cs[1:5]) top5, len(list_distinct(cs)) n_distinct, list_contains(cs, 10000) has_ten from g")
def fn_array(spark, sf):
    cs = F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda s: s["c"])
    g = bars_of(spark, sf).groupBy("code").agg(cs.alias("cs"))
    return g.select("code", F.element_at("cs", 1).alias("first_close"), F.element_at("cs", -1).alias("last_close"), F.array_max(F.slice("cs", 1, 5)).alias("top5"), F.size(F.array_distinct("cs")).cast("bigint").alias("n_distinct"), F.array_contains("cs", 10000).alias("has_ten"))


@query("fn_map", f"with {S.BARS} select code, max(c) filter (month(d) = 3) march, max(c) filter (month(d) = 5) may from bars group by code")
def fn_map(spark, sf):
    top = bars_of(spark, sf).groupBy("code", F.month("d").alias("m")).agg(F.max("c").alias("c"))
    g = top.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("m", "c"))).alias("by_month"))
    return g.select("code", F.try_element_at("by_month", F.lit(3)).alias("march"), F.try_element_at("by_month", F.lit(5)).alias("may"))


@query("fn_hash", "select distinct evidence_id, sha256(evidence_id || chr(0) || coalesce(title, '')) digest, md5(evidence_id) short from market_event_evidence")
def fn_hash(spark, sf):
    return table(spark, sf, "market_event_evidence").select("evidence_id", F.sha2(F.concat("evidence_id", F.lit("\x00"), F.coalesce("title", F.lit(""))), 256).alias("digest"), F.md5("evidence_id").alias("short")).distinct()


@query("fn_null", f"with {S.LATEST} select code, d::varchar trade_date, coalesce(pe, pb, 0) value, nullif(v, 0) v, pe is not distinct from pb same from latest")
def fn_null(spark, sf):
    b = B.latest_bars(table(spark, sf, "stock_daily_bar_versions"))
    return b.select("code", day(), F.coalesce("pe", "pb", F.lit(0)).alias("value"), F.nullif(F.col("v"), F.lit(0)).alias("v"), F.col("pe").eqNullSafe(F.col("pb")).alias("same"))


@query("fn_stats", f"with {S.BARS} select code, median(c) med, {S.r4('quantile_cont(v::double, 0.75)')} p75, {S.r4('(sqrt((count(*) * sum(c * c) - sum(c) * sum(c))::double) / count(*))')} dev from bars group by code")
def fn_stats(spark, sf):
    n, s, q = F.count(F.lit(1)), F.sum("c"), F.sum(F.col("c") * F.col("c"))
    return bars_of(spark, sf).groupBy("code").agg(F.median("c").alias("med"), r4(F.percentile("v", 0.75)).alias("p75"), r4(F.sqrt((n * q - s * s).cast("double")) / n).alias("dev"))


# windows and classifications

_RANK = f"""{S.FEATURES}, m as (select code, d, gain, cp, v / greatest(av10, 1) vr10, v / greatest(av20, 1) vr20, (c / coalesce(ma20, c) - 1) * 100 ext, (c / hi10 - 1) * 100 bk10, (c / hi20 - 1) * 100 bk20, (hi20 - lo20) * 100 / lo20 range20, (hi10 - lo10) * 100 / lo10 range10, (c / lo60 - 1) * 100 dist60 from f where rn >= 25)"""


@query("rank_metrics", f"with {_RANK} select code, d::varchar trade_date, {', '.join(f'{S.r4(x)} {x}' for x in ('gain', 'cp', 'vr10', 'vr20', 'ext', 'bk10', 'bk20', 'range20', 'range10', 'dist60'))} from m")
def rank_metrics(spark, sf):
    """The measures a ranking needs, for every bar; how they are weighed is left to the user."""
    x = {
        "gain": "gain", "cp": "cp", "vr10": "v / greatest(av10, 1)", "vr20": "v / greatest(av20, 1)", "ext": "(c / coalesce(ma20, c) - 1) * 100", "bk10": "(c / hi10 - 1) * 100", "bk20": "(c / hi20 - 1) * 100",
        "range20": "(hi20 - lo20) * 100 / lo20", "range10": "(hi10 - lo10) * 100 / lo10", "dist60": "(c / lo60 - 1) * 100",
    }
    f = B.features(bars_of(spark, sf)).where("rn >= 25")
    return f.select("code", day(), *(r4(F.expr(e)).alias(n) for n, e in x.items()))


_TREND = "case when ma5 > ma10 and ma10 > ma20 and ma20 > ma60 then case when (ma5 - ma60) * 100 > 5 * ma60 then 'strong_bull' else 'bull' end when ma5 > ma10 then 'weak_bull' when abs(ma5 - ma10) * 100 < ma10 then 'consolidation' when ma5 < ma10 and ma10 > ma20 then 'weak_bear' when ma5 < ma10 and ma10 < ma20 and ma20 < ma60 then 'strong_bear' else 'bear' end"


# the score adds up what is in order, and takes off for a price below its shortest mean
_SCORE = "50 + case when ma5 > ma10 then 10 else 0 end + case when ma10 > ma20 then 10 else 0 end + case when ma20 > ma60 then 10 else 0 end + case when c > ma5 then 5 else 0 end + case when c > ma5 and (c - ma5) * 100 < 10 * ma5 then 5 when c < ma5 then -10 else 0 end"
# Least scores of the signals, from the strongest on.
_SIGNALS = (("strong_buy", 85), ("buy", 70), ("hold", 55), ("watch", 40), ("reduce", 25))
_SIGNAL = "case " + " ".join(f"when score >= {n} then '{s}'" for s, n in _SIGNALS) + " else 'avoid' end"


@query("trend_analyze", f"with {S.FEATURES}, x as (select code, d, {_TREND} status, ({_SCORE})::int score from f where rn >= 61) select code, d::varchar trade_date, status, score, {_SIGNAL} signal from x")
def trend_analyze(spark, sf):
    """Order of the moving averages, a score of it, and the signal the score stands for."""
    x = B.features(bars_of(spark, sf)).where("rn >= 61").select("code", day(), F.expr(_TREND).alias("status"), F.expr(_SCORE).alias("score"))
    return x.withColumn("signal", F.expr(_SIGNAL))


@query("win_vol_ratio_chart", f"with {S.BARS}, x as (select code, d, v, {S._prev('sum(v)', 5)} s from bars) select code, d::varchar trade_date, {S.r4('(v / (s / 5))')} ratio from x where s > 0")
def win_vol_ratio_chart(spark, sf):
    """Volume over the sum of up to five bars before, divided by five even if there are fewer."""
    x = bars_of(spark, sf).withColumn("s", F.sum("v").over(B.prev_n(5))).where("s > 0")
    return x.select("code", day(), r4(F.col("v") / (F.col("s") / 5)).alias("ratio"))


@query("win_kdj", f"""with recursive {S.BARS}, b as (select code, row_number() {W} k, case when {S._last('max(h)', 9)} > {S._last('min(l)', 9)} then (c - {S._last('min(l)', 9)}) * 100 / ({S._last('max(h)', 9)} - {S._last('min(l)', 9)}) else 50::double end rsv from bars),
e as (select code, k, (2 * 50::double + rsv) / 3 kk, (2 * 50::double + (2 * 50::double + rsv) / 3) / 3 dd from b where k = 1 union all select b.code, b.k, (2 * e.kk + b.rsv) / 3, (2 * e.dd + (2 * e.kk + b.rsv) / 3) / 3 from e join b on b.code = e.code and b.k = e.k + 1)
select code, {S.r4('arg_max(kk, k)')} k, {S.r4('arg_max(dd, k)')} d from e group by code""")
def win_kdj(spark, sf):
    """Last K and D of every code: a recursive smoothing, folded over one code's ordered values (as many as the calendar)."""
    hi, lo = F.max("h").over(B.last_n(9)), F.min("l").over(B.last_n(9))
    rsv = F.when(hi > lo, (F.col("c") - lo) * 100 / F.when(hi > lo, hi - lo)).otherwise(50.0)
    rows = bars_of(spark, sf).select("code", "d", rsv.alias("rsv")).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("d", "rsv"))).alias("x"))
    step = lambda s, b: F.struct(((s["k"] * 2 + b["rsv"]) / 3).alias("k"), ((s["d"] * 2 + (s["k"] * 2 + b["rsv"]) / 3) / 3).alias("d"))
    last = F.aggregate("x", F.struct(F.lit(50.0).alias("k"), F.lit(50.0).alias("d")), step)
    return rows.withColumn("s", last).select("code", r4(F.col("s.k")).alias("k"), r4(F.col("s.d")).alias("d"))


# dashboards, lists, ledgers


@query("dash_group_hits", f"with {_HITS} select code, string_agg(distinct signal_id, ',' order by signal_id) signals from hits where d = (select max(d) from bars) group by code")
def dash_group_hits(spark, sf):
    top = bars_of(spark, sf).agg(F.max("d").alias("d"))
    return _hits(spark, sf).join(F.broadcast(top), "d").groupBy("code").agg(F.array_join(F.sort_array(F.collect_set("signal_id")), ",").alias("signals"))


@query("dash_bootstrap", f"with {_HITS}, {MASTER}, q as (select code, arg_max(c, d) c, arg_max(pc, d) pc, max(d) d from (select *, lag(c) {W} pc from bars) group by code), top as (select max(d) d from bars) select q.code, trim(m.name) as name, q.c, {S.r4('((q.c - q.pc) / q.pc * 100)')} change, q.d < top.d stale, (select count(*) from hits h where h.code = q.code and h.d = q.d) n_hits from q join master m on m.code = q.code, top where q.pc is not null")
def dash_bootstrap(spark, sf):
    b = bars_of(spark, sf)
    q = b.withColumn("pc", F.lag("c").over(B.by_code())).groupBy("code").agg(F.max_by("c", "d").alias("c"), F.max_by("pc", "d").alias("pc"), F.max("d").alias("d")).where("pc is not null")
    counts = _hits(spark, sf).groupBy("code", "d").agg(F.count(F.lit(1)).alias("n"))
    j = q.join(master_of(spark, sf).select("code", F.trim("name").alias("name")), "code").join(counts, ["code", "d"], "left").crossJoin(F.broadcast(b.agg(F.max("d").alias("top"))))
    return j.select("code", "name", "c", r4((F.col("c") - F.col("pc")) / F.col("pc") * 100).alias("change"), (F.col("d") < F.col("top")).alias("stale"), F.coalesce("n", F.lit(0)).alias("n_hits"))


_LIST = f"list as (select distinct {S.CODE} code, max(created_at) over (partition by {S.CODE}) added from analysis_decision_candidates where base_source = 'combined')"


@query("watchlist_list", f"with {MASTER}, {_LIST} select list.code, trim(m.name) as name, epoch_us(added) added_us from list left join master m on m.code = list.code")
def watchlist_list(spark, sf):
    added = table(spark, sf, "analysis_decision_candidates").where("base_source = 'combined'").groupBy(clean_code("code").alias("code")).agg(F.max("created_at").alias("added"))
    return added.join(master_of(spark, sf).select("code", F.trim("name").alias("name")), "code", "left").select("code", "name", pit.at_us("added").alias("added_us"))


@query("overview_compat", f"with {S.BARS}, x as (select *, lag(c) {W} pc from bars), t as (select code, d, {S.r4('((c - pc) * 100 / pc)')} chg from x where pc is not null and d = (select max(d) from bars)) (select code, chg, 'top' side from t order by chg desc, code limit 5) union all (select code, chg, 'bottom' side from t order by chg, code limit 5)")
def overview_compat(spark, sf):
    """Leaders and laggards of the newest date, five each."""
    b = bars_of(spark, sf)
    x = b.withColumn("pc", F.lag("c").over(B.by_code())).join(F.broadcast(b.agg(F.max("d").alias("d"))), "d").where("pc is not null").select("code", r4((F.col("c") - F.col("pc")) * 100 / F.col("pc")).alias("chg"))
    top, bottom = x.orderBy(F.desc("chg"), "code").limit(5), x.orderBy("chg", "code").limit(5)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


@query("sink_rebuild_table", f"with {S.BARS} select code, count(*) n from bars group by code")
def sink_rebuild_table(spark, sf):
    """Delete-all and insert-select: an overwrite, written twice and read back."""
    path = new_path(spark, "rebuilt")
    for _ in range(2):
        bars_of(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.schema("code string, n bigint").parquet(path)


@query("sink_manifest", None)
def sink_manifest(spark, sf):
    from tapeline.sources.providers import manifest

    path = new_path(spark, "manifest")
    bars_of(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.createDataFrame([(manifest(spark, path, {"table": "bars"}),)], "manifest string")


# research and patterns


@query("res_fingerprint", f"with {S.BARS} select d::varchar trade_date, sha256(string_agg(code || ':' || c::varchar || ':' || v::varchar, ',' order by code)) fingerprint from bars group by d")
def res_fingerprint(spark, sf):
    """A digest per date over the rows in order of code; as long as the list of codes."""
    line = F.concat_ws(":", "code", F.col("c").cast("string"), F.col("v").cast("string"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("code", line.alias("x")))), lambda s: s["x"])
    return bars_of(spark, sf).groupBy(day()).agg(F.sha2(F.array_join(lines, ","), 256).alias("fingerprint"))


_PATTERNS = (("slow_rise", "ma5 > ma20 and ma20 > ma60"), ("wide_day", "(h - l) * 100 > 5 * c"), ("quiet", "v * 2 < av20"))


@query("pat_match_market", f"with {S.FEATURES} " + " union all ".join(f"select code, d::varchar trade_date, '{n}' pattern from f where rn >= 60 and {c}" for n, c in _PATTERNS))
def pat_match_market(spark, sf):
    """All patterns against all bars in one projection, without a join of codes and patterns."""
    found = F.array_compact(F.array(*(F.when(F.expr(f"rn >= 60 and {c}"), F.lit(n)) for n, c in _PATTERNS)))
    return B.features(bars_of(spark, sf)).select("code", day(), F.explode(found).alias("pattern"))


@query("pattern_published_set", f"select support_tier, count(*) n, count(distinct {S.CODE}) n_codes from analysis_decision_candidates where base_source <> 'scan_ranker' group by 1")
def pattern_published_set(spark, sf):
    return table(spark, sf, "analysis_decision_candidates").where("base_source <> 'scan_ranker'").groupBy("support_tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(clean_code("code")).alias("n_codes"))


@query("chip_as_of", f"""with {S.BARS}, x as (select code, d, t, row_number() over (partition by code order by d desc) k from bars where d <= date '{CUT}') select code, d::varchar trade_date, t from x where k = 1""")
def chip_as_of(spark, sf):
    return pit.newest(bars_of(spark, sf).where(F.col("d") <= F.lit(CUT).cast("date")), ["code"], [F.desc("d")]).select("code", day(), "t")


@query("chip_sample_stratified", f"with {MASTER}, s as (select code, exchange, market, row_number() over (partition by exchange, market order by md5(code), code) k from master) select code, exchange, market from (select *, row_number() over (order by k, exchange, market) p from s) where p <= 20")
def chip_sample_stratified(spark, sf):
    """Round-robin over strata in hashed order: row numbers per stratum, then the first of all by (round, stratum)."""
    s = master_of(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("exchange", "market").orderBy(F.md5("code"), "code")))
    return s.orderBy("k", "exchange", "market").limit(20).select("code", "exchange", "market")


@query("agg_chip_errors", None)
def agg_chip_errors(spark, sf):
    """Mean, median and 90th percentile of the difference of both models' average cost, per exchange."""
    b = bars_of(spark, sf)
    cost = lambda x, n: x.groupBy("code").agg(F.sum(F.col("price") * F.col("weight")).alias(n))
    both = cost(C.legacy(b), "a").join(cost(C.model(b).withColumn("price", F.col("price") * 1000), "b"), "code").withColumn("e", F.abs(F.col("a") - F.col("b")) / F.col("b"))
    return both.groupBy(F.right("code", F.lit(2)).alias("exchange")).agg(r4(F.avg("e")).alias("mean"), r4(F.median("e")).alias("median"), r4(F.percentile("e", 0.9)).alias("p90"))


# evidence


_EC = f"e as (select evidence_id, {_CODE_IN} code, effective_trade_date d from first where {_CODE_IN} <> '' and effective_trade_date is not null)"


@query("evt_event_context", f"""with {MEMBERS}, {_FIRST}, {_EC}, x as (select e.evidence_id, m.sector_code, row_number() over (partition by e.evidence_id order by m.available_at desc, m.valid_from desc, m.valid_to desc nulls last, m.sector_code) k from e join members m on m.code = e.code and m.valid_from <= e.d and e.d <= coalesce(m.valid_to, date '9999-12-31'))
select e.evidence_id, e.code, x.sector_code from e left join x on x.evidence_id = e.evidence_id and x.k = 1""")
def evt_event_context(spark, sf):
    """Records with the code they name and its industry on the effective date."""
    e = first(spark, sf).select("evidence_id", F.regexp_extract("title", r"[0-9]{7}\.(SH|SZ|BJ)", 0).alias("code"), F.col("effective_trade_date").alias("d")).where("code <> '' and d is not null")
    matched = pit.member_on(pit.memberships(table(spark, sf, "stock_sector_membership")), e)
    order = [F.desc("available_at"), F.desc("valid_from"), F.desc_nulls_last("valid_to"), F.asc("sector_code")]
    return e.select("evidence_id", "code").join(pit.newest(matched, ["evidence_id"], order).select("evidence_id", "sector_code"), "evidence_id", "left")


@query("evt_confounders", f"with {_FIRST}, {_EC}, c as (select code, d, count(*) n from e group by 1, 2) select e.evidence_id, c.n - 1 n_others from e join c using (code, d) where c.n > 1")
def evt_confounders(spark, sf):
    """Other records of the same code and date: counted per key, not paired."""
    e = first(spark, sf).select("evidence_id", F.regexp_extract("title", r"[0-9]{7}\.(SH|SZ|BJ)", 0).alias("code"), F.col("effective_trade_date").alias("d")).where("code <> '' and d is not null")
    c = e.groupBy("code", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return e.join(c, ["code", "d"]).select("evidence_id", (F.col("n") - 1).alias("n_others"))


@query("evt_claim_graph_validate", "select evidence_id from market_event_evidence a where supersedes_evidence_id is not null and not exists (select 1 from market_event_evidence b where b.evidence_id = a.supersedes_evidence_id)")
def evt_claim_graph_validate(spark, sf):
    """Edges to records that do not exist: must be empty."""
    e = table(spark, sf, "market_event_evidence")
    known = e.select(F.col("evidence_id").alias("supersedes_evidence_id")).distinct()
    return e.where("supersedes_evidence_id is not null").join(known, "supersedes_evidence_id", "left_anti").select("evidence_id")


@query("evt_contracts", f"with {_FIRST}, s as (select distinct supersedes_evidence_id i from first where supersedes_evidence_id is not null) select f.evidence_id, s.i is not null superseded from first f left join s on s.i = f.evidence_id")
def evt_contracts(spark, sf):
    """Records and whether a later revision replaces them."""
    f = first(spark, sf)
    s = f.where("supersedes_evidence_id is not null").select(F.col("supersedes_evidence_id").alias("evidence_id")).distinct().withColumn("s", F.lit(True))
    return f.select("evidence_id").join(s, "evidence_id", "left").select("evidence_id", F.coalesce("s", F.lit(False)).alias("superseded"))


@query("stream_event_ingest", f"with {_FIRST} select source_id, strftime(max(first_seen_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') cursor_at, count(*) n from first group by 1")
def stream_event_ingest(spark, sf):
    """Cursor of every source after all deliveries; a redelivered record counts once."""
    return first(spark, sf).groupBy("source_id").agg(F.date_format(F.max("first_seen_at"), "yyyy-MM-dd HH:mm:ss").alias("cursor_at"), F.count(F.lit(1)).alias("n"))


QUERIES["detector_registry"] = lambda spark, sf: spark.createDataFrame([(n, b) for n, (b, _) in detectors.DETECTORS.items()], "signal_id string, min_bars int")
