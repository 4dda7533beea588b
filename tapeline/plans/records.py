"""Queries of small rules over records: tradable bars, navigation, caches, watch lists, refreshes, statistics of events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code
from tapeline.operators import bars as B
from tapeline.operators import chips as C
from tapeline.operators import records as R
from tapeline.plans import sql as S
from tapeline.plans.evidence import _CODE_IN, _FIRST, first
from tapeline.plans.market import CUT, MASTER, day, master_of, r4
from tapeline.plans.research import _CHIP
from tapeline.plans.signals import bars_of
from tapeline.sources.market import MarketData, PointInTimeData, feed_after, parquet_tables
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("flt_tradable", f"with {S.LATEST}, {MASTER} select l.code, l.d::varchar trade_date from latest l left join master m using (code) where coalesce(a, 0) > 0 and coalesce(c, 0) > 0 and coalesce(v, 0) > 0 and not coalesce(regexp_matches(trim(name), '^\\*?ST'), false) and coalesce(list_status, 'L') <> 'P'")
def flt_tradable(spark, sf):
    """Latest bars with amount, price and volume above zero, of codes neither paused nor under special treatment."""
    rows = B.latest_bars(table(spark, sf, "stock_daily_bar_versions")).where("a > 0 and c > 0 and v > 0")
    m = master_of(spark, sf).select("code", F.coalesce(F.trim("name").rlike(r"^\*?ST"), F.lit(False)).alias("st"), F.coalesce("list_status", F.lit("L")).alias("s"))
    return rows.join(m, "code", "left").where("not coalesce(st, false) and coalesce(s, 'L') <> 'P'").select("code", day())


@query("nav_prev_next", f"with {MASTER} select code, lag(code) over (order by code) prev_code, lead(code) over (order by code) next_code, row_number() over (order by code) place from master")
def nav_prev_next(spark, sf):
    """Neighbours in the ordered list of codes."""
    return R.neighbours(master_of(spark, sf), "code").select("code", F.col("prev").alias("prev_code"), F.col("next").alias("next_code"), "place")


@query("sink_redis_cache", f"with w as (select run_id, arg_max(final_score, (created_at, final_score)) final_score, max(created_at) t from analysis_decision_candidates where run_id is not null and final_score is not null and not isnan(final_score) and created_at <= timestamptz '{CUT} 00:00:00+00' group by 1) select run_id, final_score, epoch_us(t + interval 10 day) expires_us from w where t + interval 10 day > timestamptz '{CUT} 00:00:00+00'")
def sink_redis_cache(spark, sf):
    """Entries alive at the cut-off of a cache that keeps the last score of a run for ten days."""
    rows = table(spark, sf, "analysis_decision_candidates").where("final_score is not null and not isnan(final_score)").withColumn("at", F.col("created_at").cast("timestamp"))
    found = R.live_entries(rows, "run_id", "final_score", "at", 10 * 86_400, F.lit(f"{CUT} 00:00:00").cast("timestamp"))
    return found.select("run_id", "final_score", F.unix_micros("expires_at").alias("expires_us"))


_ACTIONS = f"x as (select {S.CODE} code, case when support_tier = 'reject' then 'remove' when support_tier in ('A', 'B') then 'add' end act, created_at t from analysis_decision_candidates where code is not null and created_at is not null)"


@query("watchlist_changes", f"with {_ACTIONS}, o as (select code, max(t) t from x where act = 'remove' group by 1) select x.code, epoch_us(min(x.t)) since_us from x left join o using (code) where act = 'add' and (o.t is null or x.t >= o.t) group by 1")
def watchlist_changes(spark, sf):
    """Codes on a list to which supported candidates are added and from which rejected ones are removed."""
    act = F.when(F.col("support_tier") == "reject", "remove").when(F.col("support_tier").isin("A", "B"), "add")
    rows = table(spark, sf, "analysis_decision_candidates").select(clean_code("code").alias("code"), act.alias("act"), F.col("created_at").cast("timestamp").alias("t"))
    return R.watch_list(rows, "code", "act", "t").select("code", F.unix_micros("since").alias("since_us"))


_VALUES = ["open", "high", "low", "close", "volume", "amount"]
_GOOD = "code is not null and trade_date is not null and close > 0 and volume > 0"
_KEYED = f"v as (select {S.CODE} code, trade_date, available_at, {', '.join(_VALUES)}, available_at <= timestamptz '{CUT} 00:00:00+00' old from stock_daily_bar_versions where available_at is not null), good as (select distinct code, trade_date, {', '.join(_VALUES)} from v where not old and {_GOOD})"


@query(
    "pit_refresh_ledger",
    f"""with {_KEYED}, held as (select code, trade_date, {', '.join(f"arg_max_null({c}, (available_at, {', '.join(_VALUES)})) h_{c}" for c in _VALUES)} from v where old and code is not null and trade_date is not null group by 1, 2),
j as (select {' and '.join(f'g.{c} is not distinct from h_{c}' for c in _VALUES)} and held.code is not null same from good g left join held using (code, trade_date)),
c as (select count(*) received, count(*) filter (not coalesce({_GOOD}, false)) rejected from v where not old) select received, rejected, (select count(*) filter (same) from j) unchanged, (select count(*) filter (not same) from j) appended from c""",
)
def pit_refresh_ledger(spark, sf):
    """Bar versions that became known after the cut-off, refreshed into those known before it: what each step does."""
    rows = table(spark, sf, "stock_daily_bar_versions").where("available_at is not null").select(clean_code("code").alias("code"), "trade_date", F.col("available_at").cast("timestamp").alias("available_at"), *_VALUES)
    old = F.col("available_at") <= F.lit(f"{CUT} 00:00:00").cast("timestamp")
    known = rows.where(old & F.col("code").isNotNull() & F.col("trade_date").isNotNull())
    return R.refreshed(known, rows.where(~old), ["code", "trade_date"], _VALUES, F.expr(_GOOD))[1]


@query("evt_score_normalize", f"select run_id, {S.CODE} code, trade_date::varchar trade_date, 0.0::double event_adjustment, {S.r6('(base_score + risk_adjustment)')} final_score from analysis_decision_candidates where not isnan(base_score + risk_adjustment)")
def evt_score_normalize(spark, sf):
    """Candidates without the events' part: the adjustment is taken out, the score is base and risk."""
    rows = table(spark, sf, "analysis_decision_candidates")
    total = F.col("base_score") + F.col("risk_adjustment")
    rounded = F.signum(total) * F.floor(F.abs(total) * 1e6 + 0.5) / 1e6
    return rows.where(total.isNotNull() & ~F.isnan(total)).select("run_id", clean_code("code").alias("code"), F.col("trade_date").cast("date").cast("string").alias("trade_date"), F.lit(0.0).alias("event_adjustment"), rounded.alias("final_score"))


_TIER = "case source_tier when 'tier1' then 1.0::double when 'tier2' then 0.7::double else 0.4::double end"


@query("evt_causal_conf", f"""with {_FIRST}, e as (select evidence_id, {_CODE_IN} code, effective_trade_date d, {_TIER} s, case when published_at is null then 0.5::double when published_at <= first_seen_at then 1.0::double else 0.0::double end t from first where evidence_id is not null),
n as (select code, d, count(*) - 1 others from e where code <> '' and d is not null group by 1, 2) select e.evidence_id, round((s + t + case when e.code <> '' then 1.0::double else 0.3::double end) / 3 * case when coalesce(others, 0) > 0 then 0.5::double else 1.0::double end, 6) confidence from e left join n on n.code = e.code and n.d = e.d""")
def evt_causal_conf(spark, sf):
    """Source tier, order of publication and first sight, and a named code, halved where the code has other records that day."""
    tier = F.when(F.col("source_tier") == "tier1", 1.0).when(F.col("source_tier") == "tier2", 0.7).otherwise(0.4)
    timing = F.when(F.col("published_at").isNull(), 0.5).when(F.col("published_at") <= F.col("first_seen_at"), 1.0).otherwise(0.0)
    code = F.coalesce(F.regexp_extract("title", r"[0-9]{7}\.(SH|SZ|BJ)", 0), F.lit(""))
    e = first(spark, sf).where("evidence_id is not null").select("evidence_id", code.alias("code"), F.col("effective_trade_date").alias("d"), tier.alias("s"), timing.alias("t"))
    others = e.where("code <> '' and d is not null").groupBy("code", "d").agg((F.count(F.lit(1)) - 1).alias("others"))
    named = F.when(F.col("code") != "", 1.0).otherwise(0.3)
    return e.join(others, ["code", "d"], "left").select("evidence_id", R.causal_confidence(F.col("s"), F.col("t"), named, F.coalesce("others", F.lit(0))).alias("confidence"))


_OBS = f"""{S.BARS}, {_FIRST}, rt as (select code, d, floor((c / lag(c) over (partition by code order by d) - 1) * 1000000::double)::bigint r, t - lag(t) over (partition by code order by d) dt from bars),
ab as (select code, d, r - sum(r) over (partition by d) / count(r) over (partition by d) ab, dt, sum(case when r > 0 then 1 else 0 end) over (partition by d) * 1000000 / count(r) over (partition by d) br from rt where r is not null),
ob as (select coalesce(source_tier, '') kind, coalesce(language, '') subtype, ab, dt, br, f.status <> 'active' failed from first f join ab on ab.code = {_CODE_IN} and ab.d = f.effective_trade_date where f.available_at <= timestamptz '{CUT} 00:00:00+00' and f.first_seen_at <= timestamptz '{CUT} 00:00:00+00')"""


@query("agg_event_stats", f"with {_OBS} select kind, subtype, count(*) n, {S.r4('median(ab)')} abnormal, {S.r4('median(dt)')} turnover, {S.r4('median(br)')} breadth, {S.r4('(count(*) filter (ab > 0) / count(*))')} positive_rate, {S.r4('(count(*) filter (coalesce(failed, false)) / count(*))')} failure_rate from ob group by 1, 2")
def agg_event_stats(spark, sf):
    """Records known at the cut-off, by tier and language: medians of the abnormal return, the change of turnover and the
    market's breadth on the day they take effect, and the shares of rises and of records no longer active."""
    by_date = Window.partitionBy("d")
    rt = bars_of(spark, sf).select("code", "d", F.floor((F.col("c") / F.lag("c").over(B.by_code()) - 1) * 1e6).alias("r"), (F.col("t") - F.lag("t").over(B.by_code())).alias("dt")).where("r is not null")
    n = F.count("r").over(by_date)
    ab = rt.select("code", "d", (F.col("r") - F.sum("r").over(by_date) / n).alias("ab"), "dt", (F.sum(F.when(F.col("r") > 0, 1).otherwise(0)).over(by_date) * 1000000 / n).alias("br"))
    cut = F.lit(f"{CUT} 00:00:00").cast("timestamp")
    f = first(spark, sf).where((F.col("available_at") <= cut) & (F.col("first_seen_at") <= cut))
    f = f.select(F.coalesce("source_tier", F.lit("")).alias("kind"), F.coalesce("language", F.lit("")).alias("subtype"), F.regexp_extract("title", r"[0-9]{7}\.(SH|SZ|BJ)", 0).alias("code"), F.col("effective_trade_date").alias("d"), F.coalesce(F.col("status") != "active", F.lit(False)).alias("failed"))
    g = f.join(ab, ["code", "d"]).groupBy("kind", "subtype")
    share = lambda c: F.count_if(F.expr(c)) / F.count(F.lit(1))
    return g.agg(F.count(F.lit(1)).alias("n"), r4(F.median("ab")).alias("abnormal"), r4(F.median("dt")).alias("turnover"), r4(F.median("br")).alias("breadth"), r4(share("ab > 0")).alias("positive_rate"), r4(share("failed")).alias("failure_rate"))


@query("chip_decode_legacy", f"with {_CHIP}, k as (select code, bucket, weight / nullif(max(weight) over (partition by code), 0) * 100 rel from ch) select code, bucket::int bucket, {S.r4('rel')} relative, {S.r4('(rel / sum(rel) over (partition by code))')} probability from k")
def chip_decode_legacy(spark, sf):
    """Peak-relative percentages and back to probabilities."""
    x = C.legacy(bars_of(spark, sf))
    y = x.withColumn("relative", F.col("weight") / F.nullif(F.max("weight").over(Window.partitionBy("code")), F.lit(0.0)) * 100)
    return y.withColumn("again", F.col("relative") / F.sum("relative").over(Window.partitionBy("code"))).select("code", "bucket", r4(F.col("relative")).alias("relative"), r4(F.col("again")).alias("probability"))


@query("chip_gate", None)
def chip_gate(spark, sf):
    """Whether the sequential model may replace the closed form, by their differences per code, exchanges as parts."""
    b = bars_of(spark, sf)
    closes = b.groupBy("code").agg(F.max_by("c", "d").alias("c"))
    one, two = C.metrics(C.legacy(b), closes), C.metrics(C.model(b).withColumn("price", F.col("price") * 1000), closes)
    both = one.alias("a").join(two.alias("b"), "code")
    part = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    errors = both.select(F.right("code", F.lit(2)).alias("part"), (part("avg_cost") / F.col("a.avg_cost")).alias("cost"), (part("dominant") / F.col("a.dominant")).alias("peak"), (part("winner") * 100).alias("winner"))
    return R.cost_gate(errors)


@query("stream_chip_daily", "with x as (select event_id, ts, (ts + interval 8 hour)::date d, (((extract(hour from ts) * 60 + extract(minute from ts)) + 480) % 1440 - 1080) m from events), s as (select *, floor(m / 30)::int slot from x where m >= 0 and m < 150) select d::varchar trade_date, slot, min(event_id) first_event, count(*) attempts from s group by 1, 2")
def stream_chip_daily(spark, sf):
    """The evening's half-hour slots, each run once: the first event of a slot starts it, the others find it done."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    local = F.timestamp_micros(F.unix_micros("at") + 8 * 3_600_000_000)
    rows = e.select("event_id", R.evening_slot(F.col("at")).alias("slot"), local.cast("date").cast("string").alias("trade_date")).where("slot is not null")
    return rows.groupBy("trade_date", "slot").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("attempts"))


# providers


_D1, _D2, _DAY = date(2024, 3, 1), date(2024, 4, 30), date(2024, 4, 10)


@query("src_provider_api", f"with {S.BARS} select 'stock' call, code, d::varchar trade_date, c from bars where code = '9000001.SH' and d between date '{_D1}' and date '{_D2}' union all select 'date', code, d::varchar, c from bars where d = date '{_DAY}' union all select distinct 'calendar', '', trade_date::varchar, null from stock_daily_bar_versions where trade_date between date '{_D1}' and date '{_D2}'")
def src_provider_api(spark, sf):
    """Bars of a code, bars of a date and the calendar, through the provider."""
    p = MarketData(spark, parquet_tables(sf))
    part = lambda rows, call: rows.select(F.lit(call).alias("call"), "code", day(), "c")
    calendar = p.trading_dates(_D1, _D2).select(F.lit("calendar").alias("call"), F.lit("").alias("code"), day(), F.lit(None).cast("bigint").alias("c"))
    return part(p.daily_bars_for_stock(" 9000001.sh", _D1, _D2), "stock").unionByName(part(p.daily_bars_by_date(_DAY), "date")).unionByName(calendar)


_UNTIL = f"available_at <= timestamptz '{CUT} 00:00:00+00'"


@query(
    "src_pit_provider",
    f"""with m as (select {S.CODE} code, name, list_status from security_master_versions where code is not null and {_UNTIL} qualify row_number() over (partition by {S.CODE} order by available_at desc, ingested_at desc, source) = 1),
s as (select {S.CODE} code, sector_code, valid_from, valid_to from stock_sector_membership where code is not null and sector_type = 'industry' and {_UNTIL} qualify row_number() over (partition by {S.CODE}, sector_code, valid_from order by available_at desc, valid_to desc nulls first) = 1)
select 'status' call, code, list_status || '|' || coalesce(regexp_matches(trim(name), '^\\*?ST'), false)::varchar as value from m union all select distinct 'sector', code, sector_code from s where valid_from <= date '{_DAY}' and coalesce(valid_to, date '9999-12-31') >= date '{_DAY}'""",
)
def src_pit_provider(spark, sf):
    """Statuses and memberships as known at the cut-off, through the point-in-time provider."""
    p = PointInTimeData(spark, parquet_tables(sf))
    status = p.security_statuses(f"{CUT} 00:00:00").select(F.lit("status").alias("call"), "code", F.concat("list_status", F.lit("|"), F.col("special").cast("string")).alias("value"))
    return status.unionByName(p.sector_memberships(_DAY, f"{CUT} 00:00:00").select(F.lit("sector").alias("call"), "code", F.col("sector_code").alias("value")))


_CUT_US = 1_717_113_600_000_000  # the cut-off in microseconds


@query("src_event_feed", f"with s as (select evidence_id, min(epoch_us(first_seen_at)) seen_us from market_event_evidence where evidence_id is not null and first_seen_at is not null group by 1) select * from s where seen_us > (select max(seen_us) from s) - 30 * 86400000000 and (seen_us, evidence_id) > ({_CUT_US}, '')")
def src_event_feed(spark, sf):
    """What a feed gives after the cut-off, with thirty days of retention."""
    return feed_after(table(spark, sf, "market_event_evidence"), _CUT_US, "", 30 * 86_400_000_000)
