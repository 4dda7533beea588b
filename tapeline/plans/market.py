"""Queries of sources, sinks, filters, joins and aggregations over market tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, clean_word, round_half
from tapeline.operators import bars as B
from tapeline.operators import pit, sinks
from tapeline.plans import sql as S
from tapeline.plans.signals import bars_of
from tapeline.scratch import new_path
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}
CUT = "2024-05-31"


def query(name, sql):
    """Registers a query under ``name`` with its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def latest_of(spark, sf):
    return B.latest_bars(table(spark, sf, "stock_daily_bar_versions"))


def master_of(spark, sf):
    return pit.master_now(table(spark, sf, "security_master_versions"))


def day(c="d", name="trade_date"):
    return F.col(c).cast("string").alias(name)


def r4(c):
    return round_half(c, 4)


MASTER = f"""master as (select * replace ({S.CODE} as code) from security_master_versions qualify row_number() over (partition by {S.CODE} order by available_at desc, ingested_at desc, source) = 1)"""
MEMBERS = f"""members as (select * replace ({S.CODE} as code) from stock_sector_membership where sector_type = 'industry'
qualify row_number() over (partition by {S.CODE}, sector_code, valid_from order by available_at desc, valid_to desc nulls first) = 1)"""
SECTOR_ON = f"""{S.BARS}, {MEMBERS}, sect as (select b.*, m.sector_code from bars b join members m on m.code = b.code and m.valid_from <= b.d and b.d <= coalesce(m.valid_to, date '9999-12-31')
qualify row_number() over (partition by b.code, b.d order by m.available_at desc, m.valid_from desc, m.valid_to desc nulls last, m.sector_code) = 1)"""


# sources


@query("src_recent_bars", f"with {S.BARS} select code, d::varchar trade_date, o, h, l, c, v from bars qualify row_number() over (partition by code order by d desc) <= 20")
def src_recent_bars(spark, sf):
    w = Window.partitionBy("code").orderBy(F.desc("d"))
    return bars_of(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 20").select("code", day(), "o", "h", "l", "c", "v")


@query("win_history_tail", f"with {S.BARS} select code, d::varchar trade_date, row_number() over (partition by code order by d desc) k from bars qualify k <= 5")
def win_history_tail(spark, sf):
    w = Window.partitionBy("code").orderBy(F.desc("d"))
    return bars_of(spark, sf).withColumn("k", F.row_number().over(w).cast("bigint")).where("k <= 5").select("code", day(), "k")


@query("src_bars_asof_date", f"with {S.BARS} select code, d::varchar trade_date, c, v from bars where d <= date '{CUT}' qualify row_number() over (partition by code order by d desc) <= 20")
def src_bars_asof_date(spark, sf):
    w = Window.partitionBy("code").orderBy(F.desc("d"))
    return bars_of(spark, sf).where(F.col("d") <= F.lit(CUT).cast("date")).withColumn("k", F.row_number().over(w)).where("k <= 20").select("code", day(), "c", "v")


@query("src_codes_distinct", f"select distinct {S.CODE} code from stock_daily_bar_versions order by 1")
def src_codes_distinct(spark, sf):
    return table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code")).distinct().orderBy("code")


@query("src_latest_date", "select max(trade_date)::varchar latest from stock_daily_bar_versions")
def src_latest_date(spark, sf):
    return table(spark, sf, "stock_daily_bar_versions").agg(F.max("trade_date").cast("string").alias("latest"))


@query("hist_latest_trading_date", f"select max(trade_date)::varchar latest from stock_daily_bar_versions where trade_date <= date '{CUT}'")
def hist_latest_trading_date(spark, sf):
    return table(spark, sf, "stock_daily_bar_versions").where(F.col("trade_date") <= F.lit(CUT).cast("date")).agg(F.max("trade_date").cast("string").alias("latest"))


_INVALID = f"{S.LATEST}, bad as (select * from latest where a > 0 and coalesce(v, 0) <= 0)"


def _invalid(spark, sf):
    return latest_of(spark, sf).where("a > 0 and coalesce(v, 0) <= 0")


@query("src_invalid_volume_dates", f"with {_INVALID} select distinct d::varchar trade_date from bad")
def src_invalid_volume_dates(spark, sf):
    return _invalid(spark, sf).select(day()).distinct()


@query("src_invalid_volume_count", f"with {_INVALID} select count(*) n, count(distinct d) n_dates from bad")
def src_invalid_volume_count(spark, sf):
    return _invalid(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("d").alias("n_dates"))


@query("src_resolve_code", f"""with codes as (select distinct {S.CODE} code from stock_daily_bar_versions), asked as (select distinct split_part(code, '.', 1) short from codes)
select short, code from asked join codes on split_part(code, '.', 1) = short qualify row_number() over (partition by short order by case when short like '6%' and code like '%.SH' then 0 when short not like '6%' and code like '%.SZ' then 0 else 1 end, code) = 1""")
def src_resolve_code(spark, sf):
    codes = src_codes_distinct(spark, sf).withColumn("short", F.split_part("code", F.lit("."), F.lit(1)))
    six = F.col("short").startswith("6")
    rank = F.when((six & F.col("code").endswith(".SH")) | (~six & F.col("code").endswith(".SZ")), 0).otherwise(1)
    return pit.newest(codes.withColumn("rank", rank), ["short"], [F.asc("rank"), F.asc("code")]).select("short", "code")


@query("src_search_stocks", f"with {MASTER} select code, trim(name) as name from master where code ilike '%00%' or name ilike '%00%' order by code limit 50")
def src_search_stocks(spark, sf):
    found = master_of(spark, sf).where("code ilike '%00%' or name ilike '%00%'")
    return found.select("code", F.trim("name").alias("name")).orderBy("code").limit(50)


PRIORITY = ("feed_alder", "feed_birch", "backfill_cedar", "desk_upload")
_USABLE = "coalesce(open, 0) > 0 and coalesce(high, 0) > 0 and coalesce(low, 0) > 0 and coalesce(close, 0) > 0 and (coalesce(amount, 0) <= 0 or coalesce(volume, 0) > 0)"
_RANK = "case source " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(PRIORITY)) + " else 9 end"


@query("src_fallback_chain", f"""with g as (select {S.CODE} code, trade_date, {_RANK} p, source, bool_and({_USABLE}) ok, count(*) n from stock_daily_bar_versions group by all)
select code, trade_date::varchar trade_date, source, n n_rows from g where ok qualify row_number() over (partition by code, trade_date order by p, source) = 1""")
def src_fallback_chain(spark, sf):
    """Of the sources of each code and date, in order, the first whose whole batch is usable."""
    rows = table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code"), "trade_date", "source", F.expr(_RANK).alias("p"), F.expr(_USABLE).alias("ok"))
    batches = rows.groupBy("code", "trade_date", "p", "source").agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n_rows")).where("ok")
    return pit.newest(batches, ["code", "trade_date"], [F.asc("p"), F.asc("source")]).select("code", day("trade_date"), "source", "n_rows")


@query("src_sina_parse", f"""with {S.BARS} select code, o, c, d::varchar || ' 15:00:00' quoted_at, {S.r4('((c - o) / o * 100)')} change_pct from bars""")
def src_sina_parse(spark, sf):
    """Quote lines (name, open, last, .., date, time at fields 31 and 32) written from bars and parsed back."""
    pad = ",".join(["0"] * 27)
    line = F.concat(F.lit('var hq="'), F.concat_ws(",", "code", "o", "c", F.lit(pad), F.col("d").cast("string"), F.lit("15:00:00")), F.lit('";'))
    body = F.split(F.regexp_extract("line", '"([^"]*)"', 1), ",")
    parsed = bars_of(spark, sf).select(line.alias("line")).select(body.alias("f")).where(F.size("f") >= 32)
    field = lambda i: F.element_at("f", i)
    o, c = field(2).cast("bigint"), field(3).cast("bigint")
    stamp = F.date_format(F.try_to_timestamp(F.concat_ws(" ", field(31), field(32))), "yyyy-MM-dd HH:mm:ss")
    return parsed.select(field(1).alias("code"), o.alias("o"), c.alias("c"), stamp.alias("quoted_at"), r4((c - o) / o * 100).alias("change_pct"))


@query("src_parquet_research", "select lower(trim(horizon)) horizon, year(trade_date)::bigint as \"year\", count(*) n from analysis_decision_candidates where year(trade_date) >= 2015 group by all")
def src_parquet_research(spark, sf):
    """Hive-partitioned by horizon and year, read back with the partitions pruned."""
    path = new_path(spark, "research")
    rows = table(spark, sf, "analysis_decision_candidates").select(clean_word("horizon").alias("horizon"), F.year("trade_date").alias("year"), "run_id", "code")
    sinks.write_partitioned(rows, path, ["horizon", "year"])
    return spark.read.parquet(path).where("year >= 2015").groupBy("horizon", F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


_STAGED = ("stock_daily_bar_versions", "security_master_versions", "stock_sector_membership")


@query("src_pg_stage", " union all ".join(f"select '{t}' source_table, count(*) n from {t} where available_at <= timestamptz '{CUT} 00:00:00+00'" for t in _STAGED))
def src_pg_stage(spark, sf):
    """Tables staged as of a cut-off; the filter reaches the scan."""
    parts = [table(spark, sf, t).where(F.col("available_at") <= F.lit(f"{CUT} 00:00:00").cast("timestamp")).agg(F.lit(t).alias("source_table"), F.count(F.lit(1)).alias("n")) for t in _STAGED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src_gdelt", "select evidence_id, title from market_event_evidence where published_at > timestamptz '2024-05-01 00:00:00+00' or (published_at = timestamptz '2024-05-01 00:00:00+00' and evidence_id > 'm')")
def src_gdelt(spark, sf):
    """Cursor strictly after (published_at, id): a tuple comparison spelled out."""
    t = F.lit("2024-05-01 00:00:00").cast("timestamp")
    after = (F.col("published_at") > t) | ((F.col("published_at") == t) & (F.col("evidence_id") > "m"))
    return table(spark, sf, "market_event_evidence").where(after).select("evidence_id", "title")


# sinks


@query("sink_upsert_bars", f"""with o as (select {S.CODE} code, trade_date d, close x, volume v, pe from stock_daily_bar_versions where available_at <= timestamptz '{CUT} 00:00:00+00' qualify row_number() over (partition by {S.CODE}, trade_date order by available_at, ingested_at, source) = 1),
n as (select {S.CODE} code, trade_date d, close x, volume v, pe from stock_daily_bar_versions where available_at > timestamptz '2024-01-10 00:00:00+00' qualify row_number() over (partition by {S.CODE}, trade_date order by available_at desc, ingested_at desc, source) = 1)
select coalesce(n.code, o.code) code, coalesce(n.d, o.d)::varchar trade_date, case when n.x > 0 then n.x else coalesce(o.x, n.x) end x, case when n.v > 0 then n.v else coalesce(o.v, n.v) end v, coalesce(n.pe, o.pe) pe from o full join n on o.code = n.code and o.d = n.d""")
def sink_upsert_bars(spark, sf):
    rows = table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code"), F.col("trade_date").alias("d"), F.col("close").alias("x"), F.col("volume").alias("v"), "pe", "available_at", "ingested_at", "source")
    at = F.col("available_at")
    stored = pit.newest(rows.where(at <= F.lit(f"{CUT} 00:00:00").cast("timestamp")), ["code", "d"], [F.asc("available_at"), F.asc("ingested_at"), F.asc("source")])
    batch = pit.newest(rows.where(at > F.lit("2024-01-10 00:00:00").cast("timestamp")), ["code", "d"], [F.desc("available_at"), F.desc("ingested_at"), F.asc("source")])
    return sinks.upsert_positive(stored, batch, ["code", "d"], ["x", "v"], ["pe"]).select("code", day(), "x", "v", "pe")


@query("sink_append_versions", f"select count(*) n, count(distinct {S.CODE}) n_codes from (select distinct {S.CODE} code, trade_date, available_at from stock_daily_bar_versions)")
def sink_append_versions(spark, sf):
    """Half of the versions stored, all of them sent again: the append leaves one row per key."""
    rows = table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code"), "trade_date", "available_at")
    stored = rows.where(F.col("available_at") <= F.lit(CUT).cast("timestamp")).distinct()
    return sinks.append_new(stored, rows, ["code", "trade_date", "available_at"]).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("n_codes"))


@query("sink_upsert_last_wins", f"select run_id, {S.CODE} code, lower(trim(horizon)) horizon, trade_date::date::varchar trade_date, base_source from analysis_decision_candidates qualify row_number() over (partition by run_id, {S.CODE}, lower(trim(horizon)) order by created_at desc, base_source) = 1")
def sink_upsert_last_wins(spark, sf):
    rows = table(spark, sf, "analysis_decision_candidates").select("run_id", clean_code("code").alias("code"), clean_word("horizon").alias("horizon"), day("trade_date"), "base_source", "created_at")
    return sinks.last_wins(rows, ["run_id", "code", "horizon"], [F.desc("created_at"), F.asc("base_source")]).drop("created_at")


@query("sink_conditional_upsert", f"select {S.CODE} code, trade_date::varchar trade_date, availability_quality, source from stock_daily_bar_versions qualify row_number() over (partition by {S.CODE}, trade_date order by case availability_quality when 'observed' then 0 else 1 end, available_at desc, ingested_at desc, source) = 1")
def sink_conditional_upsert(spark, sf):
    """An estimated version never replaces an observed one."""
    rows = table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code"), "trade_date", "availability_quality", "source", "available_at", "ingested_at")
    rank = F.when(F.col("availability_quality") == "observed", 0).otherwise(1)
    return sinks.last_wins(rows, ["code", "trade_date"], [rank, F.desc("available_at"), F.desc("ingested_at"), F.asc("source")]).select("code", day("trade_date"), "availability_quality", "source")


@query("sink_weighted_avg_upsert", f"""select l_suppkey, l_partkey, sum(l_quantity::bigint)::bigint shares, {S.r4('(sum(floor(l_extendedprice * 100 + 0.5::double)::bigint) / sum(l_quantity::bigint))')} cost_cents from lineitem group by 1, 2""")
def sink_weighted_avg_upsert(spark, sf):
    shares = F.sum(F.col("l_quantity").cast("bigint"))
    cents = F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5))
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(shares.alias("shares"), r4(cents / shares).alias("cost_cents"))


_ONE_MOMENT = f"m1 as (select {S.CODE} code, available_at ta, trim(name) nm, list_status ls from security_master_versions qualify row_number() over (partition by {S.CODE}, available_at order by ingested_at desc, source) = 1)"


@query("sink_unchanged_skip", f"""with {_ONE_MOMENT}, x as (select *, lag(nm) over w pn, lag(ls) over w pl, row_number() over w rn from m1 window w as (partition by code order by ta))
select code, epoch_us(ta) at_us, nm as name, ls list_status from x where rn = 1 or nm is distinct from pn or ls is distinct from pl""")
def sink_unchanged_skip(spark, sf):
    rows = table(spark, sf, "security_master_versions").withColumn("code", clean_code("code")).withColumn("name", F.trim("name"))
    one = sinks.last_wins(rows, ["code", "available_at"], [F.desc("ingested_at"), F.asc("source")])
    return sinks.skip_unchanged(one, ["code"], [F.asc("available_at")], ["name", "list_status"]).select("code", pit.at_us("available_at").alias("at_us"), "name", "list_status")


@query("sink_immutable_conflict", f"select run_id, {S.CODE} code, lower(trim(horizon)) horizon, count(distinct final_score)::bigint n_payloads from analysis_decision_candidates where final_score is not null group by all having count(distinct final_score) > 1")
def sink_immutable_conflict(spark, sf):
    rows = table(spark, sf, "analysis_decision_candidates").where("final_score is not null").select("run_id", clean_code("code").alias("code"), clean_word("horizon").alias("horizon"), "final_score")
    return sinks.conflicts(rows, ["run_id", "code", "horizon"], ["final_score"])


@query("sink_report_text", "select source_id, arg_max(title, (first_seen_at, evidence_id)) title, max(first_seen_at)::timestamp::varchar[:19] last_seen from market_event_evidence group by 1")
def sink_report_text(spark, sf):
    e = table(spark, sf, "market_event_evidence").where("title is not null")
    return e.groupBy("source_id").agg(F.max_by("title", F.struct("first_seen_at", "evidence_id")).alias("title"), F.date_format(F.max("first_seen_at"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


ORACLES["sink_report_text"] = "select source_id, arg_max(title, (first_seen_at, evidence_id)) title, strftime(max(first_seen_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') last_seen from market_event_evidence where title is not null group by 1"


# filters and projections


@query("flt_valid_bar", f"with {S.LATEST} select d::varchar trade_date, count(*) n from latest where o > 0 and h > 0 and l > 0 and c > 0 and v > 0 and a is not null group by d")
def flt_valid_bar(spark, sf):
    return latest_of(spark, sf).where("o > 0 and h > 0 and l > 0 and c > 0 and v > 0 and a is not null").groupBy(day()).agg(F.count(F.lit(1)).alias("n"))


@query("flt_current_listed", f"with {MASTER} select code from master where list_status = 'L' and list_date <= date '{CUT}' and (delist_date is null or delist_date > date '{CUT}')")
def flt_current_listed(spark, sf):
    d = F.lit(CUT).cast("date")
    return master_of(spark, sf).where((F.col("list_status") == "L") & (F.col("list_date") <= d) & (F.col("delist_date").isNull() | (F.col("delist_date") > d))).select("code")


_MISSING = ", ".join(f"case when {c} is null then '{n}' end" for n, c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"), ("amount", "a")))


@query("prj_status_invalidations", f"with {S.LATEST} select code, d::varchar trade_date, array_to_string(list_filter([{_MISSING}], lambda x: x is not null), ',') missing from latest where o is null or h is null or l is null or c is null or v is null or a is null")
def prj_status_invalidations(spark, sf):
    names = (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"), ("amount", "a"))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(n)) for n, c in names)))
    return latest_of(spark, sf).withColumn("m", missing).where(F.size("m") > 0).select("code", day(), F.array_join("m", ",").alias("missing"))


@query("prj_quality_flags", f"with {S.LATEST} select code, d::varchar trade_date, array_to_string(list_filter([case when t is null then 'no_turnover' end, case when pe is null then 'no_pe' end, case when coalesce(v, 0) = 0 then 'no_volume' end, case when h < l then 'crossed' end], lambda x: x is not null), ',') flags from latest")
def prj_quality_flags(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("t").isNull(), F.lit("no_turnover")), F.when(F.col("pe").isNull(), F.lit("no_pe")), F.when(F.coalesce("v", F.lit(0)) == 0, F.lit("no_volume")), F.when(F.col("h") < F.col("l"), F.lit("crossed"))))
    return latest_of(spark, sf).select("code", day(), F.array_join(flags, ",").alias("flags"))


@query("prj_case_exclusion", f"with {S.LATEST}, {MASTER} select l.code, d::varchar trade_date, case when l.t is null then 'missing_turnover' when m.list_status is null then 'missing_status' end reason from latest l left join master m on m.code = l.code")
def prj_case_exclusion(spark, sf):
    joined = latest_of(spark, sf).join(master_of(spark, sf).select("code", "list_status"), "code", "left")
    return joined.select("code", day(), F.when(F.col("t").isNull(), "missing_turnover").when(F.col("list_status").isNull(), "missing_status").alias("reason"))


@query("res_excluded_counts", f"with {S.LATEST}, {MASTER}, x as (select case when l.t is null then 'missing_turnover' when m.list_status is null then 'missing_status' end reason from latest l left join master m on m.code = l.code) select coalesce(reason, 'kept') reason, count(*) n from x group by 1")
def res_excluded_counts(spark, sf):
    return prj_case_exclusion(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# joins


@query("join_latest_bar", f"with {S.BARS}, {MASTER} select m.code, b.c close_mills from master m left join (select code, arg_max(c, d) c from bars group by code) b on b.code = m.code")
def join_latest_bar(spark, sf):
    last = bars_of(spark, sf).groupBy("code").agg(F.max_by("c", "d").alias("close_mills"))
    return master_of(spark, sf).select("code").join(last, "code", "left")


@query("join_close_on_or_before", f"""with {S.BARS}, x as (select code, trade_date::date d from (select distinct {S.CODE} code, available_at::date trade_date from security_master_versions where code is not null)),
j as (select x.code, x.d, max(b.d) bd from x left join bars b on b.code = x.code and b.d <= x.d group by all) select j.code, j.d::varchar as_of_day, b.c close_mills from j left join bars b on b.code = j.code and b.d = j.bd""")
def join_close_on_or_before(spark, sf):
    """As-of join of master snapshot days with the last close on or before them."""
    days = table(spark, sf, "security_master_versions").select(clean_code("code").alias("code"), F.col("available_at").cast("date").alias("d")).distinct()
    out = pit.as_of_join(days, bars_of(spark, sf).select("code", "d", "c"), "code", "d", ["c"])
    return out.select("code", day("d", "as_of_day"), F.col("asof_c").alias("close_mills"))


@query("join_sector_interval", f"with {SECTOR_ON} select code, d::varchar trade_date, sector_code from sect")
def join_sector_interval(spark, sf):
    members = pit.memberships(table(spark, sf, "stock_sector_membership"))
    return pit.pick_member(pit.member_on(members, bars_of(spark, sf).select("code", "d"))).select("code", day(), "sector_code")


@query("join_active_membership", f"with {MEMBERS} select code, sector_code, valid_from::varchar valid_from from members where valid_from <= date '{CUT}' and (valid_to is null or valid_to >= date '{CUT}')")
def join_active_membership(spark, sf):
    d = F.lit(CUT).cast("date")
    return pit.memberships(table(spark, sf, "stock_sector_membership")).where((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))).select("code", "sector_code", day("valid_from", "valid_from"))


def _seven(spark, sf):
    bars = bars_of(spark, sf)
    market = bars.withColumn("pc", F.lag("c").over(B.by_code())).groupBy("d").agg(F.count(F.when(F.col("c") > F.col("pc"), 1)).alias("up"), F.count(F.when(F.col("c") < F.col("pc"), 1)).alias("down"), F.sum("a").alias("market_amount"))
    members = pit.memberships(table(spark, sf, "stock_sector_membership"))
    sector = pit.pick_member(pit.member_on(members, bars.select("code", "d"))).select("code", "d", "sector_code")
    industry = bars.join(sector, ["code", "d"]).groupBy("d", "sector_code").agg(F.sum("a").alias("sector_amount"))
    joined = bars.join(sector, ["code", "d"], "left").join(master_of(spark, sf).select("code", "list_status", "exchange"), "code", "left")
    return joined.join(industry, ["d", "sector_code"], "left").join(market, "d", "left")


_SEVEN = f"""{SECTOR_ON}, {MASTER}, market as (select d, count(*) filter (c > pc) up, count(*) filter (c < pc) down, sum(a)::bigint market_amount from (select *, lag(c) over (partition by code order by d) pc from bars) group by d),
industry as (select d, sector_code, sum(a)::bigint sector_amount from sect group by 1, 2), ds as (select b.*, s.sector_code, m.list_status, m.exchange, i.sector_amount, k.up, k.down, k.market_amount from bars b
left join sect s on s.code = b.code and s.d = b.d left join master m on m.code = b.code left join industry i on i.d = b.d and i.sector_code = s.sector_code left join market k on k.d = b.d)"""


@query("join_research_7way", f"with {_SEVEN} select code, d::varchar trade_date, c, sector_code, list_status, exchange, sector_amount, up, down, market_amount from ds")
def join_research_7way(spark, sf):
    return _seven(spark, sf).select("code", day(), "c", "sector_code", "list_status", "exchange", "sector_amount", "up", "down", "market_amount")


@query("res_dataset", f"with {_SEVEN} select sector_code, d::varchar trade_date, count(*) n, sum(c)::bigint c, max(up) up from ds where sector_code is not null and list_status = 'L' group by 1, 2")
def res_dataset(spark, sf):
    kept = _seven(spark, sf).where("sector_code is not null and list_status = 'L'")
    return kept.groupBy("sector_code", day()).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.max("up").alias("up"))


_KEYS = f"{S.CODE} code, lower(trim(horizon)) horizon"


def _sides(spark, sf):
    rows = table(spark, sf, "analysis_decision_candidates").select(clean_code("code").alias("code"), clean_word("horizon").alias("horizon"), "base_source")
    return rows.where("base_source = 'scan_ranker'").select("code", "horizon").distinct(), rows.where("base_source = 'pattern_shadow'").select("code", "horizon").distinct()


_SIDES = f"s as (select distinct {_KEYS} from analysis_decision_candidates where base_source = 'scan_ranker'), p as (select distinct {_KEYS} from analysis_decision_candidates where base_source = 'pattern_shadow')"


@query("join_full_outer_candidates", f"with {_SIDES} select coalesce(s.code, p.code) code, coalesce(s.horizon, p.horizon) horizon, case when s.code is not null and p.code is not null then 'combined' when s.code is not null then 'scan_ranker' else 'pattern_shadow' end side from s full join p on s.code = p.code and s.horizon = p.horizon")
def join_full_outer_candidates(spark, sf):
    s, p = _sides(spark, sf)
    j = s.withColumn("in_s", F.lit(True)).join(p.withColumn("in_p", F.lit(True)), ["code", "horizon"], "full_outer")
    return j.select("code", "horizon", F.when(F.col("in_s") & F.col("in_p"), "combined").when(F.col("in_s"), "scan_ranker").otherwise("pattern_shadow").alias("side"))


@query("set_union_distinct", f"with {_SIDES} select code, horizon from s union select code, horizon from p")
def set_union_distinct(spark, sf):
    s, p = _sides(spark, sf)
    return s.union(p).distinct()


@query("set_intersect", f"with {_SIDES} select code, horizon from s intersect select code, horizon from p")
def set_intersect(spark, sf):
    s, p = _sides(spark, sf)
    return s.intersect(p)


@query("set_difference", f"with {_SIDES} select code, horizon from s except select code, horizon from p")
def set_difference(spark, sf):
    s, p = _sides(spark, sf)
    return s.subtract(p)


@query("join_universe_union", f"select {S.CODE} code from stock_daily_bar_versions union select {S.CODE} from security_master_versions")
def join_universe_union(spark, sf):
    a, b = (table(spark, sf, t).select(clean_code("code").alias("code")) for t in ("stock_daily_bar_versions", "security_master_versions"))
    return a.distinct().join(b.distinct(), "code", "full_outer")


@query("join_semi_in", f"with {S.BARS} select code, c from bars where d in (select distinct d from bars order by d desc limit 3)")
def join_semi_in(spark, sf):
    b = bars_of(spark, sf)
    return b.join(b.select("d").distinct().orderBy(F.desc("d")).limit(3), "d", "left_semi").select("code", "c")


@query("join_anti_not_exists", f"""with {S.LATEST}, {MASTER}, dates as (select distinct d from latest) select max(d)::varchar ready from dates where not exists
(select 1 from master m where m.list_status = 'L' and m.list_date <= dates.d and (m.delist_date is null or m.delist_date > dates.d) and (select count(*) from latest l where l.code = m.code and l.d = dates.d and l.c > 0) = 0) """)
def join_anti_not_exists(spark, sf):
    """The newest date on which no listed stock lacks a bar: listed codes a date are counted from their listing days, not paired."""
    good = latest_of(spark, sf).where("c > 0").select("code", "d")
    listed = master_of(spark, sf).where("list_status = 'L' and list_date is not null").select("code", "list_date", "delist_date")
    have = good.join(listed, "code").where("list_date <= d and (delist_date is null or delist_date > d)").groupBy("d").agg(F.count(F.lit(1)).alias("have"))
    dates = latest_of(spark, sf).select("d").distinct()
    steps = listed.select(F.explode(F.array_compact(F.array(F.struct(F.col("list_date").alias("d"), F.lit(1).alias("s")), F.when(F.col("delist_date").isNotNull(), F.struct(F.greatest("delist_date", "list_date").alias("d"), F.lit(-1).alias("s")))))).alias("x")).select("x.d", "x.s")
    daily = steps.groupBy("d").agg(F.sum("s").alias("s")).unionByName(dates.withColumn("s", F.lit(0).cast("bigint"))).groupBy("d").agg(F.sum("s").alias("s"))
    line = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    due = daily.withColumn("due", F.sum("s").over(line)).join(dates, "d", "left_semi")
    ready = due.join(have, "d", "left").where(F.coalesce("have", F.lit(0)) >= F.col("due"))
    return ready.agg(F.max("d").cast("string").alias("ready"))


QUERIES["chip_prereq_ready_date"] = QUERIES["join_anti_not_exists"]
ORACLES["chip_prereq_ready_date"] = ORACLES["join_anti_not_exists"]


@query("join_exists", f"with {S.BARS}, {MASTER} select code from master m where exists (select 1 from bars b where b.code = m.code and b.d >= date '{CUT}')")
def join_exists(spark, sf):
    return master_of(spark, sf).join(bars_of(spark, sf).where(F.col("d") >= F.lit(CUT).cast("date")), "code", "left_semi").select("code")


@query("join_lateral_current_master", f"with {S.BARS}, {MASTER} select b.code, b.d::varchar trade_date, m.exchange from bars b join master m on m.code = b.code and m.list_status = 'L'")
def join_lateral_current_master(spark, sf):
    return bars_of(spark, sf).join(master_of(spark, sf).where("list_status = 'L'").select("code", "exchange"), "code").select("code", day(), "exchange")


@query("join_cross_anchor", f"with {S.BARS}, m as (select max(d) top from bars) select code, d::varchar trade_date, c from bars, m where d > top - 10")
def join_cross_anchor(spark, sf):
    """Rows relative to the newest date; the anchor is one row."""
    b = bars_of(spark, sf)
    return b.crossJoin(F.broadcast(b.agg(F.max("d").alias("top")))).where("d > date_sub(top, 10)").select("code", day(), "c")


@query("join_cross_series", f"with {S.BARS}, n as (select code, count(*) n from bars group by code), s as (select code, n, unnest(generate_series(0, 23)) i from n), b as (select *, row_number() over (partition by code order by d) - 1 k from bars) select s.code, s.i, b.c from s join b on b.code = s.code and b.k = (s.i * (s.n - 1)) // 23")
def join_cross_series(spark, sf):
    """Twenty-four evenly spaced bars of every code."""
    b = bars_of(spark, sf)
    counted = b.withColumn("k", F.row_number().over(B.by_code()) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("code")))
    wanted = b.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"), "n").withColumn("k", F.expr("cast((i * (n - 1)) div 23 as int)"))
    return wanted.join(counted.select("code", "k", "c"), ["code", "k"]).select("code", F.col("i").cast("bigint").alias("i"), "c")


QUERIES["win_position_count"] = QUERIES["join_cross_series"]
ORACLES["win_position_count"] = ORACLES["join_cross_series"]


@query("join_unnest", f"with {S.BARS}, p as (select unnest([date '2024-03-01', date '2024-04-01', date '2024-05-06']) d) select code, bars.d::varchar trade_date, c from bars join p on p.d = bars.d")
def join_unnest(spark, sf):
    days = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("date") for x in ("2024-03-01", "2024-04-01", "2024-05-06")))).alias("d"))
    return bars_of(spark, sf).join(F.broadcast(days), "d").select("code", day(), "c")


@query("join_name_lookup", f"""with {MASTER}, a as (select distinct {S.CODE} code from analysis_decision_candidates), s as (select split_part(code, '.', 1) short, min(trim(name)) nm from master group by 1)
select a.code, coalesce(trim(m.name), s.nm, a.code) as name from a left join master m on m.code = a.code left join s on s.short = split_part(a.code, '.', 1)""")
def join_name_lookup(spark, sf):
    """Exact code, else short code, else the code itself."""
    m = master_of(spark, sf).select("code", F.trim("name").alias("n1"))
    short = m.groupBy(F.split_part("code", F.lit("."), F.lit(1)).alias("short")).agg(F.min("n1").alias("n2"))
    asked = table(spark, sf, "analysis_decision_candidates").select(clean_code("code").alias("code")).distinct().withColumn("short", F.split_part("code", F.lit("."), F.lit(1)))
    return asked.join(m, "code", "left").join(short, "short", "left").select("code", F.coalesce("n1", "n2", "code").alias("name"))


# aggregations


@query("agg_market_overview", f"with {S.BARS}, x as (select *, lag(c) over (partition by code order by d) pc from bars) select d::varchar trade_date, count(*) filter (c > o) up, count(*) filter (c < o) down, count(*) filter (pc > 0 and (c - pc) * 1000 >= pc * 98) limit_up, sum(a)::bigint amount from x group by d")
def agg_market_overview(spark, sf):
    x = bars_of(spark, sf).withColumn("pc", F.lag("c").over(B.by_code()))
    return x.groupBy(day()).agg(F.count_if(F.col("c") > F.col("o")).alias("up"), F.count_if(F.col("c") < F.col("o")).alias("down"), F.count_if(F.coalesce((F.col("c") - F.col("pc")) * 1000 >= F.col("pc") * 98, F.lit(False))).alias("limit_up"), F.sum("a").alias("amount"))


@query("agg_breadth", f"""with {S.FEATURES} select d::varchar trade_date, count(*) filter (c > pc) up, count(*) filter (c < pc) down, count(*) filter (c = pc) flat, count(*) filter (c > ma20) above_ma20,
count(*) filter (rn >= 20 and h > hi19) new_high_20, count(*) filter (rn >= 20 and l < lo19) new_low_20, sum(a)::bigint total_amount
from (select *, max(h) over (partition by code order by d rows between 19 preceding and 1 preceding) hi19, min(l) over (partition by code order by d rows between 19 preceding and 1 preceding) lo19 from f) group by d""")
def agg_breadth(spark, sf):
    f = B.features(bars_of(spark, sf)).withColumn("hi19", F.max("h").over(B.prev_n(19))).withColumn("lo19", F.min("l").over(B.prev_n(19)))
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    return f.groupBy(day()).agg(n("c > pc", "up"), n("c < pc", "down"), n("c = pc", "flat"), n("c > ma20", "above_ma20"), n("rn >= 20 and h > hi19", "new_high_20"), n("rn >= 20 and l < lo19", "new_low_20"), F.sum("a").alias("total_amount"))


@query("agg_strong_limit_up", f"with {S.BARS}, x as (select *, lag(c) over (partition by code order by d) pc from bars), m as (select max(d) top from bars) select code, count(*) n, max(d)::varchar latest from x, m where d >= top - 59 and (c - pc) * 100 >= 4 * pc group by code having count(*) >= 2")
def agg_strong_limit_up(spark, sf):
    x = bars_of(spark, sf).withColumn("pc", F.lag("c").over(B.by_code()))
    top = x.agg(F.max("d").alias("top"))
    near = x.crossJoin(F.broadcast(top)).where("d >= date_sub(top, 59) and (c - pc) * 100 >= 4 * pc")
    return near.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("d").cast("string").alias("latest")).where("n >= 2")


@query("agg_startup_watchlist", f"with {S.FEATURES}, m as (select max(d) top from bars), s as (select code, d, c from f, m where d > top - 30 and rn >= 30 and (v > av10 * 1.5 and ma5 > ma10 and c > ma5 and c > o)) select code, max(d)::varchar trade_date, max(c) c from s group by code having count(*) = 1")
def agg_startup_watchlist(spark, sf):
    f = B.features(bars_of(spark, sf)).where("rn >= 30 and v > av10 * 1.5 and ma5 > ma10 and c > ma5 and c > o").select("code", "d", "c")
    top = bars_of(spark, sf).agg(F.max("d").alias("top"))
    s = f.crossJoin(F.broadcast(top)).where("d > date_sub(top, 30)")
    return s.groupBy("code").agg(F.max("d").cast("string").alias("trade_date"), F.max("c").alias("c"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("agg_hot_sectors", f"""with {SECTOR_ON}, p as (select s.*, lag(c) over (partition by code order by d) pc from sect s), sd as (select sector_code, d, sum((c - pc) * 1000000 // pc)::bigint chg from p where pc is not null group by 1, 2),
k as (select *, dense_rank() over (order by d desc) r from sd) select sector_code, sum(chg)::bigint change_ppm, count(*) filter (chg > 0) up_days, count(*) total_days from k where r <= 10 group by 1 order by change_ppm desc, sector_code limit 15""")
def agg_hot_sectors(spark, sf):
    members = pit.memberships(table(spark, sf, "stock_sector_membership"))
    sect = pit.pick_member(pit.member_on(members, bars_of(spark, sf).select("code", "d", "c")))
    p = sect.withColumn("pc", F.lag("c").over(B.by_code())).where("pc is not null")
    sd = p.groupBy("sector_code", "d").agg(F.sum(F.floor((F.col("c") - F.col("pc")) * 1000000 / F.col("pc"))).alias("chg"))
    dates = sd.select("d").distinct().orderBy(F.desc("d")).limit(10)
    out = sd.join(dates, "d", "left_semi").groupBy("sector_code").agg(F.sum("chg").alias("change_ppm"), F.count_if(F.col("chg") > 0).alias("up_days"), F.count(F.lit(1)).alias("total_days"))
    return out.orderBy(F.desc("change_ppm"), "sector_code").limit(15)


ORACLES["agg_hot_sectors"] = ORACLES["agg_hot_sectors"].replace("(c - pc) * 1000000 // pc", "floor((c - pc) * 1000000 / pc)::bigint")


@query("agg_index_pivot", f"with {S.BARS} select d::varchar trade_date, max(c) filter (code like '%.SH') sh, max(c) filter (code like '%.SZ') sz, max(c) filter (code like '%.BJ') bj from bars group by d")
def agg_index_pivot(spark, sf):
    b = bars_of(spark, sf).withColumn("ex", F.lower(F.right("code", F.lit(2))))
    return b.groupBy(day()).pivot("ex", ["sh", "sz", "bj"]).agg(F.max("c"))


@query("agg_percentile_linear", f"with {S.BARS} select code, {S.r4('quantile_cont(c::double, 0.9)')} p90, {S.r4('quantile_cont(c::double, 0.5)')} p50 from bars group by code")
def agg_percentile_linear(spark, sf):
    return bars_of(spark, sf).groupBy("code").agg(r4(F.percentile("c", 0.9)).alias("p90"), r4(F.percentile("c", 0.5)).alias("p50"))


@query("agg_vol_stats", f"with {S.BARS}, x as (select code, t, abs(c - lag(c) over w) * 1000000 // lag(c) over w r from bars window w as (partition by code order by d)) select code, {S.r4('(sum(t) / count(t))')} avg_turnover, {S.r4('(sum(r) / count(r))')} avg_abs_return from x group by code having count(r) >= 24")
def agg_vol_stats(spark, sf):
    x = bars_of(spark, sf).withColumn("pc", F.lag("c").over(B.by_code())).withColumn("r", F.expr("abs(c - pc) * 1000000 div pc"))
    return x.groupBy("code").agg(r4(F.sum("t") / F.count("t")).alias("avg_turnover"), r4(F.sum("r") / F.count("r")).alias("avg_abs_return"), F.count("r").alias("n")).where("n >= 24").drop("n")


@query("agg_latest_run", "select run_id, count(*) n from analysis_decision_candidates where run_id = (select run_id from analysis_decision_candidates group by 1 order by max(created_at) desc, run_id desc limit 1) group by 1")
def agg_latest_run(spark, sf):
    rows = table(spark, sf, "analysis_decision_candidates")
    newest = rows.groupBy("run_id").agg(F.max("created_at").alias("t")).orderBy(F.desc("t"), F.desc("run_id")).limit(1)
    return rows.join(newest, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_scan_run_backfill", "select run_id, epoch_us(min(created_at)) first_us, epoch_us(max(created_at)) last_us, count(*) n from analysis_decision_candidates group by 1")
def agg_scan_run_backfill(spark, sf):
    return table(spark, sf, "analysis_decision_candidates").groupBy("run_id").agg(pit.at_us(F.min("created_at")).alias("first_us"), pit.at_us(F.max("created_at")).alias("last_us"), F.count(F.lit(1)).alias("n"))


@query("agg_top_share", "with g as (select source_id, count(*) n from market_event_evidence group by 1) select max(n) top, sum(n)::bigint total, max(n) / sum(n) share from g")
def agg_top_share(spark, sf):
    g = table(spark, sf, "market_event_evidence").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.max("n").alias("top"), F.sum("n").alias("total")).withColumn("share", F.col("top") / F.col("total"))


@query("agg_profit_factor", f"with {S.BARS}, x as (select code, c - lag(c) over (partition by code order by d) p from bars) select code, case when sum(least(p, 0)) < 0 then {S.r4('(sum(greatest(p, 0)) / -sum(least(p, 0)))')} else sum(greatest(p, 0))::double end profit_factor from x where p is not null group by code")
def agg_profit_factor(spark, sf):
    x = bars_of(spark, sf).withColumn("p", F.col("c") - F.lag("c").over(B.by_code())).where("p is not null")
    won, lost = F.sum(F.greatest("p", F.lit(0))), F.sum(F.least("p", F.lit(0)))
    return x.groupBy("code").agg(won.alias("w"), lost.alias("s")).select("code", F.when(F.col("s") < 0, r4(F.col("w") / -F.when(F.col("s") < 0, F.col("s")))).otherwise(F.col("w").cast("double")).alias("profit_factor"))


