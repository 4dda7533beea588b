"""Queries of pattern features, research labels and validation, cost-basis distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, round_half
from tapeline.functions.conditions import compile_condition
from tapeline.functions.pattern_features import compile_feature, relative_strength
from tapeline.operators import bars as B
from tapeline.operators import chips as C
from tapeline.operators import pit
from tapeline.plans import sql as S
from tapeline.plans.market import MASTER, SECTOR_ON, day, master_of, query, r4
from tapeline.plans.market import ORACLES as _MARKET_ORACLES
from tapeline.plans.market import QUERIES as _MARKET_QUERIES
from tapeline.plans.signals import bars_of
from tapeline.sources.tables import table

_BEFORE = set(_MARKET_QUERIES)
W = "over (partition by code order by d)"

# pattern features


def _feature(name, sql):
    @query(f"pat_feat_{name}", f"with {S.BARS}, b as (select *, lag(c) {W} pc, row_number() {W} rn from bars) select * from (select code, d::varchar trade_date, {S.r4(sql)} x from b) where x is not null")
    def run(spark, sf):
        rows = bars_of(spark, sf).withColumn("pc", F.lag("c").over(B.by_code()))
        return rows.select("code", "d", compile_feature(name)).select("code", day(), r4(F.col(name)).alias("x")).where("x is not null")


def _all(n, x):
    return f"(case when {S._last('count(c)', n)} = {n} then {x} end)"


for _n in (5, 20, 60):
    _feature(f"return_{_n}d", f"(c / lag(c, {_n}) {W} - 1)")
_feature("breakout_5d", f"(c / lag(c, 5) {W} - 1)")
_feature("reversal_5d", f"(c / lag(c, 5) {W} - 1)")
_feature("price_vs_ma50", f"(c / ({S.sma('c', 50)}) - 1)")
_feature("ma20_vs_ma50", f"(({S.sma('c', 20)}) / ({S.sma('c', 50)}) - 1)")
_feature("consolidation_range_20d", _all(20, f"({S._last('max(h)', 20)} - {S._last('min(l)', 20)}) / c"))
_feature("consolidation_range_60d", _all(60, f"({S._last('max(h)', 60)} - {S._last('min(l)', 60)}) / c"))
_feature("volume_ratio_20d", _all(20, f"v / ({S._last('sum(v)', 20)} / 20)"))
_feature("distance_from_20d_low", _all(20, f"(c / {S._last('min(l)', 20)} - 1)"))
_u, _d = S._last("sum(greatest(c - pc, 0))", 14), S._last("sum(greatest(pc - c, 0))", 14)
_feature("rsi_14", f"(case when rn > 14 then case when {_u} = 0 and {_d} = 0 then 50.0::double when {_d} = 0 then 100.0::double else 100.0::double - 100.0::double / (1.0::double + {_u} / nullif({_d}, 0)) end end)")


@query("pat_feature_parser", None)
def pat_feature_parser(spark, sf):
    """Names compiled to features; what is not supported is said."""
    names = ["return_20d", "rsi_14", "volume_ratio_20d", "wave_count", "return_0d", "price_vs_ma50"]
    return spark.createDataFrame([(n, compile_feature(n) is not None) for n in names], "name string, supported boolean")


_RS = f"{S.BARS}, o as (select code, d, c / lag(c, 20) {W} own from bars), rs as (select code, d, own, median(own) over (partition by d) mid from o where own is not null)"


def _strength(spark, sf):
    own, mid = relative_strength(20)
    return bars_of(spark, sf).withColumn("own", own).where("own is not null").withColumn("mid", mid)


@query("pat_feat_relative_strength_20d", f"with {_RS} select code, d::varchar trade_date, {S.r4('(own / mid)')} rs from rs")
def pat_feat_relative_strength(spark, sf):
    return _strength(spark, sf).select("code", day(), r4(F.col("own") / F.col("mid")).alias("rs"))


_FAM = f"""{_RS}, b as (select *, lag(c) {W} pc, row_number() {W} rn from bars), ff as (select code, d, c / lag(c, 5) {W} - 1 r5, c / lag(c, 20) {W} - 1 r20, c / lag(c, 60) {W} - 1 r60, c / ({S.sma('c', 50)}) - 1 pm50, ({S.sma('c', 20)}) / ({S.sma('c', 50)}) - 1 mm,
{_all(20, f"({S._last('max(h)', 20)} - {S._last('min(l)', 20)}) / c")} rg20, {_all(60, f"({S._last('max(h)', 60)} - {S._last('min(l)', 60)}) / c")} rg60, {_all(20, f"v / ({S._last('sum(v)', 20)} / 20)")} vr, {_all(20, f"(c / {S._last('min(l)', 20)} - 1)")} dl,
case when rn > 14 then case when {_u} = 0 and {_d} = 0 then 50.0::double when {_d} = 0 then 100.0::double else 100.0::double - 100.0::double / (1.0::double + {_u} / nullif({_d}, 0)) end end rsi from b)"""
# Thresholds of the three pattern families.
FAMILIES = {
    "trend": "r20 >= 0.10 and r60 >= 0.18 and pm50 > 0 and mm > 0 and rs >= 1.10",
    "vcp": "rg20 <= 0.18 and rg20 <= 0.70 * rg60 and vr >= 1.2 and r5 >= 0.03 and rs >= 1.05",
    "oversold": "r20 <= -0.08 and dl <= 0.08 and rsi <= 40 and vr >= 1.0 and r5 >= 0.02",
}
_NAMES = {"r5": "return_5d", "r20": "return_20d", "r60": "return_60d", "pm50": "price_vs_ma50", "mm": "ma20_vs_ma50", "rg20": "consolidation_range_20d", "rg60": "consolidation_range_60d", "vr": "volume_ratio_20d", "dl": "distance_from_20d_low", "rsi": "rsi_14"}


def _family(name):
    @query(f"flt_family_{name}", f"with {_FAM} select code, d::varchar trade_date from (select ff.*, own / mid rs from ff left join rs using (code, d)) where {FAMILIES[name]}")
    def run(spark, sf):
        own, mid = relative_strength(20)
        rows = bars_of(spark, sf).withColumn("pc", F.lag("c").over(B.by_code()))
        frame = rows.select("code", "d", own.alias("own"), *(compile_feature(n).alias(a) for a, n in _NAMES.items())).withColumn("rs", F.col("own") / mid)
        return frame.where(FAMILIES[name]).select("code", day())


for _name in FAMILIES:
    _family(_name)


@query("flt_condition_json", f"with {S.BARS} select code, d::varchar trade_date, c >= 20000 hit, 'evaluated' status from bars")
def flt_condition_json(spark, sf):
    b = bars_of(spark, sf)
    hit, status = compile_condition('{"column": "c", "operator": "gte", "value": 20000}', b.columns)
    return b.select("code", day(), hit.alias("hit"), F.lit(status).alias("status"))


@query("pat_adjust", f"with {S.BARS}, x as (select *, 1 + (month(d) % 3) factor from bars) select code, d::varchar trade_date, {S.r4('(c * factor / arg_max(factor, d) over (partition by code))')} adjusted from x")
def pat_adjust(spark, sf):
    """Prices at the factor of the date over the factor of the latest date; factors are made from the month here."""
    x = bars_of(spark, sf).withColumn("factor", 1 + F.month("d") % 3)
    last = x.groupBy("code").agg(F.max_by("factor", "d").alias("last"))
    return x.join(last, "code").select("code", day(), r4(F.col("c") * F.col("factor") / F.col("last")).alias("adjusted"))




@query("pat_fingerprint", f"with {S.BARS}, l as (select code, d, code || '|' || d::varchar || '|' || c::varchar || '|' || v::varchar line from bars) select code, sha256(string_agg(line, chr(10) order by d)) fingerprint from l group by code")
def pat_fingerprint(spark, sf):
    line = F.concat_ws("|", "code", F.col("d").cast("string"), F.col("c").cast("string"), F.col("v").cast("string"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("d", line.alias("x")))), lambda s: s["x"])
    return bars_of(spark, sf).groupBy("code").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


# labels and controls

H = 20
_AHEAD = f"{SECTOR_ON}, a as (select code, d, c, a amt, sector_code, lead(c, {H}) {W} cf, min(l) over (partition by code order by d rows between 1 following and {H} following) lf, max(h) over (partition by code order by d rows between 1 following and {H} following) hf from sect), lab as (select *, floor((cf / c - 1) * 1000000::double)::bigint r from a where cf is not null)"


def _labels(spark, sf):
    members = pit.memberships(table(spark, sf, "stock_sector_membership"))
    sect = pit.pick_member(pit.member_on(members, bars_of(spark, sf)))
    nxt = B.by_code().rowsBetween(1, H)
    a = sect.select("code", "d", "c", F.col("a").alias("amt"), "sector_code", F.lead("c", H).over(B.by_code()).alias("cf"), F.min("l").over(nxt).alias("lf"), F.max("h").over(nxt).alias("hf"))
    return a.where("cf is not null").withColumn("r", F.floor((F.col("cf") / F.col("c") - 1) * 1000000.0))


@query("win_forward", f"with {_AHEAD} select code, d::varchar trade_date, r, lf, hf from lab")
def win_forward(spark, sf):
    return _labels(spark, sf).select("code", day(), "r", "lf", "hf")


@query("win_forward_compound", f"with {S.BARS}, x as (select d, count(*) n, sum(c) c from bars group by d), y as (select d, c / n lvl from x), z as (select d, lvl / lag(lvl) over (order by d) g from y) select d::varchar trade_date, {S.r4('(product(g) over (order by d rows between 1 following and 5 following) - 1)')} compound from z qualify count(g) over (order by d rows between 1 following and 5 following) = 5")
def win_forward_compound(spark, sf):
    """Compound change of the market level over the next five dates; one row per date, so the global window is small."""
    level = bars_of(spark, sf).groupBy("d").agg((F.sum("c") / F.count(F.lit(1))).alias("lvl"))
    line = Window.orderBy("d")
    z = level.withColumn("g", F.col("lvl") / F.lag("lvl").over(line))
    nxt = line.rowsBetween(1, 5)
    return z.withColumn("n", F.count("g").over(nxt)).withColumn("x", F.product("g").over(nxt) - 1).where("n = 5").select(day(), r4(F.col("x")).alias("compound"))


@query("win_industry_excess", f"with {_AHEAD} select code, d::varchar trade_date, {S.r4('(r - sum(r) over (partition by d, sector_code) / count(r) over (partition by d, sector_code))')} excess from lab")
def win_industry_excess(spark, sf):
    w = Window.partitionBy("d", "sector_code")
    return _labels(spark, sf).select("code", day(), r4(F.col("r") - F.sum("r").over(w) / F.count("r").over(w)).alias("excess"))


@query("win_cross_sectional_pct", f"with {_AHEAD} select code, d::varchar trade_date, case when count(*) over (partition by d) = 1 then 100.0::double else (row_number() over (partition by d order by r, code) - 1) * 100 / (count(*) over (partition by d) - 1) end pct from lab")
def win_cross_sectional_pct(spark, sf):
    n, k = F.count(F.lit(1)).over(Window.partitionBy("d")), F.row_number().over(Window.partitionBy("d").orderBy("r", "code"))
    return _labels(spark, sf).select("code", day(), F.when(n == 1, 100.0).otherwise((k - 1) * 100 / F.when(n > 1, n - 1)).alias("pct"))


@query("win_rank_percentile", f"with {_AHEAD} select code, d::varchar trade_date, (count(*) over (partition by d) - row_number() over (partition by d order by r desc, code) + 1) * 100 / count(*) over (partition by d) pct from lab")
def win_rank_percentile(spark, sf):
    n, k = F.count(F.lit(1)).over(Window.partitionBy("d")), F.row_number().over(Window.partitionBy("d").orderBy(F.desc("r"), "code"))
    return _labels(spark, sf).select("code", day(), ((n - k + 1) * 100 / n).alias("pct"))


@query("win_top_decile", f"with {_AHEAD} select code, d::varchar trade_date from lab qualify row_number() over (partition by d order by r desc, code) <= greatest(1, ceil(count(*) over (partition by d) * 0.1))")
def win_top_decile(spark, sf):
    n, k = F.count(F.lit(1)).over(Window.partitionBy("d")), F.row_number().over(Window.partitionBy("d").orderBy(F.desc("r"), "code"))
    return _labels(spark, sf).withColumn("n", n).withColumn("k", k).where("k <= greatest(1, ceil(n * 0.1))").select("code", day())


_DENSE = "dense_rank() over (partition by d order by amt) - 1"


@query("win_dense_bucket", f"with {_AHEAD}, k as (select code, d, {_DENSE} k from lab), n as (select *, max(k) over (partition by d) + 1 n from k) select code, d::varchar trade_date, case when n = 1 then 0 else least(4, floor(k * 5 / n))::bigint end bucket from n")
def win_dense_bucket(spark, sf):
    k = F.dense_rank().over(Window.partitionBy("d").orderBy("amt")) - 1
    x = _labels(spark, sf).withColumn("k", k).withColumn("n", F.max("k").over(Window.partitionBy("d")) + 1)
    return x.select("code", day(), F.when(F.col("n") == 1, 0).otherwise(F.least(F.lit(4), F.floor(F.col("k") * 5 / F.col("n")))).cast("bigint").alias("bucket"))


_POS = f"""{_AHEAD}, l2 as (select *, (row_number() over (partition by d order by r, code) - 1) * 100 / greatest(count(*) over (partition by d) - 1, 1) pct, r - sum(r) over (partition by d, sector_code) / count(*) over (partition by d, sector_code) ex from lab),
l3 as (select *, r > 0 and ex > 0 and pct >= 90 pos from l2)"""


def _positive(spark, sf):
    n, k = F.count(F.lit(1)).over(Window.partitionBy("d")), F.row_number().over(Window.partitionBy("d").orderBy("r", "code"))
    w = Window.partitionBy("d", "sector_code")
    x = _labels(spark, sf).withColumn("pct", (k - 1) * 100 / F.greatest(n - 1, F.lit(1))).withColumn("ex", F.col("r") - F.sum("r").over(w) / F.count("r").over(w))
    return x.withColumn("pos", F.expr("r > 0 and ex > 0 and pct >= 90"))




@query("res_precision_at_k", f"with {_POS}, k as (select *, row_number() over (order by amt desc, d, code) k from l3) select count(*) n, count(*) filter (pos) hits from k where k <= 200")
def res_precision_at_k(spark, sf):
    top = _positive(spark, sf).orderBy(F.desc("amt"), "d", "code").limit(200)
    return top.agg(F.count(F.lit(1)).alias("n"), F.count_if("pos").alias("hits"))


_SEL = f"{_POS}, sel as (select *, amt >= median(amt) over (partition by d) s from l3)"


def _selected(spark, sf):
    return _positive(spark, sf).withColumn("s", F.col("amt") >= F.median("amt").over(Window.partitionBy("d")))


def _metrics(df, *keys):
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    g = (df.groupBy(*keys) if keys else df).agg(F.count(F.lit(1)).alias("n"), n("pos", "base"), n("s", "picked"), n("s and pos", "hits"), n("s and not pos", "false_hits"), F.median(F.expr("case when s then amt end")).alias("mid"), F.sum(F.expr("case when s then r end")).alias("ret"), n("s and r > 0", "wins"))
    keep = [F.col(k) for k in keys]
    d = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return g.select(*keep, d("base", "n").alias("base_rate"), d("hits", "picked").alias("precision"), d("picked", "n").alias("coverage"), (F.col("false_hits") / F.when(F.col("n") > F.col("base"), F.col("n") - F.col("base"))).alias("fpr"), (F.col("mid") * 0.01).alias("capacity"), d("ret", "picked").alias("mean_return"), d("wins", "picked").alias("win_rate"))


_METRICS = """count(*) filter (pos) / count(*) base_rate, count(*) filter (s and pos) / nullif(count(*) filter (s), 0) as "precision", count(*) filter (s) / count(*) coverage, count(*) filter (s and not pos) / nullif(count(*) filter (not pos), 0) fpr,
median(amt) filter (s) * 0.01::double capacity, sum(r) filter (s) / nullif(count(*) filter (s), 0) mean_return, count(*) filter (s and r > 0) / nullif(count(*) filter (s), 0) win_rate"""


@query("agg_validation_metrics", f"with {_SEL} select {_METRICS} from sel")
def agg_validation_metrics(spark, sf):
    return _metrics(_selected(spark, sf))


@query("agg_group_results", f"with {_SEL} select d_month as \"month\", {_METRICS} from (select *, strftime(d, '%Y-%m') d_month from sel) group by 1")
def agg_group_results(spark, sf):
    return _metrics(_selected(spark, sf).withColumn("month", F.date_format("d", "yyyy-MM")), "month")


@query("agg_calibration_ece5", f"with {_POS}, m as (select *, min(r) over () a, max(r) over () b from l3), x as (select pos, case when b > a then (r - a) / (b - a) else 0.5::double end p from m), g as (select least(floor(p * 5), 4) k, count(*) n, sum(p) sp, count(*) filter (pos) h from x group by 1) select {S.r4('(sum(abs(sp - h)) / sum(n))')} ece from g")
def agg_calibration_ece5(spark, sf):
    x = _positive(spark, sf)
    ends = x.agg(F.min("r").alias("a"), F.max("r").alias("b"))
    p = F.when(F.col("b") > F.col("a"), (F.col("r") - F.col("a")) / F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a"))).otherwise(0.5)
    g = x.crossJoin(F.broadcast(ends)).withColumn("p", p).groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.count_if("pos").alias("h"))
    return g.agg(r4(F.sum(F.abs(F.col("sp") - F.col("h"))) / F.sum("n")).alias("ece"))


@query("win_losing_streak_max", f"with {_AHEAD}, x as (select code, d, r <= 0 b, row_number() over (partition by code order by d) - row_number() over (partition by code, r <= 0 order by d) g from lab) select code, max(n) streak from (select code, g, count(*) n from x where b group by 1, 2) group by 1")
def win_losing_streak_max(spark, sf):
    """Gaps and islands: the longest run of returns not above zero."""
    x = _labels(spark, sf).withColumn("b", F.col("r") <= 0)
    g = F.row_number().over(B.by_code()) - F.row_number().over(Window.partitionBy("code", "b").orderBy("d"))
    return x.withColumn("g", g).where("b").groupBy("code", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.max("n").alias("streak"))


@query("win_streak", f"with {S.BARS}, x as (select code, d, c - lag(c) {W} p, from bars), y as (select *, row_number() over (partition by code order by d desc) k from x where p is not null) select code, coalesce(min(k) filter (p <= 0), count(*) + 1) - 1 wins, coalesce(min(k) filter (p >= 0), count(*) + 1) - 1 losses from y group by code")
def win_streak(spark, sf):
    """Length of the leading run of rises and of falls, from the newest bar; no change breaks both."""
    x = bars_of(spark, sf).withColumn("p", F.col("c") - F.lag("c").over(B.by_code())).where("p is not null")
    y = x.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d"))).cast("bigint"))
    run = lambda stop: F.coalesce(F.min(F.when(F.expr(stop), F.col("k"))), F.count(F.lit(1)) + 1) - 1
    return y.groupBy("code").agg(run("p <= 0").alias("wins"), run("p >= 0").alias("losses"))


@query("win_max_drawdown", f"with {S.BARS}, x as (select code, c, max(c) over (partition by code order by d rows unbounded preceding) pk from bars) select code, {S.r4('max((pk - c) * 100 / pk)')} drawdown from x group by code")
def win_max_drawdown(spark, sf):
    peak = F.max("c").over(B.by_code().rowsBetween(Window.unboundedPreceding, 0))
    return bars_of(spark, sf).withColumn("pk", peak).groupBy("code").agg(r4(F.max((F.col("pk") - F.col("c")) * 100 / F.col("pk"))).alias("drawdown"))


_TOP = f"{S.BARS}, t as (select d, code from bars qualify row_number() over (partition by d order by a desc, code) <= 20), ds as (select d, lag(d) over (order by d) pd from (select distinct d from t))"


@query("win_turnover_jaccard", f"with {_TOP}, n as (select d, count(*) n from t group by d), c as (select ds.d, count(*) n_both from ds join t a on a.d = ds.d join t b on b.d = ds.pd and b.code = a.code group by 1) select ds.d::varchar trade_date, case when pd is null then 1.0::double else 1 - coalesce(n_both, 0) / (n.n + m.n - coalesce(n_both, 0)) end turnover from ds join n on n.d = ds.d left join n m on m.d = ds.pd left join c on c.d = ds.d")
def win_turnover_jaccard(spark, sf):
    """How much the set of the twenty most traded codes changes from date to date."""
    k = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("a"), "code"))
    sets = bars_of(spark, sf).withColumn("k", k).where("k <= 20").groupBy("d").agg(F.collect_set("code").alias("s"))
    x = sets.withColumn("p", F.lag("s").over(Window.orderBy("d")))  # one row of at most twenty codes per date
    return x.select(day(), F.when(F.col("p").isNull(), 1.0).otherwise(1 - F.size(F.array_intersect("s", "p")) / F.size(F.array_union("s", "p"))).alias("turnover"))


# cost-basis distributions


@query("chip_legacy", None)
def chip_legacy(spark, sf):
    return C.legacy(bars_of(spark, sf))


_CHIP = f"""{S.BARS}, rec as (select *, row_number() over (partition by code order by d desc) k from bars qualify k <= 120), r2 as (select *, coalesce(sum(ln(1 - least(coalesce(t, 0) / 1000000.0::double, 0.95::double))) over (partition by code order by d desc rows between unbounded preceding and 1 preceding), 0) lg from rec),
sp as (select code, min(l) lo, max(h) hi, greatest(max(h) - min(l), 10) s from rec group by code having count(*) >= 10), g0 as (select code, greatest(lo - 0.1::double * s, 10) low, hi + 0.1::double * s up from sp), g as (select code, low, greatest((up - low) / 30, 10) size from g0),
gr as (select r2.*, low, size, b.i bucket, low + (b.i + 0.5::double) * size mid from r2 join g using (code), range(30) b(i)),
ms as (select code, bucket, mid, lg, case when mid >= least(o, c) and mid <= greatest(o, c) then 0.6::double * v / greatest((greatest(o, c) - least(o, c)) / size, 1) when mid >= l and mid < least(o, c) then 0.2::double * v / greatest((least(o, c) - l) / size, 1)
when mid > greatest(o, c) and mid <= h then 0.2::double * v / greatest((h - greatest(o, c)) / size, 1) else 0 end m from gr), w as (select code, bucket, max(mid) price, sum(m * exp(lg)) w from ms group by 1, 2), ch as (select code, bucket, price, w / sum(w) over (partition by code) weight from w)"""
_MARKET_ORACLES["chip_legacy"] = f"with {_CHIP} select code, bucket::int bucket, {S.r6('price')} price, {S.r6('weight')} weight from ch"
_MARKET_QUERIES["chip_legacy"] = lambda spark, sf: C.legacy(bars_of(spark, sf)).select("code", "bucket", round_half(F.col("price"), 6).alias("price"), round_half(F.col("weight"), 6).alias("weight"))


@query("chip_metrics", f"""with {_CHIP}, k as (select ch.*, b.c, row_number() over (partition by ch.code order by round(weight, 9) desc, price) k from ch join (select code, arg_max(c, d) c from bars group by code) b on b.code = ch.code)
select code, {S.r4('sum(price * weight)')} avg_cost, {S.r4('sum(case when price <= c then weight else 0 end)')} winner, {S.r4('sum(case when k <= 5 then weight else 0 end)')} top5 from k group by code""")
def chip_metrics(spark, sf):
    b = bars_of(spark, sf)
    m = C.metrics(C.legacy(b), b.groupBy("code").agg(F.max_by("c", "d").alias("c")))
    return m.select("code", r4(F.col("avg_cost")).alias("avg_cost"), r4(F.col("winner")).alias("winner"), r4(F.col("top5")).alias("top5"))


@query("chip_model_v2", None)
def chip_model_v2(spark, sf):
    return C.model(bars_of(spark, sf))


@query("chip_wasserstein", None)
def chip_wasserstein(spark, sf):
    """Distance of the closed-form and the sequential distribution, over the average cost of the closed form."""
    b = bars_of(spark, sf)
    legacy = C.legacy(b).select("code", "price", "weight")
    cost = legacy.groupBy("code").agg(F.sum(F.col("price") * F.col("weight")).alias("cost"))
    apart = C.wasserstein(legacy, C.model(b).select("code", (F.col("price") * 1000).alias("price"), "weight"))
    return apart.join(cost, "code").select("code", (F.col("w1") / F.col("cost")).alias("w1"))


# sorts, limits, pages


@query("sort_multi_tiebreak", f"with {S.BARS} select code, d::varchar trade_date, a, row_number() over (order by a desc, code, d) place from bars order by place limit 100")
def sort_multi_tiebreak(spark, sf):
    top = bars_of(spark, sf).select("code", day(), "a").orderBy(F.desc("a"), "code", "trade_date").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("a"), "code", "trade_date")).cast("bigint"))


@query("sort_nulls", f"with {S.LATEST} select code, d::varchar trade_date, pe from latest order by pe desc nulls last, code, d limit 50")
def sort_nulls(spark, sf):
    b = B.latest_bars(table(spark, sf, "stock_daily_bar_versions"))
    return b.orderBy(F.desc_nulls_last("pe"), "code", "d").limit(50).select("code", day(), "pe")


@query("topk_global", f"with {S.BARS} select code, d::varchar trade_date, v from bars order by v desc, code, d limit 20")
def topk_global(spark, sf):
    return bars_of(spark, sf).orderBy(F.desc("v"), "code", "d").limit(20).select("code", day(), "v")


@query("topk_per_group", f"with {S.BARS} select code, d::varchar trade_date, v from bars qualify row_number() over (partition by d order by v desc, code) <= 5")
def topk_per_group(spark, sf):
    k = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("v"), "code"))
    return bars_of(spark, sf).withColumn("k", k).where("k <= 5").select("code", day(), "v")


@query("page_keyset", f"with {S.BARS} select code, d::varchar trade_date, a from bars where a < 5000000000 or (a = 5000000000 and code > '6') order by a desc, code, d limit 51")
def page_keyset(spark, sf):
    """A page after a cursor: the tuple comparison spelled out, one row more than the page to know whether it goes on."""
    b = bars_of(spark, sf).where("a < 5000000000 or (a = 5000000000 and code > '6')")
    return b.orderBy(F.desc("a"), "code", "d").limit(51).select("code", day(), "a")


@query("dash_company", f"with {S.BARS}, {MASTER}, q as (select code, arg_max(c, d) c, arg_max(pe, d) filter (pe is not null) pe from bars group by code) select m.code, trim(m.name) as name, m.list_status, q.c, q.pe from master m left join q on q.code = m.code")
def dash_company(spark, sf):
    q = bars_of(spark, sf).groupBy("code").agg(F.max_by("c", "d").alias("c"), F.max_by("pe", F.when(F.col("pe").isNotNull(), F.col("d"))).alias("pe"))
    return master_of(spark, sf).select("code", F.trim("name").alias("name"), "list_status").join(q, "code", "left")


@query("dash_activity_metric", f"with {S.LATEST} select code, case when count(*) filter (v > 0) * 10 >= count(*) * 8 then 'volume' else 'amount' end metric from latest group by code")
def dash_activity_metric(spark, sf):
    b = B.latest_bars(table(spark, sf, "stock_daily_bar_versions"))
    return b.groupBy("code").agg(F.when(F.count(F.when(F.col("v") > 0, 1)) * 10 >= F.count(F.lit(1)) * 8, "volume").otherwise("amount").alias("metric"))


@query("prereq_validate", f"select {S.CODE} code, trade_date::varchar trade_date, count(*) n from stock_daily_bar_versions group by all having count(*) > 1")
def prereq_validate(spark, sf):
    rows = table(spark, sf, "stock_daily_bar_versions").select(clean_code("code").alias("code"), day("trade_date"))
    return rows.groupBy("code", "trade_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("hist_repair_loop", f"with {S.LATEST}, bad as (select distinct d from latest where a > 0 and coalesce(v, 0) <= 0) select l.d::varchar trade_date, count(*) n, count(*) filter (coalesce(v, 0) > 0 or a <= 0) usable from latest l join bad using (d) group by 1")
def hist_repair_loop(spark, sf):
    """Rows on dates that need a refetch, and how many are usable."""
    b = B.latest_bars(table(spark, sf, "stock_daily_bar_versions"))
    bad = b.where("a > 0 and coalesce(v, 0) <= 0").select("d").distinct()
    return b.join(bad, "d", "left_semi").groupBy(day()).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr("coalesce(v, 0) > 0 or a <= 0"), 1)).alias("usable"))


QUERIES = {n: f for n, f in _MARKET_QUERIES.items() if n not in _BEFORE}
ORACLES = {n: s for n, s in _MARKET_ORACLES.items() if n in QUERIES}
