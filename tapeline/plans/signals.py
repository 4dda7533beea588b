"""Queries of the detectors and the trailing windows over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.expr import round_half
from tapeline.functions import detectors
from tapeline.operators import bars as B
from tapeline.plans import sql as S
from tapeline.sources.tables import table

QUERIES, ORACLES = {}, {}


def bars_of(spark, sf):
    return B.usable_bars(table(spark, sf, "stock_daily_bar_versions"))


def day():
    return F.col("d").cast("string").alias("trade_date")


def r4(c):
    return round_half(c, 4)


def _detector(name):
    def run(spark, sf):
        return B.features(bars_of(spark, sf)).where(F.expr(f"rn >= {detectors.SCAN_BARS} and {detectors.condition(name)}")).select("code", day(), F.col("c").alias("close_mills"), F.col("rn").cast("bigint").alias("n_bars"))

    return run


for _name in detectors.DETECTORS:
    QUERIES[_name] = _detector(_name)
    ORACLES[_name] = f"with {S.FEATURES} select code, d::varchar trade_date, c close_mills, rn n_bars from f where rn >= {detectors.SCAN_BARS} and {detectors.condition(_name)}"


def _hits(spark, sf):
    return detectors.hits(B.features(bars_of(spark, sf)))


_HITS = f"""{S.FEATURES}, hits as ({' union all '.join(f"select code, d, '{n}' signal_id from f where rn >= {detectors.SCAN_BARS} and {detectors.condition(n)}" for n in detectors.DETECTORS)})"""


def multi_signal(spark, sf):
    return detectors.multi_signal(_hits(spark, sf)).select("code", day(), "n_signals")


QUERIES["multi_signal"] = multi_signal
QUERIES["agg_count_distinct_multi"] = multi_signal
ORACLES["multi_signal"] = ORACLES["agg_count_distinct_multi"] = f"with {_HITS} select code, d::varchar trade_date, count(distinct signal_id) n_signals from hits group by code, d having count(distinct signal_id) >= 3"


def scan_summary(spark, sf):
    found = _hits(spark, sf)
    return found.groupBy(day()).agg(F.countDistinct("code").alias("n_codes"), F.count(F.lit(1)).alias("n_hits"), F.countDistinct("signal_id").alias("n_signals"))


QUERIES["agg_dashboard_summary"] = QUERIES["agg_archive_counts"] = scan_summary
ORACLES["agg_dashboard_summary"] = ORACLES["agg_archive_counts"] = f"with {_HITS} select d::varchar trade_date, count(distinct code) n_codes, count(*) n_hits, count(distinct signal_id) n_signals from hits group by d"

HORIZONS = (1, 3, 5, 10, 20)


def forward_returns(spark, sf):
    """Closes of the k-th next bars beside each hit: leads in the feature frame's own window, so one scan and no join."""
    frame = B.features(bars_of(spark, sf))
    ahead = frame.select("*", *(F.lead("c", k).over(B.by_code()).alias(f"close_{k}d") for k in HORIZONS))
    return detectors.hits(ahead, carried=["c", *(f"close_{k}d" for k in HORIZONS)])


_FORWARD = f"""{_HITS}, ahead as (select code, d, c, {', '.join(f'lead(c, {k}) over (partition by code order by d) close_{k}d' for k in HORIZONS)} from bars), fwd as (select * from hits join ahead using (code, d))"""


def join_forward_returns(spark, sf):
    return forward_returns(spark, sf).select("signal_id", "code", day(), F.col("c").alias("entry"), *(f"close_{k}d" for k in HORIZONS))


QUERIES["join_forward_returns"] = join_forward_returns
ORACLES["join_forward_returns"] = f"with {_FORWARD} select signal_id, code, d::varchar trade_date, c entry, {', '.join(f'close_{k}d' for k in HORIZONS)} from fwd"


def agg_signal_performance(spark, sf):
    """Samples, average return and win rate per signal and horizon; unpivoted, so one aggregation serves all horizons."""
    pairs = F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"close_{k}d").alias("x")) for k in HORIZONS))
    rows = forward_returns(spark, sf).select("signal_id", "c", F.explode(pairs).alias("p")).where("p.x is not null")
    ret = F.floor((F.col("p.x") / F.col("c") - 1) * 1e6 + 0.5)
    out = rows.withColumn("r", ret).groupBy("signal_id", F.col("p.k").alias("horizon")).agg(F.count(F.lit(1)).alias("samples"), F.sum("r").alias("s"), F.sum(F.when(F.col("p.x") > F.col("c"), 1).otherwise(0)).alias("w"))
    return out.select("signal_id", "horizon", "samples", (F.col("s") / F.col("samples")).alias("avg_return_ppm"), (F.col("w") * 100 / F.col("samples")).alias("win_rate"))


QUERIES["agg_signal_performance"] = agg_signal_performance
ORACLES["agg_signal_performance"] = f"""with {_FORWARD}, u as ({' union all '.join(f'select signal_id, c, {k}::bigint k, close_{k}d x from fwd' for k in HORIZONS)}),
r as (select signal_id, k, floor((x / c - 1) * 1e6::double + 0.5::double)::bigint r, x > c w from u where x is not null)
select signal_id, k horizon, count(*) samples, sum(r) / count(*) avg_return_ppm, count(*) filter (w) * 100 / count(*) win_rate from r group by signal_id, k"""


def _window(name, column, expression):
    """A query that shows one trailing window on every bar, with its SQL."""

    def run(spark, sf):
        return B.features(bars_of(spark, sf)).select("code", day(), column().alias("x"))

    QUERIES[name] = run
    ORACLES[name] = f"with {S.FEATURES} select code, d::varchar trade_date, {expression} x from f"


_window("win_sma_n", lambda: r4(F.col("ma20")), S.r4("ma20"))
_window("win_ema_quirk", lambda: r4(F.col("ma10")), S.r4("ma10"))
_window("win_avg_volume_n", lambda: r4(F.col("av20")), S.r4("av20"))
_window("win_prev_high", lambda: F.col("hi20"), "hi20")
_window("win_prev_low", lambda: F.col("lo60"), "lo60")
_window("win_linreg_slope20", lambda: r4(F.col("slope20")), S.r4("slope20"))
_window("win_rsi_simple_14", lambda: r4(F.col("rsi14")), S.r4("rsi14"))
_window("win_lag_prev_close", lambda: F.col("pc"), "pc")


def _simple(name, spark_column, sql_column, keep="1 = 1"):
    """A query of one expression over bars with windows of its own."""

    def run(spark, sf):
        return bars_of(spark, sf).withColumn("rn", F.row_number().over(B.by_code())).withColumn("pc", F.lag("c").over(B.by_code())).select("code", day(), spark_column().alias("x")).where("x is not null")

    QUERIES[name] = run
    ORACLES[name] = f"with {S.BARS}, b as (select *, row_number() over (partition by code order by d) rn, lag(c) over (partition by code order by d) pc from bars) select * from (select code, d::varchar trade_date, {sql_column} x from b) where x is not null and {keep}"


_simple("win_partial_avg", lambda: r4(F.sum("v").over(B.last_n(20)) / F.count("v").over(B.last_n(20))), S.r4(f"({S._last('sum(v)', 20)} / {S._last('count(v)', 20)})"))
_up, _down = S._last("sum(greatest(c - pc, 0))", 14), S._last("sum(greatest(pc - c, 0))", 14)


def _rsi_pattern():
    up, down = B.gains(14)
    return F.when(F.col("rn") > 14, F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(r4(100.0 - 100.0 / (1.0 + up / F.when(down != 0, down)))))


_simple("win_rsi_pattern", _rsi_pattern, f"case when rn > 14 then case when {_up} = 0 and {_down} = 0 then 50.0 when {_down} = 0 then 100.0 else {S.r4(f'(100.0 - 100.0 / (1.0 + {_up} / nullif({_down}, 0)))')} end end::double")


def _variance():
    n = F.count("c").over(B.last_n(20))
    s, q = F.sum("c").over(B.last_n(20)), F.sum(F.col("c") * F.col("c")).over(B.last_n(20))
    return F.when(n == 20, F.floor(s / 20 + 2 * F.sqrt((20 * q - s * s) / 400.0) + 0.5))


_simple("win_boll", _variance, f"case when {S._last('count(c)', 20)} = 20 then floor({S._last('sum(c)', 20)} / 20 + 2 * sqrt((20 * {S._last('sum(c * c)', 20)} - {S._last('sum(c)', 20)} * {S._last('sum(c)', 20)}) / 400.0::double) + 0.5::double)::bigint end")
_simple("win_atr", lambda: r4(F.sum(F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.coalesce("pc", "c")), F.abs(F.col("l") - F.coalesce("pc", "c")))).over(B.last_n(14)) / F.count("c").over(B.last_n(14))), S.r4(f"({S._last('sum(greatest(h - l, abs(h - coalesce(pc, c)), abs(l - coalesce(pc, c))))', 14)} / {S._last('count(c)', 14)})"))


def win_cross_signal(spark, sf):
    f = B.features(bars_of(spark, sf)).withColumn("p5", F.lag("ma5").over(B.by_code())).withColumn("p10", F.lag("ma10").over(B.by_code()))
    kind = F.when((F.col("p5") <= F.col("p10")) & (F.col("ma5") > F.col("ma10")), "golden").when((F.col("p5") >= F.col("p10")) & (F.col("ma5") < F.col("ma10")), "death")
    return f.select("code", day(), kind.alias("cross")).where("cross is not null")


QUERIES["win_cross_signal"] = win_cross_signal
ORACLES["win_cross_signal"] = f"""with {S.FEATURES}, g as (select *, lag(ma5) over (partition by code order by d) p5, lag(ma10) over (partition by code order by d) p10 from f),
k as (select code, d::varchar trade_date, case when p5 <= p10 and ma5 > ma10 then 'golden' when p5 >= p10 and ma5 < ma10 then 'death' end as "cross" from g) select * from k where "cross" is not null"""


def _resampled(name, unit, valuation):
    def run(spark, sf):
        return B.resample(bars_of(spark, sf), unit, valuation).select("code", day(), "o", "h", "l", "c", "v", "a", "t", "pe", "pb")

    rule = {"last": "arg_max_null({0}, d)", "present": "arg_max({0}, d) filter ({0} is not null)", "none": "null::bigint"}[valuation]
    QUERIES[name] = run
    ORACLES[name] = f"""with {S.BARS} select code, max(d)::varchar trade_date, arg_min(o, d) o, max(h) h, min(l) l, arg_max(c, d) c, sum(v)::bigint v, sum(a)::bigint a,
{', '.join(f'{rule.format(x)} {x}' for x in ('t', 'pe', 'pb'))} from bars group by code, date_trunc('{unit}', d)"""


_resampled("agg_monthly_ohlcv", "month", "last")
_resampled("agg_weekly_ohlcv", "week", "present")
_resampled("agg_resample_iso", "week", "last")
_resampled("agg_resample_chart", "month", "none")


def win_first_last(spark, sf):
    """Gain over the last five bars' dates, the twenty best: first and last by min_by/max_by instead of two row numbers."""
    b = bars_of(spark, sf)
    recent = b.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.col("d").desc()))).where("k <= 5")
    g = recent.groupBy("code").agg(F.min_by("o", "d").alias("first_open"), F.max_by("c", "d").alias("last_close"))
    return g.withColumn("gain", r4((F.col("last_close") / F.col("first_open") - 1) * 100)).orderBy(F.desc("gain"), "code").limit(20)


QUERIES["win_first_last"] = win_first_last
ORACLES["win_first_last"] = f"""with {S.BARS}, k as (select *, row_number() over (partition by code order by d desc) k from bars), g as (select code, arg_min(o, d) first_open, arg_max(c, d) last_close from k where k <= 5 group by code)
select code, first_open, last_close, {S.r4('((last_close / first_open - 1) * 100)')} gain from g order by gain desc, code limit 20"""
