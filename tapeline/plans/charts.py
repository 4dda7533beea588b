"""Queries of chart numerics, archetypes and evidence chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.operators import bars as B
from tapeline.operators import charts as C
from tapeline.plans import sql as S
from tapeline.plans.market import day, r4
from tapeline.plans.signals import bars_of

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("chart_zigzag", None)
def chart_zigzag(spark, sf):
    return C.zigzag(bars_of(spark, sf)).select("code", day(), "kind", "price")


@query("chart_segments", None)
def chart_segments(spark, sf):
    """Swings between turning points, with their change in percent."""
    line = Window.partitionBy("code").orderBy("d")
    z = C.zigzag(bars_of(spark, sf)).withColumn("to_day", F.lead("d").over(line)).withColumn("to_price", F.lead("price").over(line)).where("to_day is not null")
    return z.select("code", day("d", "from_day"), day("to_day", "to_day"), r4((F.col("to_price") / F.col("price") - 1) * 100).alias("change"))


@query("chart_main_trend", None)
def chart_main_trend(spark, sf):
    """Of each code's swings the main one, long and near the right edge, with the slope of the closes in it."""
    bars = bars_of(spark, sf).select("code", "d", "c", F.row_number().over(B.by_code()).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("code")).alias("n"))
    points = C.zigzag(bars_of(spark, sf)).select("code", "d").join(bars.select("code", "d", "i", "n"), ["code", "d"])
    swings = points.withColumn("to", F.lead("i").over(B.by_code())).withColumn("to_day", F.lead("d").over(B.by_code())).where("to is not null")
    weight = (F.col("to") - F.col("i")) * (1 + 0.6 * (1 - (F.col("n") - F.col("to")) / F.col("n")))
    best = swings.groupBy("code").agg(F.max(F.struct(weight.alias("w"), "i", "to", "d", "to_day")).alias("s")).select("code", "s.*")
    inside = bars.select("code", "c", F.col("i").alias("k")).join(best, "code").where("k between i and to")
    return inside.groupBy("code", day("d", "from_day"), day("to_day", "to_day")).agg(F.count(F.lit(1)).alias("bars"), r4(F.regr_slope("c", "k")).alias("slope"))


@query("chart_channel_fit", f"""with {S.BARS}, k as (select *, 60 - row_number() over (partition by code order by d desc) x from bars qualify row_number() over (partition by code order by d desc) <= 60),
l as (select code, (count(*) * sum(x * c) - sum(x) * sum(c)) / (count(*) * sum(x * x) - sum(x) * sum(x)) slope, sum(c) sc, sum(x) sx, count(*) n from k group by code having count(*) >= 2), m as (select code, slope, (sc - slope * sx) / n intercept from l)
select code, {S.r4('max(slope)')} slope, {S.r4('max(intercept)')} intercept, {S.r4('quantile_cont(c - slope * x - intercept, 0.1)')} below, {S.r4('quantile_cont(c - slope * x - intercept, 0.9)')} above from k join m using (code) group by code""")
def chart_channel_fit(spark, sf):
    return C.channel(bars_of(spark, sf)).select("code", *(r4(F.col(x)).alias(x) for x in ("slope", "intercept", "below", "above")))


@query("chart_quantile", f"with {S.BARS} select code, {S.r4('quantile_cont(v::double, 0.25)')} q25, {S.r4('quantile_cont(v::double, 0.75)')} q75 from bars group by code")
def chart_quantile(spark, sf):
    return bars_of(spark, sf).groupBy("code").agg(r4(F.percentile("v", 0.25)).alias("q25"), r4(F.percentile("v", 0.75)).alias("q75"))


@query("chart_range_boxes", f"with {S.BARS}, x as (select code, d, {S._last('max(h)', 20)} hi, {S._last('min(l)', 20)} lo, {S._last('count(c)', 20)} n from bars) select code, d::varchar trade_date, hi, lo from x where n = 20 and (hi - lo) * 100 <= 8 * lo")
def chart_range_boxes(spark, sf):
    """Twenty-bar boxes no higher than 8 %."""
    from tapeline.operators.bars import last_n

    w = last_n(20)
    x = bars_of(spark, sf).select("code", "d", F.max("h").over(w).alias("hi"), F.min("l").over(w).alias("lo"), F.count("c").over(w).alias("n"))
    return x.where("n = 20 and (hi - lo) * 100 <= 8 * lo").select("code", day(), "hi", "lo")


@query("chip_js_profile", f"""with {S.BARS}, r as (select *, row_number() over (partition by code order by d desc) - 1 age from bars qualify row_number() over (partition by code order by d desc) <= 120), s as (select code, min(l) lo, greatest(max(h) - min(l), 1) width from r group by code),
t as (select r.code, least(floor((l - lo) * 40 / width), 39)::bigint b0, least(floor((h - lo) * 40 / width), 39)::bigint b1, v * greatest(1 - age * 0.02::double, 0.1::double) m from r join s using (code))
select code, b bucket, {S.r4('sum(m / (b1 - b0 + 1))')} weight from (select code, b0, b1, m, unnest(generate_series(b0, b1)) b from t) group by 1, 2""")
def chip_js_profile(spark, sf):
    return C.cost_profile(bars_of(spark, sf)).select("code", "bucket", r4(F.col("weight")).alias("weight"))


