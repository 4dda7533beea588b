"""Queries of the general problems (rolling totals, as-known attributes, histories, late events) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import asknown, history, late, rolling
from tapeline.sources.tables import table

_CODE = "upper(trim(code))"
_BARS = f"""bars as (select {_CODE} code, trade_date d, volume, amount, nullif(close, 0) c from (select *, row_number() over
 (partition by {_CODE}, trade_date order by available_at desc, ingested_at desc, source) rn from stock_daily_bar_versions) where rn = 1)"""
_TOTALS = f"""{_BARS}, span as (select code, min(d) a, max(d) b from bars group by 1),
days as (select code, a, unnest(generate_series(a, b, interval 1 day))::date d from span),
dense as (select days.code, days.a, days.d, volume, amount, c from days left join bars using (code, d)),
tot as (select code, d, a, sum(volume) over w7 v7, sum(volume) over w30 v30, sum(amount) over w7 a7, sum(amount) over w30 a30, avg(c) over w7 c7, avg(c) over w30 c30 from dense
window w7 as (partition by code order by d rows 6 preceding), w30 as (partition by code order by d rows 29 preceding))"""


def p3_found(spark, sf):
    return rolling.unusual_days(rolling.bar_totals(table(spark, sf, "stock_daily_bar_versions")))


P3_FOUND = f"""with {_TOTALS}, late as (select * from tot where d >= a + 29)
select code, d::varchar trade_day, 'volume' measure from late where coalesce(v7, 0) / 7 > 2 * (coalesce(v30, 0) / 30)
union all select code, d::varchar, 'amount' from late where coalesce(a7, 0) / 7 > 2 * (coalesce(a30, 0) / 30)
union all select code, d::varchar, 'close' from late where c7 > 1.12 * c30"""


def p3_totals(spark, sf):
    """All days; amounts in cents and closes in thousandths, as integers, so that sums are exact in any order."""
    daily = rolling.daily_bars(table(spark, sf, "stock_daily_bar_versions"))
    exact = daily.select("code", "trade_date", "volume", F.floor(F.col("amount") * 100 + 0.5).alias("amount"), F.floor(F.col("close") * 1000 + 0.5).alias("close"))
    t = rolling.rolling_totals(exact, "code", "trade_date", ["volume", "amount"], ["close"], (7, 30))
    return t.select("code", F.col("trade_date").cast("string").alias("trade_day"), "volume_sum_7", "volume_sum_30", "amount_sum_7", "amount_sum_30", "close_avg_7", "close_avg_30")


P3_TOTALS = f"""with {_TOTALS} select code, d::varchar trade_day, v7::bigint volume_sum_7, v30::bigint volume_sum_30, a7::bigint amount_sum_7, a30::bigint amount_sum_30, c7 close_avg_7, c30 close_avg_30 from tot"""
P3_TOTALS = P3_TOTALS.replace("volume, amount, nullif(close, 0) c", "volume, floor(amount * 100 + 0.5::double)::bigint amount, floor(nullif(close, 0) * 1000 + 0.5::double)::bigint c")

_STATUS = f"""m as (select {_CODE} code, available_at ta, ingested_at i, source s, list_status v from security_master_versions),
s as (select {_CODE} code, sector_code sc, valid_from vf, valid_to vt, available_at ta from stock_sector_membership where sector_type = 'industry'),
snow as (select * from (select *, row_number() over (partition by code, sc, vf order by ta desc, vt desc nulls first) rn from s) where rn = 1)"""


def _known(spark, sf):
    return asknown.bars_as_known(table(spark, sf, "stock_daily_bar_versions"), table(spark, sf, "security_master_versions"), table(spark, sf, "stock_sector_membership"))


def p5_found(spark, sf):
    return asknown.changed_since(_known(spark, sf), ["status", "sector"])


def p5_known(spark, sf):
    k = _known(spark, sf)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return k.select(F.col("entity").alias("code"), F.col("day").cast("string").alias("trade_date"), F.col("at_us").alias("available_us"), *map(blank, ("status_then", "status_now", "sector_then", "sector_now")))


_KNOWN = f"""with {_STATUS}, ev as (select distinct {_CODE} code, trade_date d, available_at t from stock_daily_bar_versions),
st as (select code, t, arg_min(v, (-epoch_us(ta), -epoch_us(i), s)) v from (select distinct code, t from ev) join m using (code) where ta <= t group by 1, 2),
sn as (select code, arg_min(v, (-epoch_us(ta), -epoch_us(i), s)) v from m group by 1),
ver as (select code, t, sc, vf, max(ta) ta from (select distinct code, t from ev) join s using (code) where ta <= t group by all),
vers as (select ver.*, s.vt from ver join s using (code, sc, vf, ta)),
rt as (select *, row_number() over (partition by code, d, t order by ta desc, vf desc, vt desc nulls last, sc) rn from ev join vers using (code, t) where vf <= d and d <= coalesce(vt, date '9999-12-31')),
dn as (select distinct code, d from ev),
rn as (select *, row_number() over (partition by code, d order by ta desc, vf desc, vt desc nulls last, sc) r from dn join (select code, sc, vf, vt, ta from snow) using (code) where vf <= d and d <= coalesce(vt, date '9999-12-31')),
k as (select ev.code, ev.d::varchar trade_date, epoch_us(ev.t) available_us, coalesce(st.v, '') status_then, coalesce(sn.v, '') status_now, coalesce(rt.sc, '') sector_then, coalesce(rn.sc, '') sector_now
from ev left join st on st.code = ev.code and st.t = ev.t left join sn on sn.code = ev.code left join rt on rt.code = ev.code and rt.d = ev.d and rt.t = ev.t and rt.rn = 1
left join rn on rn.code = ev.code and rn.d = ev.d and rn.r = 1)"""
P5_KNOWN = f"{_KNOWN} select * from k"
P5_FOUND = f"""{_KNOWN} select code, trade_date, available_us, 'status' attribute, status_then as value from k where status_then <> status_now
union all select code, trade_date, available_us, 'sector', sector_then from k where sector_then <> sector_now"""


def p6_found(spark, sf):
    return history.attribute_history(table(spark, sf, "security_master_versions"), table(spark, sf, "stock_sector_membership"))


P6_FOUND = f"""with l0 as (select {_CODE} code, available_at ta, trim(name) || '|' || list_status v, row_number() over (partition by {_CODE}, available_at order by ingested_at desc, source) rn from security_master_versions),
l1 as (select code, ta, v, lag(v) over (partition by code order by ta) p from l0 where rn = 1),
l2 as (select code, ta, v, lead(ta) over (partition by code order by ta) nx from l1 where p is null or p <> v),
{_STATUS}, live as (select *, coalesce(vt, date '9999-12-31') e from snow where vf <= coalesce(vt, date '9999-12-31')),
cut as (select distinct code, c from (select code, vf c from live union all select code, e + 1 from live)),
seg as (select code, c a, lead(c) over (partition by code order by c) - 1 b from cut),
win as (select code, a, b, sc from (select seg.code, a, b, sc, row_number() over (partition by seg.code, a order by ta desc, vf desc, vt desc nulls last, sc) r from seg join live on live.code = seg.code and vf <= a and b <= e where b is not null) where r = 1),
mark as (select *, case when lag(sc) over w = sc and lag(b) over w = a - 1 then 0 else 1 end f from win window w as (partition by code order by a)),
grp as (select *, sum(f) over (partition by code order by a) g from mark)
select code, 'listing' attribute, v as value, strftime(ta at time zone 'UTC', '%Y-%m-%d %H:%M:%S') period_from, coalesce(strftime(nx at time zone 'UTC', '%Y-%m-%d %H:%M:%S'), '') period_to from l2
union all select code, 'sector', sc, min(a)::varchar, case when max(b) >= date '9999-12-31' then '' else max(b)::varchar end from grp group by code, sc, g"""


def _outcomes(spark, sf):
    """Every delivery is a counter state of its record; all of them are merged."""
    rows = table(spark, sf, "market_event_evidence").select("evidence_id", "source_id", "published_at", "first_seen_at")
    return late.outcomes(late.merge(late.registers(rows)))


def p7_found(spark, sf):
    return _outcomes(spark, sf).where("outcome <> 'on_time'").select("evidence_id", "period_day", "outcome")


def p7_counts(spark, sf):
    return late.period_totals(_outcomes(spark, sf))


_LATE = """with a as (select evidence_id, min(first_seen_at) t, arg_min(published_at, first_seen_at) p, arg_min(source_id, first_seen_at) source_id from market_event_evidence group by 1),
b as (select evidence_id, source_id, t, ((p at time zone 'UTC') + interval 8 hour)::date d from a where p is not null),
c as (select evidence_id, source_id, d::varchar period_day, epoch_us(t at time zone 'UTC') - (epoch_us(d::timestamp) + 16 * 3600000000) lag from b),
o as (select evidence_id, source_id, period_day, case when lag < 0 then 'on_time' when lag < 72 * 3600000000 then 'corrected' else 'dropped' end outcome from c)"""
P7_FOUND = f"{_LATE} select evidence_id, period_day, outcome from o where outcome <> 'on_time'"
P7_COUNTS = f"""{_LATE} select source_id, period_day, count(*) filter (outcome = 'on_time') n_on_time, count(*) filter (outcome = 'corrected') n_corrected, count(*) filter (outcome = 'dropped') n_dropped,
count(*) filter (outcome <> 'dropped') n_final from o group by all"""

QUERIES = {"p3_found": p3_found, "p3_totals": p3_totals, "p5_found": p5_found, "p5_known": p5_known, "p6_found": p6_found, "p7_found": p7_found, "p7_counts": p7_counts}
ORACLES = {"p3_found": P3_FOUND, "p3_totals": P3_TOTALS, "p5_found": P5_FOUND, "p5_known": P5_KNOWN, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_counts": P7_COUNTS}
