"""Shared SQL of the oracles: the same relations the operators work on, as common table expressions for DuckDB."""

from __future__ import annotations

CODE = "upper(trim(code))"


def whole(c: str, unit: int) -> str:
    return f"floor({c} * {unit}::double + 0.5::double)::bigint"


LATEST = f"""latest as (select {CODE} code, trade_date d, {whole('open', 1000)} o, {whole('high', 1000)} h, {whole('low', 1000)} l, {whole('close', 1000)} c, volume v, {whole('amount', 100)} a,
{whole('turnover', 10000)} t, {whole('pe', 100)} pe, {whole('pb', 100)} pb from (select *, row_number() over (partition by {CODE}, trade_date order by available_at desc, ingested_at desc, source) rn
from stock_daily_bar_versions) where rn = 1)"""
BARS = f"""{LATEST}, bars as (select code, d, o, h, l, c, v, coalesce(a, 0) a, t, pe, pb from latest where o > 0 and h > 0 and l > 0 and c > 0 and v > 0)"""


def _prev(fn: str, n: int) -> str:
    return f"{fn} over (partition by code order by d rows between {n} preceding and 1 preceding)"


def _last(fn: str, n: int) -> str:
    return f"{fn} over (partition by code order by d rows between {n - 1} preceding and current row)"


def sma(c: str, n: int) -> str:
    return f"case when {_last(f'count({c})', n)} = {n} then {_last(f'sum({c})', n)} / {n} end"


def prev_mean(c: str, n: int) -> str:
    return f"case when {_prev(f'count({c})', n)} = {n} then {_prev(f'sum({c})', n)} / {n} else 0 end"


_UP, _DOWN = _last("sum(greatest(c - pc, 0))", 14), _last("sum(greatest(pc - c, 0))", 14)
_W = "over (partition by code order by d)"
FEATURES = f"""{BARS}, f1 as (select *, row_number() {_W} rn, lag(c) {_W} pc, lag(c, 2) {_W} ppc, lag(o) {_W} po, lag(h) {_W} ph, lag(l) {_W} pl from bars),
f2 as (select *, {', '.join(f'{sma("c", n)} ma{n}' for n in (5, 10, 20, 25, 50, 60))}, {', '.join(f'{prev_mean("v", n)} av{n}' for n in (5, 10, 15, 20))}, {prev_mean('a', 20)} aa20,
{', '.join(f'{_prev("max(h)", n)} hi{n}' for n in (10, 15, 20, 60))}, {', '.join(f'{_prev("min(l)", n)} lo{n}' for n in (10, 15, 20, 59, 60))},
{_last('sum(case when c >= o then v else 0 end)', 5)} upv5, {_last('sum(v)', 5)} v5, {_prev('min(c)', 4)} minc4,
{_last('sum(case when c > o and (c - o) * 1000 < o * 25 then 1 else 0 end)', 3)} small3, {_last('sum(case when c > o then 1 else 0 end)', 3)} bull3,
case when rn > 14 then case when {_DOWN} = 0 then 100.0 else 100.0 - 100.0 / (1.0 + {_UP} / nullif({_DOWN}, 0)) end end::double rsi14,
case when rn >= 20 then (20 * {_last('sum(c * rn)', 20)} - {_last('sum(c)', 20)} * {_last('sum(rn)', 20)}) / 13300.0::double end slope20 from f1),
f as (select *, lag(ma20) {_W} ma20p, {_last('sum(case when c > ma5 and ma5 > ma10 then 1 else 0 end)', 5)} bull_days, {_last('min(rsi14)', 5)} minrsi5, (c / pc - 1) * 100 gain,
case when h > l then (c - l) / (h - l) else 0.5::double end cp from f2)"""


def r6(x: str) -> str:
    """Half-away rounding to six places, as expr.round6."""
    return f"(sign({x}) * floor(abs({x}) * 1000000::double + 0.5::double) / 1000000::double)"


def r4(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 10000::double + 0.5::double) / 10000::double)"
