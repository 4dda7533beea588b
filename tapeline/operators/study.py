"""Research steps over bars: labels, matched controls, validation of a signal, documents for export.

Returns are kept as whole millionths, so sums of them and of their squares are exact in any order of addition.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import clean_code, clean_word
from tapeline.operators.bars import by_code, last_n

#: Trading days of a horizon, and the horizons whose models may be published.
HORIZONS = {"week": 5, "month": 20, "quarter": 60, "year": 250}
PUBLISHABLE = ("week", "month")
#: Greatest share of one code and of one date among what a released signal selects.
CONCENTRATION = 0.35


def with_gain(bars: DataFrame) -> DataFrame:
    """``bars`` with ``g``, the change of the close since the bar before in millionths; null on a code's first bar."""
    return bars.withColumn("g", F.floor((F.col("c") / F.lag("c").over(by_code()) - 1) * 1e6 + 0.5))


def _spread(n: int) -> tuple[Column, Column]:
    w, g = last_n(n), F.col("g").cast("decimal(38,0)")
    count, total = F.count("g").over(w), F.sum(g).over(w)
    return count, (count * F.sum(g * g).over(w) - total * total).cast("double")


def variance(n: int) -> Column:
    """Population variance of the last n returns; null if there are fewer."""
    count, spread = _spread(n)
    return F.when(count == n, spread / float(n * n))


def deviation(n: int) -> Column:
    """Population deviation of the last n returns, of as many as there are; 0 if there are none."""
    count, spread = _spread(n)
    return F.coalesce(F.sqrt(F.greatest(spread / F.when(count > 0, count * count), F.lit(0.0))), F.lit(0.0))


def market_gain(bars: DataFrame) -> DataFrame:
    """(d, m): the mean return of a date's codes, in millionths."""
    return with_gain(bars).where("g is not null").groupBy("d").agg((F.sum("g") / F.count("g")).cast("double").alias("m"))


def _percentile(c: str) -> Column:
    n, k = F.count(F.lit(1)).over(Window.partitionBy("d")), F.row_number().over(Window.partitionBy("d").orderBy(c, "code"))
    return F.when(n == 1, 100.0).otherwise(F.lit(100.0) * (k - 1) / F.greatest(n - 1, F.lit(1)))


def labels(bars: DataFrame, market: DataFrame, horizon: int) -> DataFrame:
    """What came of each bar in the next ``horizon`` bars of its code; bars with fewer of them have no row.

    ``r`` return, ``mex`` excess over the compounded market (ten-thousandths), ``iex`` excess over the mean of the date's
    sector, ``dd`` deepest fall, ``fe`` highest rise (all but mex in millionths), ``strength`` the mean of their five
    percentiles among the date's codes, ``pos``: tradable, with return and both excesses above 0 and a strength of 90 or
    more. ``bars`` has code, d, c, l, h, a and sector_code; a null sector is a sector of its own.
    """
    line, nxt = by_code(), by_code().rowsBetween(1, horizon)
    x = bars.join(market, "d", "left").select(
        "code", "d", "c", F.col("a").alias("amt"), "sector_code", F.lead("c", horizon).over(line).alias("cf"), F.min("l").over(nxt).alias("lf"), F.max("h").over(nxt).alias("hf"),
        F.sum(F.log(1 + F.col("m") / 1000000)).over(nxt).alias("lm"),
    ).where("cf is not null")
    change = lambda c: F.floor((F.col(c) / F.col("c") - 1) * 1e6)
    x = x.select("*", change("cf").alias("r"), F.floor((F.col("cf") / F.col("c") - F.exp("lm")) * 10000.0).alias("mex"), F.least(change("lf"), F.lit(0)).alias("dd"), F.greatest(change("hf"), F.lit(0)).alias("fe"))
    sector = Window.partitionBy("d", "sector_code")
    x = x.withColumn("iex", F.col("r") - F.sum("r").over(sector) / F.count("r").over(sector))
    parts = [_percentile(c) for c in ("r", "mex", "iex", "dd", "fe")]
    x = x.withColumn("strength", (parts[0] + parts[1] + parts[2] + parts[3] + parts[4]) / 5)
    return x.withColumn("pos", F.expr("amt > 0 and r > 0 and mex > 0 and iex > 0 and strength >= 90"))


def controls(labelled: DataFrame, bars: DataFrame, buckets: int = 5) -> DataFrame:
    """(code, d, kind, control, dist): for each positive the nearest control of each kind, ties by code.

    A control is no positive, of the same date and sector, and in the same of ``buckets`` buckets by market value, price,
    amount and volatility, which divide a date's distinct values evenly. Kinds: a failed breakout fell though it had
    risen, a negative excess stayed behind the market, the rest are ordinary. The distance (in millionths) sums the four
    relative differences. Positives meet the controls of their own fine block only, and of them the nearest is kept by an
    aggregate that combines on the map side.
    """
    value = F.when(F.col("t") > 0, F.col("a") * 1e6 / F.when(F.col("t") > 0, F.col("t"))).otherwise(0.0)
    held = with_gain(bars).select("code", "d", value.alias("cap"), (F.sum("a").over(last_n(20)) / F.count("a").over(last_n(20))).alias("am"), deviation(20).alias("vo"))
    x, measures = labelled.join(held, ["code", "d"]), ("cap", "c", "am", "vo")
    for m in measures:
        x = x.withColumn(f"k_{m}", F.dense_rank().over(Window.partitionBy("d").orderBy(m)) - 1)
    for m in measures:
        n = F.max(f"k_{m}").over(Window.partitionBy("d")) + 1
        x = x.withColumn(f"b_{m}", F.least(F.lit(buckets - 1), F.floor(F.col(f"k_{m}") * buckets / n)))
    kind = F.when(F.expr("r <= 0 and fe > 0"), "failed_breakout").when(F.col("mex") < 0, "negative_excess").otherwise("ordinary")
    x = x.select("code", "d", "sector_code", (F.col("amt") > 0).alias("tradable"), "pos", kind.alias("kind"), *measures, *(f"b_{m}" for m in measures))
    block = ["d", "sector_code", "tradable", *(f"b_{m}" for m in measures)]
    p = x.where("pos").select(*block, F.col("code").alias("own"), *(F.col(m).alias(f"p_{m}") for m in measures))
    n = x.where("not pos").select(*block, F.col("code").alias("control"), "kind", *measures)
    apart = [F.abs(F.col(f"p_{m}") - F.col(m)) / F.greatest(F.abs(f"p_{m}"), F.abs(m), F.lit(1e-9)) for m in measures]
    met = p.join(n, block).where("own <> control").withColumn("dist", F.floor((apart[0] + apart[1] + apart[2] + apart[3]) * 1e6))
    best = met.groupBy(F.col("own").alias("code"), "d", "kind").agg(F.min(F.struct("dist", "control")).alias("b"))
    return best.select("code", "d", "kind", "b.control", "b.dist")


def ranked_pools(candidates: DataFrame) -> DataFrame:
    """(code, d, score): the best score of a code and date among the candidates of the three ranked horizons."""
    pools = candidates.where(clean_word("horizon").isin("short", "mid", "long"))
    return pools.groupBy(clean_code("code").alias("code"), F.col("trade_date").alias("d")).agg(F.max("final_score").alias("score"))


def longest_losing_run(days: Iterable[tuple[int, int, int, int]]) -> int:
    """From (rows, longest run, leading run, trailing run) of dates in order: the longest run across dates."""
    longest = carried = 0
    for n, most, leading, trailing in days:
        longest = max(longest, most, carried + leading)
        carried = carried + n if leading == n else trailing
    return longest


def _losing_runs(picked: DataFrame) -> int:
    """The longest run of returns not above zero in order of (date, code): runs inside dates, then over the calendar."""
    line = Window.partitionBy("d").orderBy("code")
    x = picked.withColumn("lost", F.col("r") <= 0).withColumn("k", F.row_number().over(line)).withColumn("won", F.sum(F.when(F.col("lost"), 0).otherwise(1)).over(line))
    runs = x.groupBy("d", "won").agg(F.count_if("lost").alias("run"))
    days = runs.groupBy("d").agg(F.max("run").alias("most"), F.max(F.when(F.col("won") == 0, F.col("run"))).alias("leading"), F.max_by("run", "won").alias("trailing"))
    counts = picked.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    rows = days.join(counts, "d").orderBy("d").select("n", "most", F.coalesce("leading", F.lit(0)), "trailing").collect()
    return longest_losing_run([tuple(r) for r in rows])


def _turnover(rows: DataFrame) -> float:
    """Mean over dates of how much the selected set changes since the date before (Jaccard distance; 1 on the first, if any)."""
    dates = rows.groupBy("d").agg(F.count_if("signal").alias("n")).withColumn("i", F.row_number().over(Window.orderBy("d")))  # one row a date
    picked = rows.where("signal").select("d", "code").distinct().join(F.broadcast(dates.select("d", "i")), "d").select("i", "code")
    both = picked.join(picked.select((F.col("i") + 1).alias("i"), "code"), ["i", "code"]).groupBy("i").agg(F.count(F.lit(1)).alias("both"))
    x = dates.join(both, "i", "left").withColumn("before", F.lag("n").over(Window.orderBy("i"))).withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("n") + F.col("before") - F.col("both")
    change = F.when(F.col("before").isNull(), F.when(F.col("n") > 0, 1.0).otherwise(0.0)).when(union == 0, 0.0).otherwise(1 - F.col("both") / F.when(union > 0, union))
    return x.agg(F.avg(change)).first()[0] or 0.0


def validation(rows: DataFrame, cost_bps: float = 0.0, best_baseline: float = 0.0) -> DataFrame:
    """(metric, value) of a signal over labelled rows (code, d, r, mex, dd, amt, pos, signal, score, split).

    The gate (``release``: 1 or 0) asks for a lift above 1 in most splits, a return after costs above the best baseline's,
    and no code or date with over 35 % of what is selected. Returns are in units. No rows, no metrics.
    """
    part = lambda c: F.count_if(F.expr(c))
    won, lost = F.sum(F.expr("case when signal and r > 0 then r end")), F.sum(F.expr("case when signal and r < 0 then -r end"))
    a = rows.agg(
        F.count(F.lit(1)).alias("n"), part("pos").alias("pos"), part("signal").alias("picked"), part("signal and pos").alias("hits"), F.avg(F.expr("case when signal then r end")).alias("ret"), F.min(F.expr("case when signal then dd end")).alias("dd"),
        F.avg(F.expr("case when signal then mex end")).alias("mean_excess"), F.median(F.expr("case when signal then mex end")).alias("median_excess"), F.median(F.expr("case when signal then amt end")).alias("amount"),
        part("signal and r > 0").alias("wins"), won.alias("won"), lost.alias("lost"), F.min("score").alias("low"), F.max("score").alias("high"),
    ).first()
    spark = rows.sparkSession
    if not a.n:
        return spark.createDataFrame([], "metric string, value double")
    of = lambda x, y: (x or 0) / y if y else 0.0
    picked = rows.where("signal").select("code", "d", "r")
    top = lambda c: of(picked.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0], a.picked)
    at = lambda k: rows.orderBy(F.desc("score"), "d", "code").limit(k).agg(F.avg(F.col("pos").cast("int"))).first()[0]
    scaled = F.lit(0.5) if a.high == a.low else (F.col("score") - a.low) / (a.high - a.low)
    bins = rows.groupBy(F.least(F.floor(scaled * 5), F.lit(4)).alias("bin")).agg(F.sum(scaled).alias("said"), part("pos").alias("pos")).agg(F.sum(F.abs(F.col("said") - F.col("pos"))))
    lifts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), part("pos").alias("pos"), part("signal").alias("picked"), part("signal and pos").alias("hits")).collect()
    lift = lambda r: of(of(r.hits, r.picked), of(r.pos, r.n))
    turnover = _turnover(rows)
    found = {
        "positive_sample_count": a.pos, "control_sample_count": a.n - a.pos, "effective_sample_count": a.picked, "base_rate": of(a.pos, a.n), "precision": of(a.hits, a.picked), "lift": lift(a), "coverage": of(a.picked, a.n),
        "false_positive_rate": of(a.picked - a.hits, a.n - a.pos), "precision_at_10": at(10), "precision_at_50": at(50), "cost_adjusted_return": (a.ret or 0) / 1e6 - turnover * cost_bps / 10_000, "max_drawdown": (a.dd or 0) / 1e6,
        "turnover": turnover, "top_stock_contribution": top("code"), "top_period_contribution": top("d"), "mean_excess_return": (a.mean_excess or 0) / 1e4, "median_excess_return": (a.median_excess or 0) / 1e4, "win_rate": of(a.wins, a.picked),
        "profit_factor": of(a.won, a.lost) if a.lost else (a.won or 0) / 1e6, "max_losing_streak": _losing_runs(picked), "capacity_estimate": (a.amount or 0) * 0.01, "calibration_error": of(bins.first()[0], a.n),
        "windows_with_lift": of(sum(lift(r) > 1 for r in lifts), len(lifts)),
    }
    found["release"] = found["windows_with_lift"] > 0.5 and found["cost_adjusted_return"] > best_baseline and found["top_stock_contribution"] <= CONCENTRATION and found["top_period_contribution"] <= CONCENTRATION
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


def payloads(ledger: Sequence[dict], horizons: Sequence[str]) -> list[str]:
    """A JSON document for each horizon that may be published: what a ledger accepted and what it rejected, keys in order."""
    good, bad = ([row for row in ledger if (row["status"] == "accepted") == wanted] for wanted in (True, False))
    return [json.dumps({"horizon": h, "days": HORIZONS[h], "archetypes": good, "rejections": bad}, sort_keys=True) for h in horizons if h in PUBLISHABLE]
