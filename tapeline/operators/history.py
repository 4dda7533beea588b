"""Full history of changing attributes, from periodic snapshots and updates.

Method: presence bitmaps. The snapshots of an entity are numbered; for every attribute value one bit per snapshot says
whether it held then. Runs of consecutive bits are the validity intervals; where no value holds no bit is set, so gaps
need no treatment of their own. Bitmaps are kept as 63-bit words (entity, value, word), built by ``bit_or`` with
map-side combine; run edges come from shifting each word against its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.expr import BLANKS, clean_code, micros
from tapeline.operators.asknown import NEVER, sector_log
from tapeline.scratch import Scratch

WORD = 63
DAY_US = 86_400_000_000
_OPEN = 2_932_896


def presence_words(presence: DataFrame) -> DataFrame:
    """(entity, value, idx) to bitmap words (entity, value, word, bits). Repeated rows set the same bit."""
    bit = F.expr(f"shiftleft(1L, cast(idx % {WORD} as int))")
    word = F.floor(F.col("idx") / F.lit(WORD)).cast("bigint")
    return presence.select("entity", "value", word.alias("word"), bit.alias("bit")).groupBy("entity", "value", "word").agg(F.bit_or("bit").alias("bits"))


def runs(presence: DataFrame) -> DataFrame:
    """Maximal runs of consecutive set bits: (entity, value, first_idx, last_idx). Empty in, empty out."""
    line = Window.partitionBy("entity", "value").orderBy("word")
    touching = lambda step, fn: F.when(fn("word").over(line) == F.col("word") + step, fn("bits").over(line)).otherwise(F.lit(0))
    words = presence_words(presence).withColumn("before", touching(-1, F.lag)).withColumn("after", touching(1, F.lead))
    top = WORD - 1
    begins = F.expr(f"bits & ~((shiftleft(bits, 1) | shiftrightunsigned(before, {top})))")
    finishes = F.expr(f"bits & ~(shiftrightunsigned(bits, 1) | shiftleft(after & 1L, {top}))")
    positions = F.sequence(F.lit(0), F.lit(top))
    at = lambda bits: F.filter(positions, lambda i: F.expr("1L") == 1 if bits is None else F.getbit(bits, i) == 1)
    edges = words.withColumn("b", begins).withColumn("f", finishes).where("b != 0 or f != 0")
    mark = lambda bits, kind: F.transform(at(F.col(bits)), lambda i: F.struct((F.col("word") * WORD + i).alias("idx"), F.lit(kind).alias("kind")))
    marks = edges.select("entity", "value", F.explode(F.concat(mark("b", 0), mark("f", 1))).alias("m")).select("entity", "value", "m.idx", "m.kind")
    # a run's first and last bit alternate in order of (idx, kind)
    order = Window.partitionBy("entity", "value").orderBy("idx", "kind")
    paired = marks.withColumn("last_idx", F.lead("idx").over(order)).where("kind = 0")
    return paired.select("entity", "value", F.col("idx").alias("first_idx"), "last_idx")


def numbered(moments: DataFrame, bucket_us: int = 30 * DAY_US) -> DataFrame:
    """Number each entity's distinct moments from 0, in order. (entity, at) must be distinct.

    Row numbers are taken inside (entity, time bucket) and raised by the count of earlier buckets, so no task ever sorts
    all moments of a hot entity.
    """
    cut = moments.withColumn("bucket", F.floor(F.col("at") / F.lit(bucket_us)).cast("bigint"))
    line = Window.partitionBy("entity").orderBy("bucket")
    counts = cut.groupBy("entity", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next_bucket_at", F.lead("first_at").over(line))
    inner = Window.partitionBy("entity", "bucket").orderBy("at")
    inside = cut.withColumn("rn", F.row_number().over(inner)).withColumn("next_at", F.lead("at").over(inner))
    joined = inside.join(counts.select("entity", "bucket", "base", "next_bucket_at"), ["entity", "bucket"])
    return joined.withColumn("idx", F.col("base") + F.col("rn") - 1).withColumn("next_at", F.coalesce("next_at", "next_bucket_at")).drop("bucket", "rn", "base", "next_bucket_at")


def listing_history(master: DataFrame) -> DataFrame:
    """(code, value, from_us, to_us): maximal periods of an equal name|list_status; ``to_us`` is null on the last.

    Of rows of one moment the one with the latest ingested_at, then smallest source counts. Blanks around names are
    removed; a null name or status counts as empty. Rows without code or available_at are left out.
    """
    rows = master.where("code is not null and available_at is not null")
    value = F.concat(F.coalesce(F.btrim("name", F.lit(BLANKS)), F.lit("")), F.lit("|"), F.coalesce("list_status", F.lit("")))
    picked = rows.select(clean_code("code").alias("entity"), micros("available_at").alias("at"), (-F.coalesce(micros("ingested_at"), F.lit(-NEVER))).alias("i"), F.coalesce("source", F.lit("\U0010ffff")).alias("s"), value.alias("value"))
    one = picked.groupBy("entity", "at").agg(F.min(F.struct("i", "s", "value")).alias("b")).select("entity", "at", F.col("b.value").alias("value"))
    line = Scratch(master.sparkSession, "moments").cut(numbered(one))
    found = runs(line.select("entity", "value", "idx"))
    starts = line.select("entity", F.col("idx").alias("first_idx"), F.col("at").alias("from_us"))
    ends = line.select("entity", F.col("idx").alias("last_idx"), F.col("next_at").alias("to_us"))
    return found.join(starts, ["entity", "first_idx"]).join(ends, ["entity", "last_idx"]).select(F.col("entity").alias("code"), "value", "from_us", "to_us")


def sector_history(membership: DataFrame) -> DataFrame:
    """(code, value, from_day, to_day): maximal runs of days with the same industry, by what is known now; days since
    1970, ``to_day`` null where open.

    The snapshots are the stretches between days on which any of the code's memberships begins or ends; at most two per
    membership and never more than days in the calendar, so no code can hold an unbounded number of them.
    """
    log = sector_log(membership)
    key = ["entity", "key"]
    last = log.groupBy(*key).agg(F.max("at").alias("at"))
    now = log.join(last, [*key, "at"]).withColumn("to_day", F.coalesce("to_day", F.lit(_OPEN))).where("from_day <= to_day").select("entity", "at", "from_day", "to_day", "value")
    cuts = now.select("entity", F.explode(F.array("from_day", F.col("to_day") + 1)).alias("cut")).distinct()
    order = Window.partitionBy("entity").orderBy("cut")
    parts = cuts.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).withColumn("part_end", F.lead("cut").over(order) - 1).where("part_end is not null")
    parts = Scratch(membership.sparkSession, "parts").cut(parts)
    n, p = now.alias("n"), parts.alias("p")
    covered = n.join(p, (F.col("n.entity") == F.col("p.entity")) & (F.col("p.cut") >= F.col("n.from_day")) & (F.col("p.part_end") <= F.col("n.to_day")))
    rank = F.struct((-F.col("n.at")).alias("a"), (-F.col("n.from_day")).alias("b"), F.when(F.col("n.to_day") == _OPEN, 2**31 - 1).otherwise(-F.col("n.to_day")).alias("c"), F.col("n.value").alias("value"))
    best = covered.groupBy("p.entity", "p.idx").agg(F.min(rank).alias("r"))
    found = runs(best.select("entity", F.col("r.value").alias("value"), "idx"))
    starts = parts.select("entity", F.col("idx").alias("first_idx"), F.col("cut").alias("from_day"))
    ends = parts.select("entity", F.col("idx").alias("last_idx"), F.col("part_end").alias("to_day"))
    out = found.join(starts, ["entity", "first_idx"]).join(ends, ["entity", "last_idx"])
    return out.select(F.col("entity").alias("code"), "value", "from_day", F.when(F.col("to_day") < _OPEN, F.col("to_day")).alias("to_day"))


def attribute_history(master: DataFrame, membership: DataFrame) -> DataFrame:
    """Both histories in one form: (code, attribute, value, period_from, period_to) as strings."""
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    day = lambda c: F.date_from_unix_date(F.col(c)).cast("string")
    blank = F.lit("")
    listing = listing_history(master).select("code", F.lit("listing").alias("attribute"), "value", stamp("from_us").alias("period_from"), F.coalesce(stamp("to_us"), blank).alias("period_to"))
    sector = sector_history(membership).select("code", F.lit("sector").alias("attribute"), "value", day("from_day").alias("period_from"), F.coalesce(day("to_day"), blank).alias("period_to"))
    return listing.unionByName(sector)
