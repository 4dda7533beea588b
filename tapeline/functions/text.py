"""Text expressions of the evidence pipeline, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: buckets of the token vector.
BUCKETS = 8


def squeeze(c: Column | str) -> Column:
    """White space collapsed to single spaces, none around."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def content_hash(title: str, content: str) -> Column:
    return F.sha2(F.concat(squeeze(title), F.lit("\x00"), squeeze(content)), 256)


def canonical_url(c: str) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, an empty path as '/'; null if it is no http URL."""
    url = F.trim(F.col(c))
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme, authority = F.lower(part("PROTOCOL")), F.lower(part("AUTHORITY"))
    default = F.when(scheme == "http", ":80").otherwise(":443")
    place = F.when(authority.endswith(default), F.left(authority, F.length(authority) - F.length(default))).otherwise(authority)
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), part("QUERY")), F.lit(""))
    return F.when(scheme.isin("http", "https") & (place != ""), F.concat(scheme, F.lit("://"), place, path, query))


def terms(c: Column | str) -> Column:
    """Runs of letters, digits and dots in lower case, longer than two, in order and as often as they occur."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9.]+"), lambda w: F.length(w) > 2)


def tokens(c: Column | str) -> Column:
    """Terms without stock codes (digits and an exchange's suffix), sorted, each once."""
    return F.sort_array(F.array_distinct(F.filter(terms(c), lambda w: ~w.rlike(r"^[0-9]{6,7}\.(sh|sz|bj)$"))))


def term_counts(words: Column) -> Column:
    """Number of terms by byte sum modulo 8."""
    bucket = F.transform(words, lambda w: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.ascii(F.substr(w, i, F.lit(1)))), F.lit(0), lambda a, x: a + x) % BUCKETS)
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter(bucket, lambda b: b == k)))


def unit_vector(counts: Column) -> Column:
    """``counts`` divided by their Euclidean length; zeros stay zeros."""
    length = F.sqrt(F.aggregate(counts, F.lit(0), lambda a, x: a + x * x).cast("double"))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def cosine(a: Column, b: Column) -> Column:
    """0 for a length mismatch or a zero norm, else within 0..1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.when(norm > 0, norm)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), value).otherwise(0.0)


def common_prefix(a: Column, b: Column, most: int = 256) -> Column:
    """Length of the common prefix of the first ``most`` characters, over the shorter length; 0 if either is empty."""
    x, y = F.substring(a, 1, most), F.substring(b, 1, most)
    shorter = F.least(F.length(x), F.length(y))
    steps = F.array(*(F.lit(most >> k) for k in range(most.bit_length())))
    same = F.least(F.aggregate(steps, F.lit(0), lambda n, k: n + F.when(F.substring(x, F.lit(1), n + k) == F.substring(y, F.lit(1), n + k), k).otherwise(0)), shorter)
    return F.when(shorter > 0, same / F.when(shorter > 0, shorter)).otherwise(0.0)


def time_proximity(a: Column, b: Column, hours: int = 48) -> Column:
    """1 minus the distance over ``hours``; a half if a time is missing, null beyond."""
    gap = F.abs(F.unix_micros(a) - F.unix_micros(b)) / (hours * 3.6e9)
    return F.when(a.isNull() | b.isNull(), 0.5).when(gap <= 1, 1 - gap)


def next_weekday_morning(c: Column) -> Column:
    """The next weekday's 09:00 in Beijing (01:00 UTC) after a date: Friday and the weekend lead to Monday."""
    step = F.when(F.dayofweek(c) == 6, 3).when(F.dayofweek(c) == 7, 2).otherwise(1)
    return F.date_add(c, step).cast("timestamp") + F.expr("interval 1 hour")
