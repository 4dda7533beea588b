"""Texts that look alike but are stored in different characters, brought to one form.

Method: look-alike mapping by translate(), then grouping under Spark's accent- and case-sensitive UNICODE collation,
under which composed and combining accents are equal; the smallest doc_id with a stored form is the class's canonical
member and is joined back.

Whole texts are compared only where they may be equal: a 64-bit hash of the skeleton (mapped, accents removed) finds
texts whose stored forms differ at all, and only those are moved and collated. Exact copies collapse to one stored form
on the map side before any comparison. Control characters, which the collation would skip, are mapped to private-use
characters first, so that they make a difference. Marks of other scripts that the collation skips although they are seen
are told apart by an exact check of the composed form inside each class.

``variants`` is the result to keep: one row per document with its class. ``pairs`` expands it, so its size follows the
product of the copies of a class's stored forms; use it only where pairs are what is asked for.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.text import base_map, char_map, mapped

# Control characters without weight in the collation (tab, line ends and next line have one).
_WEIGHTLESS = {c: 0xE000 + c for c in [*range(9), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0)]}


def _hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = F.col(text)
    skeleton = F.xxhash64(mapped(raw, base_map(), _WEIGHTLESS))
    return docs.where(raw.isNotNull()).select(F.col(key).alias("doc_id"), raw.alias("text"), skeleton.alias("skel"), F.xxhash64(raw).alias("r1"), F.xxhash64(F.lit(11), raw).alias("r2"))


def _ordered(texts: pd.Series) -> pd.Series:
    """Several accents on one letter in their canonical order, which the collation takes for granted."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, r1, r2, canonical_id): documents whose text also occurs in another stored form, with the canonical member.

    ``r1, r2`` identify the stored form. Selectors of variants (as of emoji) and other characters never drawn are left out
    like zero-width ones. Null texts, and texts of white space only once in one form, are left out;
    further columns are ignored. Empty in, empty out.
    """
    hashed = _hashes(docs, key, text)
    several = hashed.groupBy("skel").agg(F.min("r1").alias("a"), F.max("r1").alias("b"), F.min("r2").alias("c"), F.max("r2").alias("d")).where("a <> b or c <> d").select("skel")
    # the text moves only where the join keeps it
    shared = hashed.join(several, "skel")
    form = mapped(F.col("text"), char_map(), _WEIGHTLESS)
    forms = shared.groupBy("skel", "r1", "r2").agg(F.min("doc_id").alias("member"), F.first("text").alias("text"))
    ordered = F.pandas_udf(_ordered, "string")
    forms = forms.withColumn("form", F.collate(ordered(form), "UNICODE")).where(F.length(F.regexp_replace(form, r"\s", "")) > 0).drop("text")
    # the collation finds the class; equal composed forms inside it are one text, so what it skips still makes a difference
    forms = forms.withColumn("exact", F.xxhash64(F.collate("form", "UTF8_BINARY")))
    classes = forms.groupBy("skel", "form", "exact").agg(F.min("member").alias("canonical_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    f, c = forms.alias("f"), classes.alias("c")
    named = f.join(c, (F.col("f.skel") == F.col("c.skel")) & (F.col("f.form") == F.col("c.form")) & (F.col("f.exact") == F.col("c.exact"))).select("f.skel", "f.r1", "f.r2", "c.canonical_id")
    members = hashed.select("doc_id", "skel", "r1", "r2")
    return members.join(named, ["skel", "r1", "r2"]).select("doc_id", "r1", "r2", "canonical_id")


def pairs(classes: DataFrame) -> DataFrame:
    """Pairs (doc_a < doc_b) of one class that are stored differently; copies of one stored form make no pair."""
    a, b = classes.alias("a"), classes.alias("b")
    differ = (F.col("a.r1") != F.col("b.r1")) | (F.col("a.r2") != F.col("b.r2"))
    on = (F.col("a.canonical_id") == F.col("b.canonical_id")) & (F.col("a.doc_id") < F.col("b.doc_id")) & differ
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))
