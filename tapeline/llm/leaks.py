"""Held-out evaluation texts that occur, whole or in part, in a training corpus.

Method: all n-character windows of the normalised items are hashed into a broadcast table; one pass over the corpus
hashes every window of every document (prefix sums, so a window costs a few vector operations), looks it up, and
verifies hits character by character. The corpus is never shuffled.

The table is broadcast in blocks of a stated number of windows; items beyond a block make another pass, so the
broadcast is bounded and no item is dropped. Leaking documents can be removed, or only their passages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.text import alnum_points, char_map, one_form, prefix_hashes, slices, span_hashes
from tapeline.scratch import Scratch

#: Windows in one broadcast (16 bytes each, and the items' letters).
BLOCK_WINDOWS = 4_000_000
_BITS = 22
#: A character with the marks on it.
CLUSTERS = regex.compile(r"\X")


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return alnum_points([one_form(t).lower() for t in texts])


class ItemTable:
    """Hashes of all windows of some items, sorted, with item and place of each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids = n, np.array([i for i, _ in items], np.int64)
        self.points, starts = normalised([t for _, t in items])
        at = np.concatenate([np.arange(a, max(a, b - n + 1)) for a, b in zip(starts[:-1], starts[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.searchsorted(starts, at, "right") - 1
        hashes = span_hashes(prefix_hashes(self.points), at, at + n)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.owner = hashes[order], at[order], owner[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _BITS)] = True

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, item id, window's place among the document's letters and digits) of each verified hit."""
        points, starts = normalised(texts)
        none = np.zeros(0, np.int64)
        if len(points) < self.n or not len(self.hashes):
            return none, none, none
        begin = np.arange(len(points) - self.n + 1)
        hashes = span_hashes(prefix_hashes(points), begin, begin + self.n)
        begin = begin[self.filter[hashes >> np.uint64(64 - _BITS)]]
        doc = np.searchsorted(starts, begin, "right") - 1
        inside = begin + self.n <= starts[doc + 1]
        begin, doc = begin[inside], doc[inside]
        low, high = np.searchsorted(self.hashes, hashes[begin], "left"), np.searchsorted(self.hashes, hashes[begin], "right")
        times = high - low
        begin, doc, low = np.repeat(begin, times), np.repeat(doc, times), np.repeat(low, times)
        entry = low + np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)
        same, offsets = np.zeros(len(begin), bool), np.arange(self.n)
        for k in range(0, len(begin), 20_000):
            part = slice(k, k + 20_000)
            same[part] = (points[begin[part, None] + offsets] == self.points[self.at[entry[part], None] + offsets]).all(1)
        return doc[same], self.ids[self.owner[entry[same]]], (begin - starts[doc])[same]


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_WINDOWS windows, one at a time, in order of their keys; at least one, empty if there is no item."""
    block: list[tuple[int, str]] = []
    room = BLOCK_WINDOWS
    for item, body in items.where(f"{text} is not null and {key} is not null").select(key, text).orderBy(key).toLocalIterator():
        if len(body) > room and block:
            yield block
            block, room = [], BLOCK_WINDOWS
        block.append((item, body))
        room -= len(body)
    yield block


def _passages(doc: np.ndarray, item: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(document number, item, from, to) of the passages that windows of one document and item form together."""
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + n)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    return doc[begin], item[begin], at[begin], at[last] + n


def _scan(source: DataFrame, table: Broadcast) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in slices(bodies):
                doc, item, begin, end = _passages(*table.value.scan(bodies[i:j]), table.value.n)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][doc], pa.int64()), pa.array(item, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "span_from", "span_to"])

    return source.mapInArrow(scan, "doc_id bigint, item_id bigint, span_from bigint, span_to bigint")


def leaks(docs: DataFrame, items: DataFrame, n: int = 60, spans: bool = False) -> DataFrame:
    """(doc_id, item_id), distinct: the document holds at least ``n`` consecutive letters or digits of the item's text.

    Case, everything that is not a letter or digit, and look-alike characters are left aside. With ``spans`` there is a
    row for each passage, with its first place and the one after its last among the document's letters and digits;
    passages that touch are one. Null texts and keys leak nothing, items shorter than ``n`` cannot leak, documents with the
    same key are one. Further columns are ignored. Items beyond one block are scanned for block by block, each block's
    hits written to the shared folder, so that driver and executors hold one block at a time.
    """
    spark = docs.sparkSession
    source = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    scratch, blocks = Scratch(spark, "leaks"), _blocks(items, "item_id", "text")
    block, parts = next(blocks), []
    while block is not None:
        following = next(blocks, None)
        table = spark.sparkContext.broadcast(ItemTable(block, n))
        part = _scan(source, table)
        if following is not None or parts:
            part = scratch.cut(part)
            table.destroy()
        parts.append(part)
        block = following
    found = reduce(DataFrame.unionByName, parts)
    return found.distinct() if spans else found.select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that leak nothing, all columns kept."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def _origins(text: str) -> tuple[list[int], list[int]]:
    """For each letter or digit of the normalised text, where in ``text`` the characters begin and end that it comes from."""
    table, held, at = char_map(), [], []
    for i, c in enumerate(text):
        to = table.get(ord(c), ord(c))
        if to is not None:
            held.append(chr(to))
            at.append(i)
    begin, end, k = [], [], 0
    for cluster in CLUSTERS.findall("".join(held)):
        first, last = at[k], at[k + len(cluster) - 1] + 1
        for c in unicodedata.normalize("NFC", cluster).lower():
            if c.isalnum():
                begin.append(first)
                end.append(last)
        k += len(cluster)
    return begin, end


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the passages, given as places among its letters and digits; what stands around them stays."""
    begin, end = _origins(text)
    kept, done = [], 0
    for a, b in sorted(spans):
        if b > len(begin):  # letters that no cluster accounts for: nothing of the text can be told to be clean
            return ""
        kept.append(text[done : max(done, begin[a])])
        done = max(done, end[b - 1])
    return "".join(kept) + text[done:]


def without_passages(docs: DataFrame, items: DataFrame, n: int = 60) -> DataFrame:
    """All documents, all columns kept, with the leaked passages cut out of ``text``; documents without leaks are unchanged.

    Passages of different items may overlap and are cut once; clean text between two passages stays. Rows with the same
    doc_id should have the same text. Null texts stay null. Empty in, empty out.
    """
    held = leaks(docs, items, n, spans=True).groupBy("doc_id").agg(F.collect_set(F.struct("span_from", "span_to")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else cut_out(t, [(x["span_from"], x["span_to"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    order = docs.columns
    return docs.join(held, "doc_id", "left").withColumn("text", cut("text", "_spans")).select(*order)
