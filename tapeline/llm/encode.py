"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: content-defined chunk reuse. A rolling hash over the last characters sets chunk boundaries, so equal passages of
different documents fall into equal chunks. Each worker encodes a chunk once and keeps its ids in a dictionary of bounded
size, for all documents and tasks it handles; stock passages are in every worker's dictionary soon, and no text moves
between executors, so nothing is shuffled or written besides the result. The ids of a document's chunks, put in a row, are
wrong around the joins; they are repaired by re-encoding. The text between the last place before a join and the first
place after it at which the tokenizer's pre-splitting must begin a new piece, whatever stands around (judged by the
characters' classes), is encoded anew and replaces the tokens there. Merges never cross such a place, so a repaired row
agrees with the ids of the whole text, if the chunks' own tokens begin and end at these places. That is checked for every
join; where it fails, the document is encoded as a whole (the tests compare all ids).
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeline.llm.text import code_points, prefix_hashes, slices, span_hashes

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters the rolling hash sees, and one boundary in so many places.
WINDOW, EVERY = 8, 128
#: Characters of all chunks in a worker's dictionary; a full one is emptied, which costs time only.
DICTIONARY = 4_000_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public tokenizer's file, where the package that brings them is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def encoding(path: str):
    """The tiktoken encoding of a rank file; the library is only needed where texts are encoded."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _classes() -> np.ndarray:
    """0: not judged, 1: letter, 2: digit or other number, 3: other, 4: space proper, 5: other white space.

    Only characters below U+3100, ideographs and full-width forms are judged; their classes are the same in every
    version of Unicode. The apostrophe, which begins contractions, is not judged either.
    """
    import unicodedata

    kinds = np.zeros(0x110000, np.uint8)
    for c in [*range(0x3100), *range(0x4E00, 0x9FA6), *range(0xFF00, 0xFFF0)]:
        kind = unicodedata.category(chr(c))
        kinds[c] = 5 if chr(c).isspace() else 0 if kind == "Cn" else 1 if kind[0] == "L" else 2 if kind[0] == "N" else 3
    kinds[[0x1C, 0x1D, 0x1E, 0x1F, ord("'")]] = 0
    kinds[ord(" ")] = 4
    return kinds


def safe_places(points: np.ndarray) -> np.ndarray:
    """Places at which pre-splitting must begin a new piece: before a single space between solid characters, or between
    solid characters of different classes."""
    kinds = _classes()[points]
    left, right = kinds[:-1], kinds[1:]
    after = np.concatenate((kinds[2:], np.zeros(1, np.uint8)))[: len(right)]
    solid = lambda k: (k >= 1) & (k <= 3)
    return np.nonzero(solid(left) & ((right == 4) & solid(after) | solid(right) & (left != right)))[0] + 1


def chunk_begins(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts begin, in order; an empty text has none."""
    at = np.arange(WINDOW, len(points))
    rolled = span_hashes(prefix_hashes(points), at - WINDOW, at) if len(at) else np.zeros(0, np.uint64)
    at = at[rolled % np.uint64(EVERY) == 0]
    # a window that reaches into the document before would make the cut depend on it
    at = at[at - starts[np.searchsorted(starts, at, "right") - 1] >= WINDOW]
    return np.unique(np.concatenate((starts[:-1][starts[1:] > starts[:-1]], at)))


class Dictionary:
    """Ids of chunks, and of the pieces between them, each encoded once as long as there is room."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary
        by_rank = {encoding(path).encode_single_token(t): len(t) for t in encoding(path).token_byte_values()}
        self.sizes = [by_rank.get(i, 0) for i in range(max(by_rank) + 1)]
        self.held: dict[str, tuple[list[int], list[int]]] = {}
        self.chars = self.encoded = self.whole = 0

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, the byte after each of them)."""
        found = self.held.get(text)
        if found is None:
            ids = self.encode(text)
            found = ids, list(accumulate(map(self.sizes.__getitem__, ids)))
            self.encoded += 1
            self.chars += len(text)
            if self.chars > DICTIONARY:
                self.held, self.chars = {}, len(text)
            self.held[text] = found
        return found


@lru_cache(2)
def _dictionary(path: str) -> Dictionary:
    return Dictionary(path)


def encode_texts(texts: list[str], own: Dictionary) -> list[list[int]]:
    """The ids of each text."""
    points, starts = code_points(texts)
    joined = "".join(texts)
    bytes_at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64))))
    chunks = chunk_begins(points, starts)
    is_place = np.zeros(len(points) + 1, bool)
    is_place[safe_places(points)] = is_place[starts] = True
    places = np.flatnonzero(is_place)
    joins, clean = chunks[~is_place[chunks]], chunks[is_place[chunks]]
    # between two joins without a safe place the spans to encode anew are the same one, otherwise they don't overlap
    anew = places[np.searchsorted(places, joins, "left") - 1]
    begins, is_anew = np.zeros(len(points) + 1, bool), np.zeros(len(points) + 1, bool)
    begins[starts[:-1]] = begins[clean] = begins[places[np.searchsorted(places, joins, "right")]] = begins[anew] = is_anew[anew] = True
    begin = np.flatnonzero(begins[:-1])
    end = np.append(begin[1:], len(points)).astype(np.int64)
    fresh = is_anew[begin]
    chunk = np.searchsorted(chunks, begin, "right") - 1
    chunk_end = np.append(chunks[1:], len(points)).astype(np.int64)
    # a chunk that ends its document ends where the next one's first chunk begins, as empty texts have no characters
    low, high = bytes_at[begin] - bytes_at[chunks[chunk]], bytes_at[end] - bytes_at[chunks[chunk]]
    first = np.searchsorted(begin, starts)
    out, rows = [], list(zip(begin.tolist(), end.tolist(), fresh.tolist(), chunks[chunk].tolist(), chunk_end[chunk].tolist(), low.tolist(), high.tolist(), strict=True))
    for k, text in enumerate(texts):
        row: list[int] = []
        for b, e, is_fresh, c, d, lo, hi in rows[first[k] : first[k + 1]]:
            if is_fresh:
                row += own.ids(joined[b:e])[0]
                continue
            ids, ends = own.ids(joined[c:d])
            i, j = (bisect_left(ends, lo) + 1 if lo else 0), bisect_left(ends, hi) + 1
            if j > len(ends) or ends[j - 1] != hi or (lo and ends[i - 1] != lo):
                row = own.encode(text)
                own.whole += 1
                break
            row += ids[i:j]
        out.append(row)
    return out


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text, without special tokens; text that looks like one is text.

    An empty and a null text have an empty list. There is a row for every row, repeated ones and such without a key
    included. Further columns are ignored. Empty in, empty out.
    """
    path = path or tokenizer_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dictionary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                ids = encode_texts(texts[i:j], own)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, ids array<int>")
