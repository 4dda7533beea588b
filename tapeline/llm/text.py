"""One form for text that looks alike, for Spark columns and for Python workers, from one table."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts shaped like a Latin one, and that letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXQWaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXCJovcj"
# Characters that are never drawn themselves and aren't of category Cf (joiners, vowels and selectors of variants).
WIDTHLESS = [0x034F, 0x17B4, 0x17B5, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


@lru_cache(1)
def char_map() -> dict[int, int | None]:
    """Code point to the one it is stored as; None: it is left out. Full-width forms, spaces, zero widths, look-alikes."""
    found: dict[int, int | None] = {0xFF01 + i: 0x21 + i for i in range(94)}
    found |= dict(zip(map(ord, CYRILLIC + GREEK), map(ord, CYRILLIC_AS + GREEK_AS), strict=True))
    found |= dict.fromkeys(WIDTHLESS)
    for c in range(0xFFFF):
        kind, ch = unicodedata.category(chr(c)), chr(c)
        if kind == "Zs" and c != 0x20:
            found[c] = 0x20
        elif kind == "Cf" and not 0x0600 <= c <= 0x08FF and not 0xFFF0 <= c:  # Arabic signs are visible
            found[c] = None
        elif 0x0370 <= c < 0x0530 or 0x1F00 <= c < 0x2000:  # accented look-alikes: the Latin letter with the same accents
            base = unicodedata.normalize("NFD", ch)
            if len(base) > 1 and ord(base[0]) in found:
                whole = unicodedata.normalize("NFC", chr(found[ord(base[0])]) + base[1:])
                if len(whole) == 1:
                    found[c] = ord(whole)
    return found


@lru_cache(1)
def base_map() -> dict[int, int | None]:
    """As ``char_map``, and accented letters to their base, accents left out: equal texts have equal skeletons."""
    found = dict(char_map())
    for c in range(0xFFFF):
        if unicodedata.category(chr(c))[0] == "M":
            found[c] = None
        elif not 0xAC00 <= c < 0xD800:
            base = unicodedata.normalize("NFD", chr(c))
            if base != chr(c) and ord(base[0]) < 0xFFFF:
                found[c] = found.get(ord(base[0]), ord(base[0]))
    for c, to in [*found.items()]:
        if to is not None and (b := unicodedata.normalize("NFD", chr(to))[0]) != chr(to):
            found[c] = ord(b)
    return found


def mapped(c: Column, table: dict[int, int | None], extra: dict[int, int] | None = None) -> Column:
    """``c`` with every character replaced by ``table``; one pass of translate(), which deletes what has no partner."""
    table = table | (extra or {})
    kept = sorted((k, v) for k, v in table.items() if v is not None)
    gone = sorted(k for k, v in table.items() if v is None)
    return F.translate(c, "".join(chr(k) for k, _ in kept) + "".join(map(chr, gone)), "".join(chr(v) for _, v in kept))


def one_form(text: str) -> str:
    """The same form in Python, accents composed."""
    return unicodedata.normalize("NFC", text.translate(char_map()))


@lru_cache(1)
def alnum_table() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


#: Characters a worker handles at a time; a longer text is handled alone.
SLICE = 1_000_000


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters together, so that a worker's memory doesn't follow the batch size."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if texts:
        yield begin, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and where each text begins (one more offset at the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def alnum_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the texts only; offsets as in ``code_points``."""
    points, starts = code_points(texts)
    keep = alnum_table()[points]
    before = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], before[starts]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base))
    if n:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Running sums of code points times powers of an odd base, modulo 2^64."""
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(_BASE, len(points)), dtype=np.uint64)))


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [begin, end), the same wherever the span stands."""
    inverse = _powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[begin]) * inverse[begin])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))
