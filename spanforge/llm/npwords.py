"""Vectorised word kernel: a whole Arrow batch of texts is cut into words and hashed with a dozen numpy passes, no per-text Python."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def alnum() -> np.ndarray:
    """For each code point, whether it is a letter or a digit (general category L* or N*)."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: list[str | None], lower: bool = True) -> np.ndarray:
    """Code points of all texts, each followed by a 0 (a 0 inside a text becomes a blank)."""
    one = "\0".join(t.replace("\0", " ") if t and "\0" in t else t or "" for t in texts) + "\0"
    return np.frombuffer((one.lower() if lower else one).encode("utf-32-le", "surrogatepass"), np.uint32)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, index of its text); a word is a run of letters and digits, lower-cased."""
    codes = joined(texts)
    ok = alnum()[codes]
    edge = np.flatnonzero(np.diff(ok.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text_of = np.searchsorted(np.flatnonzero(codes == 0), start)
    size = end - start
    at = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max()), MULT, np.uint64))
    c = codes[ok].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(at, size)], at)
    return mix(h), text_of
