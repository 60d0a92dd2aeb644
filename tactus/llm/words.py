"""Words of UTF-8 text as arrays: where they lie and 64-bit hashes of them, without a Python object for each word.

Hashes serve to compare words within bounded blocks and to form keys; where a hash decides a result on its own, the
operator says so.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Words are hashed in runs of about so many bytes, whatever the length of the text.
RUN_BYTES = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


@cache
def byte_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. space: all but blank and 0x09-0x0D; alnum: digits, letters and all from 0x80."""
    b = np.arange(256)
    if kind == "space":
        return ~((b == 0x20) | ((b >= 9) & (b <= 13)))
    return ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)


@cache
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def find_words(data: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, first byte, end) of each word of the texts data[at[i]:at[i+1]]; no word crosses a text's end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = byte_table(kind)[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a text ends and the next starts in letters
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]))
    first, end = marks[0::2], marks[1::2]
    return np.searchsorted(at, first, "right") - 1, first, end


def hash_words(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lowered if asked."""
    sizes = end - first
    out = np.empty(len(first), np.uint64)
    if not len(first):
        return out
    if not sizes.all():  # empty stretches have the hash of nothing
        full = np.flatnonzero(sizes)
        out[:] = mix(np.zeros(1, np.uint64))
        out[full] = hash_words(data, first[full], end[full], lower)
        return out
    values = _byte_values()
    if lower:
        values = values[lower_table()]
    total = np.cumsum(sizes)
    power = _powers(1 << int(max(6, int(sizes.max() - 1).bit_length())))
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + RUN_BYTES, "right")))
        size = sizes[a:b]
        start = np.cumsum(size) - size
        pos = np.arange(int(size.sum())) - np.repeat(start, size)
        raw = data[np.repeat(first[a:b], size) + pos]
        out[a:b] = np.add.reduceat(values[raw] * power[pos], start)
        a = b
    return mix(out + sizes.astype(np.uint64))


def windows(doc: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of k words within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * _C + h[i : n + i])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, out[at]


def doc_counts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs).astype(np.int64)
