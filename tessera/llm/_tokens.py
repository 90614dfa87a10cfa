"""Vectorised tokenising and hashing of Arrow string columns on their UTF-8 bytes.

Both word definitions of this subpackage separate words at ASCII bytes only, so that they can be applied to bytes:
every byte of a multi-byte character is a word byte. All hashes are 64-bit and equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are worked on together; one longer text is worked on whole.
SLICE = 1 << 19

#: Separators of words of the kind [^\x20\x09-\x0D]+ and of the kind [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 1)
        pair = []
        for b in (BASE, INVERSE):
            x = np.full(size, b, U)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        _powers[:] = pair
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of about limit bytes each; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(raw: np.ndarray, at: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and rows of the words. raw must be lower-cased where sep asks for it."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~sep[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = inside[edge]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(at, s, "right") - 1


def hash_spans(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of raw[s:e] for many spans at once."""
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words inside a row, and the index of the first word of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= U(BASE)
        acc += h[j : n + j]
    whole = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(acc[whole] + U(k)), whole


def tokens(texts: pa.Array, sep: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, their rows counted from the first) of slices of a text column."""
    for lo, hi, raw, at in slices(texts):
        raw = LOWER[raw] if lower else raw
        s, e, row = words(raw, at, sep)
        yield lo, hi, hash_spans(raw, s, e) if len(s) else np.zeros(0, U), row
