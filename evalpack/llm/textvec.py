"""Vectorised word hashing over Arrow string columns.

Words become 64-bit hashes without a Python object per word. Texts are worked
through in slices of about a megabyte, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII characters that are neither letters nor digits.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 (B is odd, so its inverse exists)."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0], _POWERS[1]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty_like(word)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z folded if ``lower``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(col: pa.Array, lower: bool, sep: np.ndarray = SPACE, limit: int = 1 << 20
          ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, word hashes, index of each row's first word)."""
    data, offsets = utf8(col)
    for lo, hi in slices(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, ptr = word_spans(part, offsets[lo : hi + 1] - offsets[lo], sep)
        yield lo, hi, word_hashes(part, starts, ends, lower), ptr


def hash_words(texts: list[str], lower: bool, sep: np.ndarray = SPACE) -> list[np.ndarray]:
    """Word hashes of a few texts, as ``words`` makes them."""
    out = []
    for lo, hi, h, ptr in words(pa.array(texts, pa.string()), lower, sep):
        out += [h[ptr[i] : ptr[i + 1]] for i in range(hi - lo)]
    return out


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes, by its first position."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out * _BASE + h[k : len(h) - n + 1 + k])
    return out
