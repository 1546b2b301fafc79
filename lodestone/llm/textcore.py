"""Vectorised words and shingles over Arrow string buffers (numpy only, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .spark import offsets

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LUT = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    ends = offsets(col)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space); the words' offsets by row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ends), np.int64)
    gap = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[ends[:-1][ends[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[ends[1:][ends[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_LUT[_LOWER[data] if lower else data] * up[:n], out=total[1:])
    return mix64((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(_U))


def shingle_hashes(col: pa.Array, k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, with repeats, and their offsets by row.

    A row with fewer than k words, but one at least, has its whole word sequence as one shingle.
    """
    data, ends = buffers(col)
    starts, stops, rows = words(data, ends)
    h = word_hashes(data, starts, stops, lower)
    factor = mix64(np.arange(1, k + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
    count = np.diff(rows)
    n_out = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(n_out)])
    # position of the first word of each shingle
    at = np.arange(offsets[-1]) + np.repeat(rows[:-1] - offsets[:-1], n_out)
    out = np.zeros(len(at), _U)
    padded = np.concatenate([h, np.zeros(k, _U)])
    last = np.repeat(rows[1:], n_out)
    for t in range(k):
        inside = at + t < last
        out += np.where(inside, padded[at + t] * factor[t], _U(0))
    short = np.repeat(np.where(count < k, count, k), n_out)
    return mix64(out + short.astype(_U)), offsets


def distinct_shingles(col: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    h, offsets = shingle_hashes(col, k)
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
