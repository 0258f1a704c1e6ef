"""Vectorised word splitting and hashing over the bytes of a block of documents.

Everything here is a small numpy helper that runs inside a Spark task on one
block (a few MB). Word separators are the bytes 0x20 and 0x09-0x0D. Hashes are
64-bit polynomials over randomly mapped bytes, finished with a bit mixer; they
depend on nothing but the word, so that every task agrees on them.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEGMENT = 1 << 20


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, 256, dtype=U64)


def _fold(table: np.ndarray) -> np.ndarray:
    folded = table.copy()
    folded[65:91] = folded[97:123]
    return folded


_TABLES = {(k, low): (_fold(_table(k)) if low else _table(k)) for k in (11, 12) for low in (False, True)}
_BASE = {11: 0x9E3779B97F4A7C15, 12: 0xC2B2AE3D27D4EB4F}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = max(n, _SEGMENT + 4096)
        out = []
        for base in (_BASE[kind], pow(_BASE[kind], -1, 2**64)):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[kind] = tuple(out)
    return _POWERS[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any run of bits of a hash can serve as its prefix."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Words:
    """The words of a block: byte ranges, and ptr[i]:ptr[i+1] as those of document i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        solid = np.zeros(len(buf) + 2, bool)
        np.logical_not(_SPACE[buf], out=solid[1:-1])
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        self.ptr = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False, kind: int = 11) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends, lower, kind)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, kind: int = 11) -> np.ndarray:
    """A hash of each byte range; ranges ascend and don't overlap."""
    table, out, i = _TABLES[kind, lower], np.empty(len(starts), U64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _SEGMENT, side="right")))
        n = int(ends[j - 1] - at)
        up, down = _powers(kind, n + 1)
        run = np.zeros(n + 1, U64)
        np.cumsum(table[buf[at : ends[j - 1]]] * up[:n], out=run[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (run[e] - run[s]) * down[s]
        i = j
    return mix(out)


def windows(words: np.ndarray, k: int, kind: int = 11) -> np.ndarray:
    """Hashes of all runs of k consecutive words, whatever document they lie in."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k < 8:
        q, acc = U64(_BASE[23 - kind]), words[:n].copy()
        for j in range(1, k):
            acc *= q
            acc += words[j : j + n]
        return mix(acc)
    out = np.empty(n, U64)
    for a in range(0, n, _SEGMENT):  # differences of running sums: the same numbers, whatever k
        b = min(n, a + _SEGMENT)
        up, down = _powers(23 - kind, b - a + k)
        run = np.zeros(b - a + k, U64)
        np.cumsum(words[a : b + k - 1] * down[: b - a + k - 1], out=run[1:])
        out[a:b] = (run[k:] - run[:-k]) * up[k - 1 : b - a + k - 1]
    return mix(out)


def window_starts(ptr: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a run of k words begins that stays in one document."""
    n = int(ptr[-1])
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, ptr[:-1], 1)
    stop = np.maximum(ptr[1:] - (k - 1), ptr[:-1])
    np.add.at(inside, stop, -1)
    return np.flatnonzero(np.cumsum(inside[:n]) > 0)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i]+lengths[i]] for all i, joined."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[at + np.arange(total)]
