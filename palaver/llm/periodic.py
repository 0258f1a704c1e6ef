"""Periodic runs of words, and texts with each run collapsed to its first period.

A run is a stretch of consecutive words with smallest period q and at least
max(6, 4 q) words that no neighbouring word extends. Method: harmonic grid. A run
of period p has at least 3 p places at which a word equals the one p words later,
so one of them is a multiple of 3 p; over all p these are n ln(n) / 3 grid points.
Where the two words of a point are equal, prefix hashes give how far the equality
reaches to both sides, by a binary search that all (period, point) pairs of a
slice of documents make at once. The words of each stretch are then compared
byte by byte, and stretches that several periods found keep the smallest.

Every document is worked on by itself inside a Spark task: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textcore import U64, Words, _powers, ragged

SHORTEST, TIMES = 6, 4
#: Grid points that are looked at together.
POINTS = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _reach(prefix: np.ndarray, up: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, stretch) -> np.ndarray:
    """The largest length in low..high whose words equal those p later; stretch(length) gives where that stretch begins and ends."""
    factor = up[p]
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        a, b = stretch(mid)
        same = (prefix[b] - prefix[a]) * factor == prefix[b + p] - prefix[a + p]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def stretches(ids: np.ndarray, ptr: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of each run of documents ptr[i]:ptr[i+1] of the word ids, by start, then period."""
    sizes = np.diff(ptr)
    most = np.where(sizes >= SHORTEST, sizes // TIMES, 0)
    up, _ = _powers(11, len(ids) + 1)
    prefix = np.zeros(len(ids) + 1, U64)
    np.cumsum(ids * up[: len(ids)], out=prefix[1:])
    found = [np.zeros((3, 0), np.int64)]
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = (sizes[doc] - 1 - period) // (3 * period) + 1
    done, i = np.cumsum(grid), 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + points, side="right")))
        n = grid[i:j]
        p, d = np.repeat(period[i:j], n), np.repeat(doc[i:j], n)
        at = ptr[d] + 3 * p * (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n))
        hit = np.flatnonzero(ids[at] == ids[at + p])
        p, at, first, last = p[hit], at[hit], ptr[d[hit]], ptr[d[hit] + 1]
        after = _reach(prefix, up, p, np.ones(len(p), np.int64), last - at - p, lambda m, at=at: (at, at + m))
        before = _reach(prefix, up, p, np.zeros(len(p), np.int64), at - first, lambda m, at=at: (at - m, at))
        begin, end = at - before, at + p + after
        long = end - begin >= np.maximum(SHORTEST, TIMES * p)
        found.append(_smallest(np.stack([begin[long], end[long], p[long]])))
        i = j
    begin, end, p = _smallest(np.concatenate(found, axis=1))
    order = np.lexsort((p, begin))
    return begin[order], end[order], p[order]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of runs with equal start and end, that of the smallest period: the others are its multiples."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    return runs[:, new]


def same_words(w: Words, begin: np.ndarray, end: np.ndarray, p: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Whether each word of the runs is, byte by byte, the one a period later."""
    true, sizes = np.ones(len(p), bool), w.ends - w.starts
    size = end - begin - p
    done, i = np.cumsum(size), 0
    while i < len(p):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + step, side="right")))
        run = np.repeat(np.arange(i, j), size[i:j])
        a = begin[run] + np.arange(len(run)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j])
        b = a + p[run]
        fits = sizes[a] == sizes[b]
        true[run[~fits]] = False
        run, a, b = run[fits], a[fits], b[fits]
        differ = ragged(w.buf, w.starts[a], sizes[a]) != ragged(w.buf, w.starts[b], sizes[a])
        true[np.repeat(run, sizes[a])[differ]] = False
        i = j
    return true


def plain_stretches(words: list[bytes]) -> list[tuple[int, int, int]]:
    """As stretches() of one document, by comparing words; only where hashes of different words were equal."""
    known: dict[bytes, int] = {}
    ids, best = np.array([known.setdefault(x, len(known)) for x in words], np.int64), {}
    for p in range(1, len(ids) // TIMES + 1):
        edge = np.diff(np.concatenate(([0], ids[:-p] == ids[p:], [0])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a + p >= max(SHORTEST, TIMES * p):
                best.setdefault((a, b + p), p)
    return sorted((a, b, p) for (a, b), p in best.items())


def _slice_runs(buf: np.ndarray, offsets: np.ndarray, points: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    w = Words(buf, offsets)
    begin, end, p = stretches(w.hashes(), w.ptr, points)
    true = same_words(w, begin, end, p)
    if not true.all():
        wrong = np.unique(np.searchsorted(w.ptr, begin[~true], side="right") - 1)
        good = ~np.isin(np.searchsorted(w.ptr, begin, side="right") - 1, wrong)
        more = [np.stack([begin[good], end[good], p[good]])]
        for d in wrong.tolist():
            own = plain_stretches([buf[a:b].tobytes() for a, b in zip(w.starts[w.ptr[d] : w.ptr[d + 1]], w.ends[w.ptr[d] : w.ptr[d + 1]], strict=True)])
            more.append(np.array(own, np.int64).reshape(-1, 3).T + np.array([[w.ptr[d]], [w.ptr[d]], [0]]))
        begin, end, p = np.concatenate(more, axis=1)
        order = np.lexsort((p, begin))
        begin, end, p = begin[order], end[order], p[order]
    return w, begin, end, p


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and the collapsed text of each row.

    Of each run only the first period stays; the words that are kept are joined by
    one space. Null and empty texts have no words, no runs and an empty collapsed
    text. Very long texts are read whole, with at most `points` grid points at a
    time. Repeated and null ids each get a row; equal rows get equal results. An
    empty table gives no rows. Extra columns are not read.
    """

    def whole(ids, buf, offsets):
        w, begin, end, p = _slice_runs(buf, offsets, points)
        n = len(w.starts)
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, begin + p, 1)
        np.add.at(gone, end, -1)
        kept = np.flatnonzero(np.cumsum(gone[:n]) <= 0)
        sizes = (w.ends - w.starts)[kept] + 1
        text = ragged(np.append(buf, np.uint8(32)), w.starts[kept], sizes)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        text[edge[1:] - 1] = 32
        at = edge[np.searchsorted(kept, w.ptr)]
        texts = [text[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        of = np.searchsorted(begin, w.ptr)
        doc = np.searchsorted(w.ptr, begin, side="right") - 1
        rows = pa.StructArray.from_arrays([pa.array(x) for x in (begin - w.ptr[doc], end - begin, p)], ["start", "length", "period"])
        return {"doc_id": ids, "n_words": pa.array(np.diff(w.ptr)), "runs": pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), rows), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())}

    return B.map_documents(B.documents(docs, id_col, text_col), whole, SCHEMA)


def strongest_run(runs: str = "runs"):
    """The run of greatest length / period, compared as whole numbers; ties go to the smallest start, then period. Null without a run."""
    better = F.expr(f"aggregate({runs}, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))")
    return better
