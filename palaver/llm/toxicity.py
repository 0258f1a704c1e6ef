"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Method: a bounded sample of labelled examples is indexed by an inverted index
over all their terms. Postings lie in blocks of examples; each (term, block) has
its largest weight, so the sum of query weight times block maximum bounds every
cosine in the block. Lists of terms that many examples share are held as rows of
all examples, whose part of the cosine is computed for many texts at once; lists
with few examples in a block are read whole, as their maxima are about as many
as their postings. The bound takes the true maximum of both parts in the block.
The blocks of highest bound are read first, then those whose
bound can still beat the k-th best: the k nearest are exact. Their votes, weighted
by cosine, become a calibrated score; the examples themselves are the evidence.

Terms are words and word beginnings in lower case; their document frequencies are
those of the whole corpus. Vectors hold every term that an example has. By plain
TF-IDF the topic of a text can hide a few offensive words, so some of the terms
that say most about the label in the sample may weigh a multiple of their TF-IDF.
Which weighting, how many neighbours and what weight of the base rate is decided
by the labelled sample itself: each half is scored by the other. Terms
without an example meet no posting and only scale all cosines of a text alike;
they are left out of its norm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .labelled import held_out, sample
from .textcore import U64, Words, hash_spans, mix

#: Labelled examples of each class in the index.
BOUND = 1500
#: Weightings that are compared, plain TF-IDF first: how many terms weigh more, and how much.
WEIGHTINGS = ((0, 1.0), (128, 4.0), (128, 16.0), (384, 4.0), (384, 16.0), (1024, 4.0), (1024, 16.0))
#: Votes that are compared: neighbours, and what the base rate weighs beside their squared cosines.
VOTES = ((15, 0.25), (5, 0.25), (31, 0.25), (5, 1.0), (15, 1.0), (31, 1.0))
#: Examples in a block, blocks read first.
BLOCK, LEAD = 32, 4
#: A term in more than this share of the examples has its weights in a row of all examples.
COMMON = 0.1
#: Lists of fewer postings than this for each of their blocks are read whole.
SPARSE = 2
_BEGIN = 5


def term_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term, count of all (document, term) of a slice."""
    words = Words(buf, offsets)
    ends = words.ends.copy()
    while len(ends):  # punctuation after a word is no part of a term
        tail = np.isin(buf[ends - 1], np.frombuffer(b".,;:!?\"')", np.uint8)) & (ends - words.starts > 1)
        if not tail.any():
            break
        ends -= tail
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.ptr)).astype(U64)
    long = np.flatnonzero(ends - words.starts > _BEGIN)
    whole = hash_spans(buf, words.starts, ends, lower=True)
    begin = mix(hash_spans(buf, words.starts[long], words.starts[long] + _BEGIN, lower=True) + U64(5))
    pair = np.concatenate([whole, begin])
    both = np.concatenate([owner, owner[long]])
    order = np.argsort(pair)  # then by document; short numbers are sorted by their digits
    order = order[np.argsort(both[order].astype(np.uint16 if len(offsets) <= 1 << 16 else np.int64), kind="stable")]
    pair, both = pair[order], both[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (both[1:] != both[:-1])
    at = np.flatnonzero(new)
    return both[at].astype(np.int64), pair[at], np.diff(np.append(at, len(pair)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def fit_line(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[float, float]:
    """Log odds of label 1 as a line of x, for rows that weigh own; the slope stays near 1 where rows are few."""
    line, design = np.array([0.0, 1.0]), np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        slope = design.T @ (own * (p - y)) + (line - [0.0, 1.0])
        step = np.linalg.solve(design.T @ (design * (own * p * (1 - p))[:, None]) + np.eye(2), slope)
        line = line - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(line[0]), max(0.1, float(line[1]))


def as_in_corpus(y: np.ndarray, base: float) -> np.ndarray:
    """What each example weighs, so that both classes weigh as in the corpus."""
    n1 = int(y.sum())
    return len(y) * np.where(y == 1, base / n1, (1 - base) / (len(y) - n1))


class Index:
    """Postings of the examples' unit vectors, by term and block, with the block maxima.

    frequencies(terms): in how many documents of the corpus each of the sorted terms
    stands, and how many documents there are. base: the share of label 1 among all
    labelled rows.
    """

    def __init__(self, ids: np.ndarray, y: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], frequencies: Callable, base: float, telling: int = 0, boost: float = 1.0, k: int = 15, prior: float = 0.25, calibrated: bool = True):
        n, sizes = len(docs), np.array([len(d[0]) for d in docs], np.int64)
        flat = np.concatenate([d[0] for d in docs]) if n else np.zeros(0, U64)
        count = np.concatenate([d[1] for d in docs]) if n else np.zeros(0)
        owner = np.repeat(np.arange(n), sizes)
        self.terms, term = np.unique(flat, return_inverse=True)
        df, total = frequencies(self.terms)
        self.weight = np.log((total + 1) / (np.minimum(df, total) + 0.5)) * np.where(self._telling(term, y[owner], y, telling), boost, 1.0)
        w = (1 + np.log(count)) * self.weight[term]
        w /= np.sqrt(np.maximum(np.bincount(owner, w * w, minlength=n), 1e-300))[owner]
        # examples with the same strongest term lie together, so that the maxima of blocks are close bounds
        strong = np.zeros(n, np.int64)
        at = np.lexsort((w, owner))
        last = np.append(owner[at][1:] != owner[at][:-1], True)[: len(at)]
        strong[owner[at][last]] = term[at][last]
        order = np.lexsort((ids, strong))
        self.ids, self.y = ids[order], y[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        row = place[owner]
        self.blocks = max(1, -(-n // BLOCK))
        often = np.bincount(term, minlength=len(self.terms)) > COMMON * n
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK))
        self.dense[self.common[term[often[term]]], row[often[term]]] = w[often[term]]
        self.vectors = [(term[a:b], w[a:b]) for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]
        at = np.lexsort((row, term))
        at = at[~often[term[at]]]
        self.row, self.w, term = row[at], w[at], term[at]
        key = term * self.blocks + self.row // BLOCK
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        self.start, self.size = start, np.diff(np.append(start, len(key)))
        self.block, self.most = key[start] % self.blocks, np.maximum.reduceat(self.w, start) if len(start) else self.w
        self.first = np.searchsorted(key[start] // self.blocks, np.arange(len(self.terms) + 1))
        self.list = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.whole = np.diff(self.list) < SPARSE * np.diff(self.first)
        self.empty, self.line, self.k, self.prior = float(base), (0.0, 1.0), k, prior
        if calibrated:
            self._calibrate([self.vectors[i] for i in order])
        del self.vectors

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Log odds of label 1 as a line of the vote's log odds, from votes on each example by all the others."""
        n = len(self.ids)
        if int(self.y.sum()) in (0, n):
            return
        x = np.empty(n)
        for i, (near, cos) in enumerate(self.nearest_of(vectors, self.k + 1)):
            x[i] = self.odds(near[near != i][: self.k], cos[near != i][: self.k], self.prior)
        self.line = fit_line(x, self.y, as_in_corpus(self.y, self.empty))

    def odds(self, near: np.ndarray, cos: np.ndarray, prior: float) -> float:
        """Log odds of the neighbours' votes by squared cosine, beside which the base rate weighs prior."""
        weight = cos**2
        vote = ((weight * self.y[near]).sum() + prior * self.empty) / (weight.sum() + prior)
        return float(np.log(vote / (1 - vote)))

    def _telling(self, term, of_term, y, most):
        """Which terms say most about the label: in three examples at least, and in one class far oftener."""
        pos, neg = (np.bincount(term[of_term == c], minlength=len(self.terms)) for c in (1, 0))
        ratio = np.abs(np.log((pos + 0.5) / (max(1, (y == 1).sum()) + 1)) - np.log((neg + 0.5) / (max(1, (y == 0).sum()) + 1)))
        gain = np.where((pos + neg >= 3) & (ratio > 1.5), ratio * np.sqrt(pos + neg), 0)
        chosen = np.zeros(len(self.terms), bool)
        chosen[np.argsort(-gain, kind="stable")[:most]] = True
        return chosen & (gain > 0)

    def query(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the indexed ones among sorted terms, and their weights in the text's unit vector."""
        at = np.searchsorted(self.terms, terms)
        hit = np.flatnonzero(at < len(self.terms))
        hit = hit[self.terms[at[hit]] == terms[hit]]
        own = (1 + np.log(counts[hit])) * self.weight[at[hit]]
        return at[hit], own / np.sqrt(max(own @ own, 1e-300))

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector the at most k examples of largest cosine above 0 (ties: smaller id), and the cosines; exact."""
        for begin in range(0, len(vectors), 256):
            some = vectors[begin : begin + 256]
            query = np.zeros((len(some), len(self.dense)))
            for i, (at, own) in enumerate(some):
                row = self.common[at]
                query[i, row[row >= 0]] = own[row >= 0]
            for (at, own), part in zip(some, query @ self.dense, strict=True):
                rare = self.common[at] < 0
                yield self._nearest(at[rare], own[rare], part, k)

    def _nearest(self, at: np.ndarray, own: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest by the sum of part, of each example, and the rare terms' postings."""
        whole = self.whole[at]
        lists = at[whole]
        lengths = self.list[lists + 1] - self.list[lists]
        posting = ranges(self.list[lists], lengths)
        part = part + np.bincount(self.row.take(posting), self.w.take(posting) * np.repeat(own[whole], lengths), minlength=len(part))
        at, own = at[~whole], own[~whole]
        lengths = self.first[at + 1] - self.first[at]
        entry, weight = ranges(self.first[at], lengths), np.repeat(own, lengths)
        block, by_block = self.block.take(entry), part.reshape(self.blocks, BLOCK)
        bound = by_block.max(axis=1) + np.bincount(block, weight * self.most.take(entry), minlength=self.blocks)
        read = np.zeros(self.blocks, bool)
        read[np.argsort(-bound, kind="stable")[:LEAD]] = True
        scores = self._in_blocks(read, block, entry, weight, by_block)
        more = ~read & (bound > self._kth(scores, read, k) - 1e-9)
        if 2 * np.count_nonzero(more) > self.blocks:  # the lists are read as they lie
            lengths = self.list[at + 1] - self.list[at]
            posting = ranges(self.list[at], lengths)
            scores = part + np.bincount(self.row.take(posting), self.w.take(posting) * np.repeat(own, lengths), minlength=len(part))
            read[:] = True
        elif more.any():
            scores += self._in_blocks(more, block, entry, weight, by_block)
            read |= more
        least = self._kth(scores, read, k)
        found = np.flatnonzero((scores > 0) & (scores > least - 1e-11))
        best = found[np.lexsort((self.ids[found], -np.round(scores[found], 12)))[:k]]
        return best, scores[best]

    def _in_blocks(self, new: np.ndarray, block: np.ndarray, entry: np.ndarray, weight: np.ndarray, by_block: np.ndarray) -> np.ndarray:
        """The cosines of all examples in some blocks, 0 elsewhere."""
        some = np.flatnonzero(new.take(block))
        use = entry.take(some)
        sizes = self.size.take(use)
        posting = ranges(self.start.take(use), sizes)
        out = np.bincount(self.row.take(posting), self.w.take(posting) * np.repeat(weight.take(some), sizes), minlength=by_block.size).astype(float)
        out.reshape(by_block.shape)[new] += by_block[new]
        return out

    def _kth(self, scores: np.ndarray, read: np.ndarray, k: int) -> float:
        """The k-th best of the scores in the blocks that were read, 0 if they are fewer."""
        known = scores.reshape(self.blocks, BLOCK)[read].ravel()
        return float(np.partition(known, -k)[-k]) if len(known) >= k else 0.0

    def score_all(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        """The probability of label 1 and the ids of the nearest examples, for each text's terms and counts."""
        out = []
        for near, cos in self.nearest_of([self.query(*t) for t in texts], self.k):
            odds = self.line[0] + self.line[1] * self.odds(near, cos, self.prior)
            out.append((float(1 / (1 + np.exp(-odds))) if len(near) else self.empty, self.ids[near]))
        return out


def choose(ids: np.ndarray, y: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], frequencies: Callable, base: float) -> dict:
    """telling, boost, k and prior of the smallest log loss when each half of the examples is scored by an index of the other half.

    Terms are picked from the indexed half alone, so that no example's own label
    speaks for it. The first listed counts where losses are equal, and where a
    half lacks a class.
    """
    half = (mix(ids.astype(np.int64).view(U64)) & U64(1)).astype(np.int64)
    names = ("telling", "boost", "k", "prior")
    if any(len(np.unique(y[half == h])) < 2 for h in (0, 1)):
        return dict(zip(names, (*WEIGHTINGS[0], *VOTES[0]), strict=True))
    own, most, found = as_in_corpus(y, base), max(k for k, _ in VOTES), []
    for telling, boost in WEIGHTINGS:
        x = np.empty((len(VOTES), len(ids)))
        for h in (0, 1):
            fit, ask = np.flatnonzero(half == h), np.flatnonzero(half != h)
            index = Index(ids[fit], y[fit], [docs[i] for i in fit], frequencies, base, telling, boost, calibrated=False)
            for i, (near, cos) in zip(ask, index.nearest_of([index.query(*docs[i]) for i in ask], most), strict=True):
                x[:, i] = [index.odds(near[:k], cos[:k], prior) for k, prior in VOTES]
        for vote, odds in zip(VOTES, x, strict=True):
            line = fit_line(odds, y, own)
            z = np.where(y == 1, 1, -1) * (line[0] + line[1] * odds)
            found.append((round(float(own @ np.logaddexp(0, -z)) / len(y), 9), len(found), (telling, boost, *vote)))
    return dict(zip(names, min(found)[2], strict=True))


def document_frequencies(own: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each of the sorted terms stands, and the number of documents."""

    def count(ids, buf, offsets):
        term = term_counts(buf, offsets)[1]
        at = np.searchsorted(terms, term)
        at = at[at < len(terms)][terms[at[at < len(terms)]] == term[at < len(terms)]]
        n = np.append(np.bincount(at, minlength=len(terms)), len(ids))
        some = np.flatnonzero(n)
        return {"term": some.astype(np.int32), "n": n[some]}

    got = B.map_documents(own, count, "term int, n long", slice_bytes=8 << 20).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def build_index(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, bound: int = BOUND) -> Index:
    def features(ids, buf, offsets):
        owner, term, count = term_counts(buf, offsets)
        edge = np.searchsorted(owner, np.arange(len(ids) + 1))
        cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
        return {"doc_id": ids, "t": cut(term), "c": cut(count.astype(np.int32))}

    rows, counts = sample(docs, labels, label, modulus, rest, bound, features, "doc_id long, t binary, c binary")
    base = (counts.get(1, 0) + 0.02) / (sum(counts.values()) + 1)
    examples = [(np.frombuffer(r["t"], U64), np.frombuffer(r["c"], np.int32)) for r in rows]
    every = np.unique(np.concatenate([t for t, _ in examples])) if examples else np.zeros(0, U64)
    df, total = document_frequencies(docs, every)
    known = lambda terms: (df[np.searchsorted(every, terms)], total)
    ids, y = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["y"] for r in rows], np.int64)
    return Index(ids, y, examples, known, base, **choose(ids, y, examples, known, base))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, rest: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (the probability of label 1), predicted, evidence (ids of the nearest examples).

    Rows with crc32(id as text) mod modulus = rest are held out of the index. A
    null or empty text has no terms and gets the base rate. Whole texts of any length count. Equal cosines go to the smaller example id.
    Repeated rows each get a row; extra columns are not read.
    """
    own = B.documents(docs, id_col, text_col)
    index = build_index(own, labels, label, modulus, rest)

    def score(ids, buf, offsets):
        owner, term, count = term_counts(buf, offsets)
        edge = np.searchsorted(owner, np.arange(len(ids) + 1))
        got = index.score_all([(term[a:b], count[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)])
        return {"doc_id": ids, "score": pa.array([g[0] for g in got], pa.float64()), "evidence": pa.array([g[1] for g in got], pa.list_(pa.int64()))}

    scored = B.map_documents(own, score, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
