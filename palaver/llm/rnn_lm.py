"""Language model scoring with a gated recurrent network and smoothed counts.

Method: a gated recurrent unit reads each document word by word; its state is
carried from window to window, so that a document's score is the likelihood of
all of it. The output is factored: a class of words first, then the word within
its class. Weights are fitted by truncated backpropagation in numpy.

Everything is learned from all training documents. Their counts give the base
score, the vocabulary, the output biases, and the share of "unknown" that a word
outside the vocabulary gets. The recurrent weights are fitted in rounds, each on
another part of the documents, together all of them once: every partition trains
on from the weights of the round before, and the new weights are averaged in Spark
by the tokens that each partition read. The vocabulary grows with the cube root
of the text. A small corpus is gone through several times, so that the model makes
a least number of steps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .labelled import held_out
from .textcore import U64, Words

#: Least classes and words in a class, units, documents of the first round (which takes a sixteenth at least).
CLASSES, WIDTH, UNITS, SAMPLE_DOCS = 32, 32, 16, 1200
UNKNOWN, END = 0, 1
#: Rates of the rounds, and weights in a row of the averages.
RATES, CHUNK = (0.01, 0.01, 0.006, 0.003), 1 << 16
#: Tokens that training goes through at least, by passes over each round's documents, and passes at most.
LEAST_TOKENS, MOST_PASSES = 6_000_000, 24
_END_KEY = np.array([0x5DEECE66D1234567], U64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def classes_of(text_bytes: int) -> int:
    """Classes, and words in each, for so much text: three times the cube root of its words make the vocabulary."""
    return max(CLASSES, math.ceil(math.sqrt(3 * (text_bytes / 6) ** (1 / 3))))


class Model:
    """Weights: input rows per word, recurrent matrix, class and word outputs with biases."""

    def __init__(self, counts: np.ndarray, units: int = UNITS, seed: int = 3):
        rng, v = np.random.default_rng(seed), len(counts)
        self.width = math.isqrt(v)
        share = (counts + 0.5).reshape(-1, self.width)
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "x": f(v, 3 * units), "u": f(units, 3 * units), "c": f(units, len(share)), "w": f(len(share), units, self.width),
            "bc": np.log(share.sum(axis=1) / share.sum()).astype(np.float32), "bw": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
        }
        self.units, self.seen = units, 0
        self.m1, self.m2, self.t = None, None, 0

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k], at = flat[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size

    def step(self, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.units
        x, u = self.p["x"][word], h @ self.p["u"]
        gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
        return new + z * (h - new), z, r, new, u[:, 2 * n :]

    def outputs(self, s: np.ndarray, target: np.ndarray, grad: dict | None = None, weight: np.ndarray | None = None):
        """Log probability of each target; with grad, also adds gradients and returns that of the states."""
        cls, within = target // self.width, target % self.width
        logits = s @ self.p["c"] + self.p["bc"]
        logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(s))
        said = logits[rows, cls]
        d = np.exp(logits, out=logits)
        total = d.sum(axis=1)
        said -= np.log(total)
        back = None
        if grad is not None:
            d /= total[:, None]
            d[rows, cls] -= 1
            d *= weight[:, None]
            grad["c"] += s.T @ d
            grad["bc"] += d.sum(axis=0)
            back = d @ self.p["c"].T
        # states of one class stand together, so that each class works on a slice
        order = np.argsort(cls.astype(np.uint16) if len(self.p["w"]) < 1 << 16 else cls, kind="stable")
        edge = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=len(self.p["w"])))))
        s, within, part = s[order], within[order], np.empty(len(s), said.dtype)
        if grad is not None:
            weight, more = weight[order, None], np.empty_like(back)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            at = slice(edge[k], edge[k + 1])
            own = s[at] @ self.p["w"][k] + self.p["bw"][k]
            own -= own.max(axis=1, keepdims=True)
            spot = (rows[: len(own)], within[at])
            part[at] = own[spot]
            d = np.exp(own, out=own)
            total = d.sum(axis=1)
            part[at] -= np.log(total)
            if grad is not None:
                d *= weight[at] / total[:, None]
                d[spot] -= weight[at, 0]
                grad["w"][k] += s[at].T @ d
                grad["bw"][k] += d.sum(axis=0)
                np.matmul(d, self.p["w"][k].T, out=more[at])
        said[order] += part
        if grad is not None:
            back[order] += more
        return said, back

    def fit(self, docs: list[np.ndarray], lanes: int = 768, window: int = 20, rate: float = 0.01, again: bool = False) -> None:
        """Truncated backpropagation: gradients run back through a window, the state runs on through the document.

        again: the documents were learned from before and don't count as seen anew.
        """
        stream = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        if not len(stream):
            return
        lanes = max(1, min(lanes, len(stream) // (12 * window)))
        steps = -(-len(stream) // lanes)
        real = (np.arange(steps * lanes) < len(stream)).reshape(lanes, steps).T
        target = np.append(stream, np.full(steps * lanes - len(stream), END)).reshape(lanes, steps).T
        before = np.vstack([np.full((1, lanes), END), target[:-1]])
        if self.m1 is None:
            self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        n, h = self.units, np.zeros((lanes, self.units), np.float32)
        for a in range(0, steps, window):
            b, kept = min(steps, a + window), []
            for i in range(a, b):
                h = h * (before[i] != END)[:, None].astype(np.float32)
                out = self.step(h, before[i])
                kept.append((h, *out))
                h = out[0]
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            states = np.concatenate([k[1] for k in kept])
            weight = real[a:b].ravel().astype(np.float32)
            _, back = self.outputs(states, target[a:b].ravel(), grad, weight / max(1.0, float(weight.sum())))
            back = back.reshape(b - a, lanes, n)
            dh, into = np.zeros((lanes, n), np.float32), np.empty((b - a, lanes, 3 * n), np.float32)
            for i in range(b - a - 1, -1, -1):
                prev, _, z, r, new, un = kept[i]
                dh = dh + back[i]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (prev - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                du = np.hstack([dz, dr, dnew * r])
                into[i, :, :n], into[i, :, n : 2 * n], into[i, :, 2 * n :] = dz, dr, dnew
                grad["u"] += prev.T @ du
                dh = dh * z + du @ self.p["u"].T
                dh *= (before[a + i] != END)[:, None]
            word = before[a:b].ravel()
            order = np.argsort(word.astype(np.uint16) if len(self.p["x"]) <= 1 << 16 else word, kind="stable")
            edge = np.flatnonzero(np.diff(word[order], prepend=-1))
            grad["x"][word[order[edge]]] = np.add.reduceat(into.reshape(-1, 3 * n)[order], edge)
            self.t, self.seen = self.t + 1, self.seen + (0 if again else int(weight.sum()))
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g *= min(1.0, 1.0 / max(size, 1e-9))
                self.m1[k] += 0.1 * (g - self.m1[k])
                self.m2[k] += 0.01 * (g * g - self.m2[k])
                self.p[k] -= rate * (self.m1[k] / (1 - 0.9**self.t)) / (np.sqrt(self.m2[k] / (1 - 0.99**self.t)) + 1e-6)

    def log_likelihood(self, tokens: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Natural log probability of each document tokens[ptr[i]:ptr[i+1]]; many documents advance together."""
        length = np.diff(ptr)
        order = np.argsort(-length, kind="stable")
        length, start = length[order], ptr[:-1][order]
        total, h, at = np.zeros(len(order)), np.zeros((len(order), self.units), np.float32), 0
        while len(length) and at < length[0]:
            live = int(np.searchsorted(-length, -at, side="left"))
            window = int(min(max(16, 65536 // max(1, live)), 2048, length[0] - at))
            states, targets, owners = [], [], []
            for t in range(at, at + window):
                n = int(np.searchsorted(-length[:live], -t, side="left"))
                word = tokens[start[:n] + t - 1] if t else np.full(n, END)
                h[:n] = self.step(h[:n], word)[0]
                states.append(h[:n].copy())
                targets.append(tokens[start[:n] + t])
                owners.append(n)
            said, _ = self.outputs(np.concatenate(states), np.concatenate(targets))
            owner = np.arange(sum(owners)) - np.repeat(np.cumsum(owners) - owners, owners)
            total += np.bincount(owner, weights=said, minlength=len(total))
            at += window
        out = np.empty(len(total))
        out[order] = total
        return out


def _trains(ids: pa.Array, modulus: int, rest: int) -> np.ndarray:
    return np.array([x is None or zlib.crc32(str(x).encode()) % modulus != rest for x in ids.to_pylist()], bool)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each document's words and its end, and where each document's begin."""
    words = Words(buf, offsets)
    return np.insert(words.hashes(lower=True), words.ptr[1:], np.repeat(_END_KEY, len(offsets) - 1)), words.ptr + np.arange(len(offsets))


def train(own: DataFrame, counts: np.ndarray, ids_of: Callable, first: int, modulus: int, rest: int, least: int = LEAST_TOKENS) -> Model:
    """A model of all documents that aren't held out; seen is the number of tokens that it learned from."""
    spark, model = own.sparkSession, Model(counts)
    passes = min(MOST_PASSES, max(1, math.ceil(least / max(1.0, counts.sum()))))
    own = own.where(~held_out(F.col("doc_id"), modulus, rest))
    begin = min(0.25, max(1 / 16, first / max(1, own.count())))
    edges = [0, *(round((begin + (1 - begin) * i / (len(RATES) - 1)) * 1024) for i in range(len(RATES)))]
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1024))

    def learn(weights, rate: float):
        def learn_from(local: Model, held: list[np.ndarray]) -> None:
            for i in range(passes):
                local.fit(held, rate=rate, again=i > 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local, held, size = Model(counts), [], 0
            local.load(weights.value)
            for batch in batches:
                lengths = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
                at = 0
                while at < batch.num_rows:
                    done = lengths[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(lengths, done + (2 << 20), side="right")))
                    held.append(ids_of(_tokens(*B.text_bytes_of(batch.column(1).slice(at, end - at)))[0]))
                    size, at = size + len(held[-1]), end
                    if size >= 250_000:
                        learn_from(local, held)
                        held, size = [], 0
            learn_from(local, held)
            flat = local.flat().astype(np.float64) * local.seen
            cut = range(0, len(flat), CHUNK) if local.seen else []
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // CHUNK for i in cut], pa.int32()), "seen": pa.array([local.seen] * len(cut), pa.int64()), "w": pa.array([flat[i : i + CHUNK].tobytes() for i in cut], pa.binary())})

        return run

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("w"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "seen": pa.array([pa.compute.sum(table.column("seen")).as_py()], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, seen long, w binary"
    for rate, low, high in zip(RATES, edges, edges[1:], strict=False):
        weights = spark.sparkContext.broadcast(model.flat())
        sums = own.where((part >= low) & (part < high)).mapInArrow(learn(weights, rate), schema).groupBy("chunk").applyInArrow(add, schema).collect()
        if sums:
            model.load(np.concatenate([np.frombuffer(r["w"]) / r["seen"] for r in sorted(sums, key=lambda r: r["chunk"])]))
            model.seen += sums[0]["seen"]
        weights.unpersist()
    return model


def score_texts(docs: DataFrame, modulus: int = 5, rest: int = 1, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row.

    Rows with crc32(id as text) mod modulus = rest are scored but never learned
    from. A null or empty text is its end alone. A row without id is learned from.
    Repeated rows count as often as they stand, and tie. An empty table gives no
    rows. Extra columns are not read.
    """
    own = B.documents(docs, id_col, text_col)
    blocks = B.Blocks(own, block_bytes=8 << 20)
    size = classes_of(blocks.bytes) ** 2

    def send(ids, buf, offsets):
        keys, ptr = _tokens(buf, offsets)
        return keys, np.repeat(_trains(ids, modulus, rest), np.diff(ptr)).astype(np.uint64)

    replies = B.stage_table(B.merged_counts(blocks, send, 64, None, top=size))

    def told(batches):
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_buffer(), np.int64)
                pairs = v[2:].reshape(-1, 2)
                n = len(pairs) + 1
                yield pa.RecordBatch.from_pydict({"key": pa.array([None, *pairs[:, 0].tolist()], pa.int64()), "n": pa.array([v[1], *pairs[:, 1].tolist()], pa.int64()), "kinds": pa.array([v[0]] + [0] * (n - 1), pa.int64())})

    totals = replies.where("block = -1").select("counts").mapInArrow(told, "key long, n long, kinds long")
    sums = totals.where("key is null").agg(F.sum("n").alias("n"), F.sum("kinds").alias("v")).first()
    all_tokens, kinds = int(sums["n"] or 0), int(sums["v"] or 0)
    most = totals.where("key is not null and n > 0").orderBy(F.desc("n"), "key").limit(size).collect()
    end_key = int(_END_KEY.view(np.int64)[0])
    ends = next((r["n"] for r in most if r["key"] == end_key), 0)
    words = [(r["key"], r["n"]) for r in most if r["key"] != end_key][: size - 2]
    inside = ends + sum(n for _, n in words)
    other, other_kinds = all_tokens - inside, max(0, kinds - len(words) - (ends > 0))
    counts = np.array([other, ends, *(n for _, n in words), *[0] * (size - 2 - len(words))], float)
    keys = np.array([end_key, *(k for k, _ in words)], np.int64).view(U64)
    by_key = np.argsort(keys)
    known, number = keys[by_key], np.array([END, *range(2, len(words) + 2)])[by_key]

    def ids_of(k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        return np.where(known[at] == k, number[at], UNKNOWN)

    model = train(own, counts, ids_of, sample_docs, modulus, rest)
    if model.seen != all_tokens:
        raise ValueError("the model learned from other tokens than were counted: the input gave other rows when read again")

    def score(ids, buf, offsets, got):
        k, ptr = _tokens(buf, offsets)
        c = B.counts_for(k, got, 64).astype(float)
        t = ids_of(k)
        base = np.log10((c + 0.5) / (all_tokens + 0.5 * (kinds + 1)))
        spelled = np.where(t == UNKNOWN, np.log((c + 0.5) / (other + 0.5 * (other_kinds + 1))), 0.0)
        add = lambda v: np.add.reduceat(v, ptr[:-1]) if len(ids) else np.zeros(0)
        total = (model.log_likelihood(t, ptr) + add(spelled)) / np.log(10)
        n = len(ids)
        return {"doc_id": ids, "n_tokens": pa.array(np.diff(ptr), pa.int64()), "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([all_tokens] * n, pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(total, pa.float64())}

    out = blocks.answer(replies, score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
