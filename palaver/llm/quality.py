"""Quality classifier: naive Bayes features under a linear support vector machine.

Method: n-gram indicators are scaled by the log ratio of their class-wise counts
(naive Bayes), and a linear hinge-loss model over the scaled indicators is fitted
by dual coordinate descent. The fit uses a bounded sample of labelled rows
(BOUND of each class), so that it costs the same at any corpus size; scores cover
every text, one at a time, with a model of 2**BITS numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .labelled import held_out, sample, shape_ngrams

BITS = 18
#: Labelled rows of each class that the model is fitted on, at most.
BOUND = 3000


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    p, q = np.ones(width), np.ones(width)
    for r, c in zip(rows, y, strict=True):
        (p if c > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (and a bias, last) that minimise |w|^2/2 + sum cost * hinge, one dual variable at a time."""
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
                w[r] += step * v
                w[-1] += step
        if moved < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities, by Newton's method."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - t) * margin).sum() + 0.01 * (a - 1), (weight * (p - t)).sum() + 0.01 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 0.01, (s * margin).sum()], [(s * margin).sum(), s.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, bound: int = BOUND) -> tuple[np.ndarray, float]:
    """Per-indicator weights and a bias, on the scale of log odds. Without examples of both classes: the share of label 1."""

    def features(ids, buf, offsets):
        f, at = shape_ngrams(buf, offsets, BITS)
        return {"doc_id": ids, "f": pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())}

    got, counts = sample(docs, labels, label, modulus, rest, bound, features, "doc_id long, f binary")
    rows, y = [np.frombuffer(r["f"], np.int32) for r in got], np.array([1 if r["y"] else -1 for r in got])
    n = {c: max(1, int((y == c).sum())) for c in (-1, 1)}
    if not len(y) or len(set(y.tolist())) < 2:
        return np.zeros(1 << BITS), float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    ratio = log_count_ratios(rows, y, 1 << BITS)
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    cost = np.where(y > 0, len(y) / (2 * n[1]), len(y) / (2 * n[-1]))
    fold = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):  # margins of rows that a fit hasn't seen, for the curve to probabilities
        own = np.flatnonzero(fold != k)
        w = dual_coordinate_descent([rows[i] for i in own], [values[i] for i in own], y[own], cost[own], 1 << BITS)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]] @ values[i] + w[-1]
    a, b = _platt(margin, y, np.where(y > 0, counts.get(1, 1) / n[1], counts.get(0, 1) / n[-1]))
    w = dual_coordinate_descent(rows, values, y, cost, 1 << BITS)
    return a * w[:-1] * ratio, a * w[-1] + b


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, rest: int = 1, threshold: float = 0.5, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, held_out, score (the probability of label 1) and predicted for every row.

    Rows with crc32(id as text) mod modulus = rest are held out of the fit. Null
    texts count as empty, and an empty text gets the model's bias as score.
    Scores depend on the text alone, so repeated texts tie. Extra columns are not read.
    row_col: a key of rows (long); the result then has it as row, with score and predicted.
    """
    own = B.documents(docs, id_col, text_col)
    w, bias = fit(own, labels, label, modulus, rest, bound)
    w = w.astype(np.float32)

    def score(ids, buf, offsets):
        f, at = shape_ngrams(buf, offsets, BITS)
        run = np.concatenate(([0.0], np.cumsum(w[f], dtype=np.float64)))
        n = np.diff(at)
        odds = (run[at[1:]] - run[at[:-1]]) / np.sqrt(np.maximum(n, 1)) + bias
        return {"doc_id": ids, "score": pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))))}

    if row_col:
        rows = B.map_documents(B.documents(docs, row_col, text_col), score, "doc_id long, score double")
        return rows.select(F.col("doc_id").alias("row"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    scored = B.map_documents(own, score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
