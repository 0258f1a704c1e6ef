"""Approximate nearest neighbours by a forest of hash prefixes.

Method: each tree gives every vector a long string of hash bits (signs of random
projections) and keeps the strings in a sorted array. A query descends in every
tree to its longest matching prefix, and then all trees ascend together, one bit
at a time, until they hold enough candidates between them. Candidates are
ranked by exact inner products.

Vectors are dealt into blocks by a hash of their id; each block has its own
forest, queries are sent in packs to all blocks (a stated query set against all
rows, in blocks), and the best of all blocks are merged. The share of a block
that is ranked stays the same at any size, and so does recall. To rank by inner
product, vectors get one more component that makes all norms equal, and queries
a zero there: angles then order as inner products do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trees, bits of a string, vectors in a block, queries in a pack, share of a block that a query ranks at least.
TREES, BITS, BLOCK, PACK, SHARE = 48, 32, 4096, 256, 0.7
#: Part of the candidates that were reckoned with that trees must really hold between them.
ENOUGH = 0.9


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector of finite numbers that isn't zero, as doubles."""
    v = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad).where(F.exists("v", lambda x: x != 0))


def strings(x: np.ndarray, most: float, trees: int, bits: int, seed: int = 17) -> np.ndarray:
    """(trees, rows) hash strings as integers; rows are extended to the norm `most` first (0: queries, whose last component is 0)."""
    rest = np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))
    full = np.column_stack([x, rest])
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((full.shape[1], trees * bits))
    sign = (full @ planes > 0).reshape(len(x), trees, bits)
    return (sign.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=2).T


class Forest:
    def __init__(self, x: np.ndarray, most: float, trees: int = TREES, bits: int = BITS):
        self.bits, self.n = bits, len(x)
        keys = strings(x, most, trees, bits)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def candidates(self, keys: np.ndarray, want: int):
        """For each query (column of keys) the rows that its trees hold at the deepest common level with `want` of them."""
        trees, q = keys.shape
        level, lo, hi = np.zeros(q, int), np.zeros((trees, q), int), np.full((trees, q), self.n)
        live = np.arange(q)
        for depth in range(1, self.bits + 1):
            shift = np.uint64(self.bits - depth)
            prefix = (keys[:, live] >> shift) << shift
            a = np.stack([np.searchsorted(k, p) for k, p in zip(self.keys, prefix, strict=True)])
            b = np.stack([np.searchsorted(k, p + (np.uint64(1) << shift)) for k, p in zip(self.keys, prefix, strict=True)])
            # of n rows, trees that each hold a part p hold about n (1 - (1 - p)**trees) different ones
            different = self.n * (1 - np.prod(1 - (b - a) / self.n, axis=0))
            deep = different >= want
            live = live[deep]
            if not len(live):
                break
            level[live], lo[:, live], hi[:, live] = depth, a[:, deep], b[:, deep]
        for i in range(q):
            depth, low, high = level[i], lo[:, i], hi[:, i]
            while True:
                held = np.full(self.n, depth == 0)
                for t in range(trees if depth else 0):
                    held[self.order[t, low[t] : high[t]]] = True
                if depth == 0 or held.sum() >= ENOUGH * want:
                    break
                # trees of much the same rows hold fewer than reckoned: all ascend further
                depth -= 1
                shift = np.uint64(self.bits - depth)
                prefix = (keys[:, i] >> shift) << shift
                low = [np.searchsorted(k, p) for k, p in zip(self.keys, prefix, strict=True)]
                high = [np.searchsorted(k, p + (np.uint64(1) << shift)) for k, p in zip(self.keys, prefix, strict=True)]
            yield np.flatnonzero(held)


def nearest_neighbours(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each id divisible by `every`.

    Ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of another length than a query's
    are no candidates of it. Rows with a null id take no part; of rows with the same id
    and vector one counts. Equal vectors are kept once in a block with their k + 1 smallest
    ids, which loses nothing: no more of them can be among k. Extra columns are not read.
    """
    rows = clean_vectors(table, id_col, vector_col).withColumn("d", F.size("v"))
    total = rows.count()
    norms = rows.groupBy("d").agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("most")).withColumnRenamed("d", "length")
    blocks = max(1, math.ceil(total / BLOCK))
    dealt = lambda df, key, n: df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    held = dealt(rows.distinct(), "v", blocks * 4).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    # the same vector is in one part, whose copies are cut to k + 1 ids before they meet
    least = Window.partitionBy("part", "d", "v", "salt").orderBy("vec_id")
    slim = held.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    slim = slim.groupBy("part", "d", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")).withColumn("block", (F.col("part") / 4).cast("int")).join(F.broadcast(norms), F.col("d") == F.col("length"))
    # new column ids: both sides of the cogroup come from rows
    slim = slim.select(*(F.col(c).alias(c) for c in ("block", "d", "v", "ids", "most")))
    asked = dealt(rows.where(F.pmod("vec_id", F.lit(every)) == 0), "vec_id", max(1, math.ceil(total / every / PACK)))
    packs = asked.groupBy("part", "d").agg(F.collect_list(F.struct("vec_id", "v")).alias("q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        dims = np.array(vectors.column("d").to_pylist(), int)
        for d in sorted(set(dims.tolist()) & set(queries.column("d").to_pylist())):
            own = vectors.filter(pa.array(dims == d))
            x = np.array(own.column("v").to_pylist(), float).reshape(-1, d)
            ids = own.column("ids").to_pylist()
            forest = Forest(x, own.column("most")[0].as_py())
            want = max(4 * k, math.ceil(share * len(x)))
            for pack in queries.filter(pa.compute.equal(queries.column("d"), d)).column("q"):
                q = pack.as_py()
                y = np.array([z["v"] for z in q], float).reshape(-1, d)
                for i, rows_of in enumerate(forest.candidates(strings(y, 0.0, TREES, BITS), want)):
                    me, scores = q[i]["vec_id"], x[rows_of] @ y[i]
                    if len(scores) > k + 1:
                        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                        # what rounding can do grows with the products that are added up
                        keep = np.flatnonzero(scores >= least - 1e-12 * d * (abs(least) + np.abs(x[rows_of]).max() * np.abs(y[i]).max()))
                    else:
                        keep = np.arange(len(scores))
                    for j in keep:
                        exact = math.fsum(a * b for a, b in zip(x[rows_of[j]].tolist(), y[i].tolist(), strict=True))
                        for other in ids[rows_of[j]]:
                            if other != me:
                                out["query_id"].append(me)
                                out["vec_id"].append(other)
                                out["score"].append(exact)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = slim.groupBy("block").cogroup(packs.groupBy("block")).applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
