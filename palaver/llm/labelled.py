"""Bounded labelled samples for the classifiers, and features of single texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textcore import U64, Words, mix

_UPPER, _LOWER, _DIGIT, _BANG, _SIGN, _BAR, _STOP, _OTHER = (1 << i for i in range(8))
_SHAPE = np.full(256, _LOWER, np.uint8)
_SHAPE[:128] = _OTHER
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 0
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = _UPPER, _LOWER, _DIGIT
_SHAPE[33], _SHAPE[124] = _BANG, _BAR
_SHAPE[[ord(c) for c in "#*$%&<>"]] = _SIGN
_SHAPE[[ord(c) for c in ".,;:?"]] = _STOP


def held_out(doc_id, modulus: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, bound: int, of, schema: str) -> tuple[list, dict[int, int]]:
    """Features of at most `bound` labelled rows of each class that aren't held out, and how many rows each class has.

    Rows are taken by a hash of their id, evenly over the corpus. Labels that are
    null, and ids that have none or several different ones, are left out. Of rows
    with one id the text with the smallest hash counts, so that reruns agree.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(known["doc_id"], modulus, rest)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))
    one = docs.join(picked.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = B.map_documents(one, of, schema).join(picked, "doc_id").orderBy("doc_id").collect()
    return rows, counts


def unique_per_document(features: list[tuple[np.ndarray, np.ndarray]], docs: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of every document as one array, and where each document's begin."""
    key = np.concatenate([(owner.astype(U64) << U64(bits)) | f for owner, f in features]) if features else np.zeros(0, U64)
    key = np.unique(key)
    return (key & U64((1 << bits) - 1)).astype(np.int64), np.searchsorted(key, np.arange(docs + 1).astype(U64) << U64(bits))


def shape_ngrams(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indicators of each text: words and pairs of words in lower case; runs of 1 to 3 word shapes.

    A shape says which kinds of characters a word has and whether it equals the word before.
    """
    words = Words(buf, offsets)
    n = len(words.starts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.ptr))
    if not n:
        return unique_per_document([], len(offsets) - 1, bits)
    h = words.hashes(lower=True)
    shape = np.bitwise_or.reduceat(_SHAPE[buf], words.starts).astype(U64)
    shape[1:] |= ((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])).astype(U64) << U64(8)
    shape += U64(1)
    down, out = U64(64 - bits), []
    for k in (1, 2, 3):
        at = np.flatnonzero(owner[k - 1 :] == owner[: n - k + 1])
        code = np.zeros(len(at), U64)
        for j in range(k):
            code = code * U64(1024) + shape[at + j]
        out.append((owner[at], mix(code + U64(k << 40)) >> down))
        if k < 3:
            run = h[at] if k == 1 else mix(h[at] * U64(3) + h[at + 1])
            out.append((owner[at], run >> down))
    return unique_per_document(out, len(offsets) - 1, bits)
