"""Substring dedup: remove words in passages that also stand earlier in the corpus.

Method: count-min prefilter. Every block of documents makes a partial sketch of
the windows it holds; fragments of the sketch are merged over all blocks and
overestimate how often a window occurs (never too low). A second pass takes only
windows that are estimated to repeat and groups them exactly, by 128 bits of
hash, to find each one's first occurrence. No repeated window is lost, and
windows that merely share a cell fall out in the second pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textcore import U64, Words, window_starts, windows

_NO_ID = np.iinfo(np.int64).min


def _windows(buf, offsets, k):
    words = Words(buf, offsets)
    starts = window_starts(words.ptr, k)
    h = words.hashes()
    return words, starts, windows(h, k)[starts] if len(starts) else h[:0]


def _order_keys(ids: pa.Array, ptr: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The id of each row, nulls as the least, and what orders rows of equal id: a given row key, or the place of rows without id."""
    own = ids.field(0) if pa.types.is_struct(ids.type) else ids
    doc = own.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    if own is not ids:
        return doc, ids.field(1).to_numpy(zero_copy_only=False)
    place = ((block >> 32) << 44) + ((block & (2**32 - 1)) << 22) + ptr[:-1]
    return doc, np.where(own.is_null().to_numpy(zero_copy_only=False), place, 0)


def _grouped(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours (else that of the input), and where a new one begins."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():  # two windows share one hash of 64 bits: the other tells them apart
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _after_first(doc: np.ndarray, tie: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each entry, whether its (doc, tie) is more than its group's least; groups begin where new is true."""
    if not len(doc):
        return np.zeros(0, bool)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    low = np.minimum.reduceat(doc, first)[group]
    least = np.minimum.reduceat(np.where(doc == low, tie, np.iinfo(np.int64).max), first)[group]
    return (doc > low) | (tie > least)


def _repeats(ids, buf, offsets, k, bits, counts, block):
    """Windows that may repeat, sorted by their two hashes: words, where each begins, where each distinct one's first stands
    in the arrays, the number of each one's group, which come later than an equal one of the block, hashes, ids and ties."""
    words, starts, h = _windows(buf, offsets, k)
    often = np.flatnonzero(B.counts_for(h, counts, bits) >= 2)
    h, at = h[often], starts[often]
    g = windows(words.hashes(kind=12), k, kind=12)[at] if len(at) else h
    doc, tie = _order_keys(ids, words.ptr, block)
    place = np.empty(len(doc), np.int64)
    place[np.lexsort((tie, doc))] = np.arange(len(doc))
    row = np.searchsorted(words.ptr, at, side="right") - 1
    if len(doc) > 1 and (np.diff(place) < 0).any():  # rows by (doc, tie), so that a stable sort puts the first before the rest
        order = np.argsort(place[row], kind="stable") if len(row) else row
        h, g, at, row = h[order], g[order], at[order], row[order]
    order, new = _grouped(h, g)
    h, g, at, row = h[order], g[order], at[order], row[order]
    doc, tie = (v[row] if len(row) else np.zeros(0, np.int64) for v in (doc, tie))
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    later = _after_first(doc, tie, new)
    later[1:] |= ~new[1:] & (row[1:] == row[:-1])
    return words, at, first, group, later, h, g, doc, tie


def repeated_spans(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, B.Blocks]:
    """The packed blocks, and replies that hold for each block which of its windows come later than an equal one."""
    own = B.documents(docs, id_col, text_col)
    if row_col:
        own = docs.select(F.struct(docs[id_col].cast("long").alias("doc_id"), docs[row_col].alias("row")).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    blocks = B.Blocks(own)
    bits, frags = B.sketch_bits(blocks.bytes // 6), blocks.frags
    estimates = B.merged_counts(blocks, lambda ids, buf, offsets: _windows(buf, offsets, k)[2], bits, cap=2)

    def send(ids, buf, offsets, got):
        block = next(iter(got.values()))["block"] if got else 0
        _, _, at, _, _, h, g, doc, tie = _repeats(ids, buf, offsets, k, bits, got, block)
        h, g, doc, tie = h[at], g[at], doc[at].view(U64), tie[at].view(U64)
        edge = B.cuts(h, frags, 64)
        full = [f for f in range(frags) if edge[f] < edge[f + 1]]
        part = lambda v, z: pa.array([z(v[edge[f] : edge[f + 1]]) for f in full], pa.binary())
        return {"block": pa.array([block] * len(full), pa.int64()), "frag": pa.array(full, pa.int32()), "h": part(h, B.zip_sorted), "g": part(g, B.zip_planes), "doc": part(doc, B.zip_planes), "tie": part(tie, B.zip_planes)}

    sent = blocks.answer(estimates, send, "block long, frag int, h binary, g binary, doc binary, tie binary")

    def first(table: pa.Table) -> pa.Table:
        parts = {c: [(B.unzip_sorted if c == "h" else B.unzip_planes)(x.as_buffer()) for x in table.column(c)] for c in ("h", "g", "doc", "tie")}
        sizes = [len(x) for x in parts["h"]]
        h, g = (np.concatenate(parts[c]) for c in ("h", "g"))
        doc, tie = (np.concatenate(parts[c]).view(np.int64) for c in ("doc", "tie"))
        order, new = _grouped(h, g)
        later = np.zeros(len(h), np.uint8)
        later[order] = _after_first(doc[order], tie[order], new)
        answers = [B.zip_planes(np.packbits(x)) for x in np.split(later, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table.column("block"), "frag": table.column("frag"), "counts": pa.array(answers, pa.binary()), "size": pa.array(sizes, pa.int64())})

    later = sent.groupBy("frag").applyInArrow(first, "block long, frag int, counts binary, size long")
    kinds = estimates.select("block", F.lit(0).alias("kind"), "frag", "counts", F.lit(0).cast("long").alias("size")).union(later.select("block", F.lit(1).alias("kind"), "frag", "counts", "size"))
    return blocks, kinds, bits


def covered_words(ids, buf, offsets, got, k, bits) -> tuple[Words, np.ndarray]:
    """The words of a block, and which of them a repeated window covers."""
    block = next(iter(got.values()))["block"] if got else 0
    words, at, first, group, later, *_ = _repeats(ids, buf, offsets, k, bits, {f[1:]: r for f, r in got.items() if f[0] == 0}, block)
    flags = [np.unpackbits(B.unzip_planes(r["counts"]).astype(np.uint8), count=r["size"]) for _, r in sorted((f, r) for f, r in got.items() if f[0] == 1)]
    flags = np.concatenate(flags) if flags else np.zeros(0, np.uint8)
    if len(flags) != len(first):
        raise ValueError("a block's replies don't fit its windows: the input gave other rows when read again")
    cover = np.zeros(int(words.ptr[-1]) + 1, np.int32)
    hit = at[later | (flags == 1)[group]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    return words, np.cumsum(cover[:-1]) > 0


def dedup_substrings(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, row_col: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, and kept (the words left, joined by one space) or its kept_sha256 (digest=True).

    A word goes if a window of k words covers it whose words also start earlier:
    in a smaller id, or earlier in the same document. Windows are those of the
    input. Null texts have no words; rows without id come before all others, in
    the order in which they are read. Of rows with the same id none comes earlier, so none
    loses words to another. row_col: a key of rows (long, not null, each once) that
    orders rows of equal or no id, and becomes the column row of the result.
    Short texts (under k words) stay whole. Extra columns are not read.
    """
    blocks, replies, bits = repeated_spans(docs, k, id_col, text_col, row_col)

    def clean(ids, buf, offsets, got):
        words, gone = covered_words(ids, buf, offsets, got, k, bits)
        removed = np.concatenate(([0], np.cumsum(gone)))[words.ptr]
        raw, kept = buf.tobytes(), []
        for i in range(len(ids)):
            a, b = words.ptr[i], words.ptr[i + 1]
            live = np.flatnonzero(~gone[a:b]) + a
            text = b" ".join([raw[s:e] for s, e in zip(words.starts[live].tolist(), words.ends[live].tolist(), strict=True)])
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        key = {"doc_id": ids.field(0), "row": ids.field(1)} if row_col else {"doc_id": ids}
        return key | {"n_words": pa.array(np.diff(words.ptr)), "n_removed": pa.array(np.diff(removed)), "kept_sha256" if digest else "kept": pa.array(kept, pa.string())}

    return blocks.answer(replies, clean, f"doc_id long, {'row long, ' if row_col else ''}n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")
