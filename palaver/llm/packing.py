"""Packing of tokenised documents into sequences of fixed length.

Method: best-fit decreasing. Documents longer than a sequence are first cut
into full windows. The pieces are dealt by a hash into buckets of bounded size;
each bucket places its pieces, longest first, into the open sequence that they
fill most tightly. A segment tree over remaining capacities finds it in
log(capacity) steps. A bucket wastes at most a part of its last sequences, so
padding does not grow with the number of buckets' pieces.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .bpe import Encoded, default_vocabulary, encoded_blocks

#: Pieces in a bucket, on average.
BUCKET = 4096


class BestFit:
    """Open sequences by remaining capacity; a segment tree knows which capacities have any."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def _mark(self, at: int, on: int) -> None:
        at += self.size
        self.tree[at] = on
        while at > 1:
            at >>= 1
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The least capacity >= need that some open sequence has, or -1."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece."""
        room = self.tightest(length)
        if room < 0:
            which, room = self.count, self.capacity
            self.count += 1
        else:
            which = self.open[room].pop()
            if not self.open[room]:
                self._mark(room, 0)
        left = room - length
        if left:
            if not self.open[left]:
                self._mark(left, 1)
            self.open[left].append(which)
        return which, self.capacity - room


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and then end_id, so that null and empty texts are one
    id long. Rows with a repeated or null id are packed like any other. An
    empty table gives no rows. Extra columns are not read.
    """
    path = path or default_vocabulary()
    blocks, replies = encoded_blocks(B.documents(docs, id_col, text_col), path)

    def pieces(ids, buf, offsets, got):
        e, rows = Encoded(buf, offsets, got), {k: [] for k in ("doc", "start", "length", "crc", "total", "ids")}
        for i, doc in enumerate(ids.to_pylist()):
            tokens = np.append(e.of(i), np.uint32(end_id)).astype("<u4")
            for at in range(0, len(tokens), capacity):
                part = tokens[at : at + capacity]
                for k, v in zip(rows, (doc, at, len(part), zlib.crc32(part.tobytes()), len(tokens), part.astype(np.int32) if with_ids else None), strict=True):
                    rows[k].append(v)
        kinds = {"ids": pa.list_(pa.int32())}
        return {n: pa.array(rows[k], kinds.get(k, pa.int64())) for n, k in (("doc_id", "doc"), ("start", "start"), ("length", "length"), ("ids_crc32", "crc"), ("doc_tokens", "total"), ("ids", "ids"))}

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    cut = B.stage_table(blocks.answer(replies, pieces, schema).withColumn("row", F.monotonically_increasing_id()))
    return place_pieces(cut, capacity, with_ids)


def place_pieces(cut: DataFrame, capacity: int, with_ids: bool = False) -> DataFrame:
    buckets = max(1, math.ceil(cut.count() / BUCKET))

    def fit(table: pa.Table) -> pa.Table:
        length, row = table.column("length").to_numpy(), table.column("row").to_numpy()
        bins, which, at = BestFit(capacity), np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        for i in np.lexsort((row, -length)).tolist():
            which[i], at[i] = bins.place(int(length[i]))
        bucket = table.column("bucket")[0].as_py()
        return table.drop_columns(["bucket", "row"]).append_column("sequence_id", pa.array(which + (bucket << 32))).append_column("offset", pa.array(at))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return cut.select(*names, "row", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(fit, schema)
