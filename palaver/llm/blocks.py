"""Blocks of documents, and merging what blocks say about shared keys.

Many corpus-wide questions ("in how many documents is this shingle?", "how often
is this word used?") need every block to send its keys somewhere and to get an
answer for each. Done a row a key, that shuffle is many times the text. Here a
block is one row that holds a few MB of documents, compressed. It sends its
sorted distinct keys to hash ranges ("fragments") as delta-coded byte planes; a
fragment adds up what all blocks sent and answers each block in the order in
which it sent. The blocks, dealt by their number in one exchange, then read the
answers beside their texts. Nothing goes through the driver or is broadcast, a
key that is in every document costs one entry a block, and lost executors are
covered by Spark's lineage.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
PACKED = "block long, payload binary"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a local one only where none is set and all runs in one process, as in tests."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        top = tempfile.gettempdir() + "/palaver-checkpoints"
    return f"{top.rstrip('/')}/palaver-{uuid.uuid4().hex}"


#: Paths that stage_table() writes while a Staged scope is open.
_open_scopes: list[list[str]] = []


class Staged:
    """Tables that are staged while the scope is open; drop() removes them, once what is built on them has been written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Staged:
        _open_scopes.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _open_scopes[:] = [x for x in _open_scopes if x is not self.paths]

    def drop(self, spark: SparkSession) -> None:
        jvm = spark.sparkContext._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


def stage_table(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that what follows doesn't run it anew."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    for paths in _open_scopes:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text, under fixed names; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents() as blocks of about block_bytes; a longer document is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            row = pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + count], pa.int64()), "payload": pa.array([_ipc(table)], pa.binary())})
            count, held, size = count + 1, [], 0
            return row

        for batch in batches:
            lengths = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = lengths[begin - 1] if begin else 0
                end = min(batch.num_rows, max(begin + 1, int(np.searchsorted(lengths, done + block_bytes - size, side="right"))))
                held.append(batch.slice(begin, end - begin))
                size += int(lengths[end - 1] - done)
                begin = end
                if size >= 0.9 * block_bytes or begin < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, PACKED)


class Blocks:
    """Packed documents, dealt by block; frags: the number of hash ranges that keys go to."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, frag_bytes: int = 12 << 20):
        self.bytes = text_bytes(docs)
        self.frags = max(4, math.ceil(self.bytes / frag_bytes))
        self.parts = max(1, math.ceil(self.bytes / (2 * block_bytes)))
        self.rows = pack(docs, block_bytes).repartition(self.parts, "block")

    def map(self, of: Callable[[pa.Array, np.ndarray, np.ndarray], dict | None], schema: str, with_block: bool = False) -> DataFrame:
        """of(ids, bytes, offsets) of each block, as columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    got = of(*unpack(batch.column(1)[i].as_buffer()))
                    n = len(next(iter(got.values())))
                    if n:
                        block = {"block": pa.array(np.full(n, batch.column(0)[i].as_py()))} if with_block else {}
                        yield pa.RecordBatch.from_pydict(block | got)

        return self.rows.mapInArrow(run, schema)

    def answer(self, replies: DataFrame, of: Callable, schema: str) -> DataFrame:
        """of(ids, bytes, offsets, {frag: row}) of each block and its replies."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            got = {}
            for i in range(right.num_rows):
                row = {c: right.column(c)[i].as_buffer() if pa.types.is_binary(right.column(c).type) else right.column(c)[i].as_py() for c in right.column_names}
                got[tuple(v for k, v in row.items() if k in ("kind", "frag"))] = row
            out = [pa.Table.from_pydict(of(*unpack(left.column(1)[i].as_buffer()), got)) for i in range(left.num_rows)]
            return pa.concat_tables(out) if out else None

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        names = to_arrow_schema(StructType.fromDDL(schema))

        def whole(left: pa.Table, right: pa.Table) -> pa.Table:
            out = run(left, right)
            return names.empty_table() if out is None else out.select(names.names).cast(names)

        return self.rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(whole, schema)


def unpack(payload) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, the bytes of all texts, and where each begins (and the last ends)."""
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    text = table.column(1).chunk(0) if table.num_rows else pa.array([], pa.string())
    ids = table.column(0).chunk(0) if table.num_rows else pa.array([], pa.int64())
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int32, len(text) + 1, text.offset * 4).astype(np.int64) if len(text) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(text) else np.zeros(0, np.uint8)
    return ids, buf, offsets - offsets[0]


def zip_planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed; high planes of small values cost next to nothing."""
    v = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    body = planes.tobytes()
    return np.array([len(v), width], np.uint32).tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unzip_planes(blob) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    body = pa.Codec("zstd", 1).decompress(memoryview(blob)[8:], decompressed_size=n * width)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def zip_sorted(values: np.ndarray) -> bytes:
    return zip_planes(np.diff(values, prepend=np.uint64(0)))


def unzip_sorted(blob) -> np.ndarray:
    return np.cumsum(unzip_planes(blob), dtype=np.uint64)


def cuts(sorted_keys: np.ndarray, frags: int, bits: int) -> np.ndarray:
    """Where the fragments begin in sorted keys of so many bits, and the end."""
    edges = np.array([(i << bits) // frags for i in range(1, frags)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))


def sketch_bits(keys: int, cells_per_key: int = 64) -> int:
    """Bits of a sketch with so many cells a key, so that few keys meet another's cell at any corpus size."""
    return min(64, max(20, math.ceil(math.log2(max(2, keys * cells_per_key)))))


def merged_counts(blocks: Blocks, keys: Callable, bits: int, cap: int | None, top: int = 0) -> DataFrame:
    """How often each of a block's keys occurs in all blocks, as replies (block, frag, counts).

    keys(ids, bytes, offsets) gives hashes (repeats count) or (hashes, counts).
    The partial sketch of a block has one cell for each value of a hash's upper
    `bits`; only filled cells are sent. A fragment adds the sketches' cells and
    answers each block for its filled cells in ascending order. Below 64 bits the
    counts are never too low; with 64 they are those of the hashes. cap: the
    answers stop there. Block -1 gets, for each fragment, how many keys occur and how
    often in all, then the `top` most frequent keys with their counts, as int64.
    """
    frags, shift = blocks.frags, np.uint64(64 - bits)

    def send(ids, buf, offsets):
        got = keys(ids, buf, offsets)
        cells, counts = cells_of(*(got if isinstance(got, tuple) else (got, None)), shift)
        edge = cuts(cells, frags, bits)
        full = np.flatnonzero(np.diff(edge))
        return {
            "frag": pa.array(full.astype(np.int32)),
            "cells": pa.array([zip_sorted(cells[edge[f] : edge[f + 1]]) for f in full], pa.binary()),
            "counts": pa.array([zip_planes(counts[edge[f] : edge[f + 1]]) for f in full], pa.binary()),
        }

    def add(table: pa.Table) -> pa.Table:
        cells = [unzip_sorted(x.as_buffer()) for x in table.column("cells")]
        sizes = np.array([len(x) for x in cells])
        counts = np.concatenate([unzip_planes(x.as_buffer()) for x in table.column("counts")])
        distinct, back = np.unique(np.concatenate(cells), return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, back, counts)
        kept = total if cap is None else np.minimum(total, cap)
        answers, at = [], np.concatenate(([0], np.cumsum(sizes)))
        for i in range(len(cells)):
            answers.append(zip_planes(kept[back[at[i] : at[i + 1]]]))
        most = np.lexsort((distinct, -total.astype(np.int64)))[:top]
        most = np.column_stack([distinct[most].view(np.int64), total[most].astype(np.int64)]).ravel()
        answers.append(np.concatenate([[int((total > 0).sum()), int(total.sum())], most]).astype(np.int64).tobytes())
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "frag": pa.array([table.column("frag")[0].as_py()] * len(answers), pa.int32()), "counts": pa.array(answers, pa.binary())})

    sent = blocks.map(send, "block long, frag int, cells binary, counts binary", with_block=True)
    return sent.groupBy("frag").applyInArrow(add, "block long, frag int, counts binary")


def cells_of(hashes: np.ndarray, counts: np.ndarray | None, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        cells, n = np.unique(hashes >> shift, return_counts=True)
        return cells, n.astype(np.uint64)
    cells, back = np.unique(hashes >> shift, return_inverse=True)
    n = np.zeros(len(cells), np.uint64)
    np.add.at(n, back, counts.astype(np.uint64))
    return cells, n


def counts_for(hashes: np.ndarray, replies: dict, bits: int) -> np.ndarray:
    """The answer for each hash of the block that sent them."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    cells, back = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)
    parts = [unzip_planes(replies[k]["counts"]) for k in sorted(replies)]
    counts = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(counts) != len(cells):
        raise ValueError("a block's replies don't fit its keys: the input gave other rows when read again")
    return counts[back]


def map_documents(docs: DataFrame, of: Callable, schema: str, slice_bytes: int = 2 << 20) -> DataFrame:
    """of(ids, bytes, offsets) of small slices of documents(), as rows; for work that needs one text at a time only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = lengths[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(lengths, done + slice_bytes, side="right")))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_pydict(of(part.column(0), *text_bytes_of(part.column(1))))
                begin = end

    return docs.mapInArrow(run, schema)


def text_bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]
