"""Alignment of two tokenizers' tokens over the same texts, and how often each pair of ids overlaps in the corpus.

Both vocabularies split a text at every space that follows a character other than
white space (checked when they are loaded), so tokens, groups and links of a text
are those of its segments, one after the other. A task takes a block of some MB
and works on its distinct segments: token ends are running sums of token lengths,
np.intersect1d gives the cuts that both share, np.searchsorted the group of each
token, and np.repeat writes out the overlapping pairs. A document adds up what
its segments have. A worker remembers the tokens of some segments that it has met;
they are known by 128 bits of two hashes.

The corpus-wide counts of id pairs are summed in two shuffles: per pair and salt,
then per pair. Each block gets the counts of its own pairs back by a join, and its
documents add them up. Nothing is broadcast or goes through the driver.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textcore import hash_spans, ragged

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
SALTS = 16
#: Segments whose tokens a worker remembers.
REMEMBERED = 1 << 19
_SHIFT = 20  # a pair is (B id << 20) + A id
_MARK = "▁"
# The last two bytes of white space beyond ASCII begin with one of these.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0x80, 0x81, 0x9A, 0xC2]] = True
PER_DOC = ("n_a", "n_b", "n_groups", "n_links")
_STAGED = "block long, docs binary, ptr binary, segment binary, link_ptr binary, link binary, pair array<long>, n array<long>"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY)


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids joined, where each begins, and its length."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


@lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    """A's tokenizer and the bytes of its ids: each character of an entry stands for a byte, printable ones for themselves."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
    size = t.get_vocab_size(with_added_tokens=True)
    return t, _table([bytes(byte[c] for c in t.id_to_token(i) or "" if c in byte) for i in range(size)])


@lru_cache(maxsize=2)
def sign_texts(size: int) -> np.ndarray:
    """`,id`, `;id` and `|id` of all ids, one kind after the other."""
    return np.array([b"%c%d" % (c, i) for c in (44, 59, 124) for i in range(size)], object)


@lru_cache(maxsize=2)
def piece_tokenizer(path: str):
    """B's tokenizer, the bytes of its ids, and the id of a lone space."""
    from sentencepiece import SentencePieceProcessor

    s = SentencePieceProcessor(model_file=path)
    names = [s.id_to_piece(i) for i in range(s.get_piece_size())]
    if any(_MARK in x.lstrip(_MARK) for x in names):
        raise ValueError("the vocabulary has pieces with a space after another character: texts can't be cut at spaces")
    pieces = [bytes([int(x[3:5], 16)]) if s.is_byte(i) else b"" if s.is_control(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)]
    return s, _table(pieces), s.piece_to_id(_MARK)


def segments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each, where their segments begin, and ptr[i]:ptr[i+1] as those of document i.

    A segment begins at a text's own first space and at each space after a character that surely isn't white space.
    """
    n = len(offsets) - 1
    text = np.full(len(buf) + n, 32, np.uint8)
    starts = offsets[:-1] + np.arange(n)
    text[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = buf
    cut = np.zeros(len(text), bool)
    if len(text) > 2:
        one, before = text[1:-1], text[:-2]
        solid = (one > 32) & (one < 127) | (one > 127) & ~_MAY_BE_SPACE[before]
        cut[2:] = (text[2:] == 32) & solid
    cut[starts] = True
    begins = np.flatnonzero(cut)
    return text, begins, np.searchsorted(begins, np.append(starts, len(text)))


class Tokens:
    """Tokens of segments: keys (two hashes), and a[a_at[i]:][:n_a[i]] and b[b_at[i]:][:n_b[i]] of segment i."""

    def __init__(self, one, two, a, n_a, b, n_b):
        self.one, self.two, self.a, self.n_a, self.b, self.n_b = one, two, a, n_a, b, n_b
        self.a_at, self.b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b

    @classmethod
    def encode(cls, one: np.ndarray, two: np.ndarray, parts: list[bytes], paths: tuple[str, str]) -> Tokens:
        ta, (tb, _, space) = byte_tokenizer(paths[0])[0], piece_tokenizer(paths[1])
        a, b, n_a, n_b = [], [], [], []
        for i in range(0, len(parts), 4096):
            texts = [x.decode("utf-8", "replace") for x in parts[i : i + 4096]]
            for ids, lists, n in ((a, [x.ids for x in ta.encode_batch_fast(texts, add_special_tokens=False)], n_a), (b, [x or [space] for x in tb.encode([x[1:] for x in texts], num_threads=1)], n_b)):
                n.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(n[-1].sum())))
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        return cls(one, two, join(a, np.int32), join(n_a, np.int64), join(b, np.int32), join(n_b, np.int64))

    def take(self, i: np.ndarray) -> Tokens:
        return Tokens(self.one[i], self.two[i], ragged(self.a, self.a_at[i], self.n_a[i]), self.n_a[i], ragged(self.b, self.b_at[i], self.n_b[i]), self.n_b[i])

    def plus(self, other: Tokens) -> Tokens:
        """Both, by the first hash."""
        both = Tokens(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("one", "two", "a", "n_a", "b", "n_b")))
        return both.take(np.argsort(both.one, kind="stable"))


_memory: dict[tuple[str, str], Tokens] = {}


def tokens_of(one: np.ndarray, two: np.ndarray, part, paths: tuple[str, str]) -> Tokens:
    """The tokens of distinct segments, by ascending first hash; part(i) gives the bytes of those at i. What isn't remembered is encoded."""
    known = _memory.get(paths)
    if known is None or not len(known.one):
        new = Tokens.encode(one, two, part(np.arange(len(one))), paths)
        _memory[paths] = new
        return new
    at = np.minimum(np.searchsorted(known.one, one), len(known.one) - 1)
    have = (known.one[at] == one) & (known.two[at] == two)
    lack = np.flatnonzero(~have)
    new = Tokens.encode(one[lack], two[lack], part(lack), paths)
    out = known.take(at[have]).plus(new)
    fresh = known.one[at[lack]] != new.one
    _memory[paths] = known.plus(new.take(np.flatnonzero(fresh))) if len(known.one) + len(lack) <= REMEMBERED else out
    return out


class Aligned:
    """Segments with their tokens, groups and links, each list in the order of the segments; n_a and so on say how many each has."""

    def __init__(self, joined: np.ndarray, size: np.ndarray, t: Tokens, paths: tuple[str, str]):
        table_a, table_b = byte_tokenizer(paths[0])[1], piece_tokenizer(paths[1])[1]
        self.a, self.b, self.n_a, self.n_b = t.a.astype(np.int64), t.b.astype(np.int64), t.n_a, t.n_b
        parts = size
        # tokens that don't give back the segment spoil the documents that hold it
        self.good = self._gives_back(self.a, self.n_a, table_a, joined, size) & self._gives_back(self.b, self.n_b, table_b, joined, size)
        keep_a, keep_b = np.repeat(self.good, self.n_a), np.repeat(self.good, self.n_b)
        self.a, self.b = self.a[keep_a], self.b[keep_b]
        self.n_a, self.n_b = self.n_a * self.good, self.n_b * self.good

        len_a, len_b = table_a[2][self.a], table_b[2][self.b]
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last = np.cumsum(size * self.good)
        upto = np.searchsorted(cuts, last, side="right")
        self.n_groups = np.diff(upto, prepend=0)
        first_b, last_b = np.searchsorted(end_b, end_a - len_a, side="right"), np.searchsorted(end_b, end_a)
        times = last_b - first_b + 1
        self.link_a = np.repeat(np.arange(len(self.a)), times)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b, times)
        of_a = np.repeat(np.arange(len(parts)), self.n_a)
        self.n_links = np.bincount(of_a, weights=times, minlength=len(parts)).astype(np.int64)

    @staticmethod
    def _gives_back(ids: np.ndarray, n: np.ndarray, table, joined: np.ndarray, size: np.ndarray) -> np.ndarray:
        data, at, sizes = table
        of = np.repeat(np.arange(len(n)), n)
        own = np.bincount(of, weights=sizes[ids], minlength=len(n)).astype(np.int64)
        good = own == size
        took = ragged(data, at[ids], sizes[ids])[np.repeat(good[of], sizes[ids])]
        want = joined[np.repeat(good, size)]
        wrong = np.repeat(np.arange(len(n)), size * good)[took != want]
        good[wrong] = False
        return good

    def group_texts(self) -> list[bytes]:
        """Of each segment `a1,a2|b1;a3|b2,b3`: A ids, then B ids of each group in decimal."""
        key = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([self.a, self.b])[order]
        new = np.ones(len(ids), bool)
        new[1:] = key[1:] != key[:-1]
        size = int(ids.max(initial=0)) + 1
        texts = sign_texts(1 << size.bit_length())
        parts = texts[ids + (len(texts) // 3) * np.where(new, 1 + (key & 1), 0)].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(parts[a:b])[1:] for a, b in zip([0, *ends], ends, strict=False)]


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The sums of values[ptr[i]:ptr[i+1]], also of empty ranges."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ptr[1:]] - total[ptr[:-1]]


def _block_row(ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, paths: tuple[str, str], digest: bool) -> dict:
    """One row of _STAGED (without block) of a block of documents."""
    text, begins, ptr = segments(buf, offsets)
    ends = np.append(begins[1:], len(text))
    one, two = hash_spans(text, begins, ends), hash_spans(text, begins, ends, kind=12)
    keys, first, back = np.unique(one, return_index=True, return_inverse=True)
    if not np.array_equal(two[first][back], two):
        _, first, back = np.unique(np.stack([one, two]), axis=1, return_index=True, return_inverse=True)
        keys, back = one[first], back.ravel()
    begin, size = begins[first], (ends - begins)[first]
    t = tokens_of(keys, two[first], lambda i: [text[a : a + n].tobytes() for a, n in zip(begin[i].tolist(), size[i].tolist(), strict=True)], paths)
    x = Aligned(ragged(text, begin, size), size, t, paths)
    empty = np.diff(offsets) == 0
    good = ~empty & (_sums(~x.good[back], ptr) == 0)
    doc = np.repeat(np.arange(len(good)), np.diff(ptr))
    back = back[good[doc]]
    ptr = np.concatenate(([0], np.cumsum(np.diff(ptr) * good)))
    used = np.bincount(back, minlength=len(first))

    pair, link = np.unique((x.b[x.link_b] << _SHIFT) + x.a[x.link_a], return_inverse=True)
    n = np.bincount(link, weights=np.repeat(used, x.n_links), minlength=len(pair)).astype(np.int64)
    own = np.empty(len(first), object)
    own[:] = x.group_texts()
    said = own[back].tolist()
    groups = [b";".join(said[a:b]) if ok else b"" for a, b, ok in zip(ptr[:-1].tolist(), ptr[1:].tolist(), good.tolist(), strict=True)]
    groups = [(hashlib.sha256(g).hexdigest() if g else "") if digest else g.decode() for g in groups]
    docs = pa.table({"doc_id": ids, **{k: pa.array(_sums(getattr(x, k)[back], ptr)) for k in PER_DOC}, "groups": pa.array(groups, pa.string())})
    row = {"docs": pa.array([B._ipc(docs)], pa.binary())}
    for k, v in (("ptr", ptr), ("segment", back), ("link_ptr", np.concatenate(([0], np.cumsum(x.n_links)))), ("link", link)):
        row[k] = pa.array([B.zip_planes(v)], pa.binary())
    return row | {k: pa.array([v], pa.list_(pa.int64())) for k, v in (("pair", pair), ("n", n))}


def aligned_blocks(docs: DataFrame, paths: tuple[str, str], digest: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of _STAGED, one for each block of documents; written to the shared folder, so that blocks stay what they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            row = _block_row(table.column(0).chunk(0), *B.text_bytes_of(table.column(1).chunk(0)), paths, digest)
            row = pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + count], pa.int64()), **row})
            count, held, size = count + 1, [], 0
            return row

        for batch in batches:
            done = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = done[begin - 1] if begin else 0
                end = min(batch.num_rows, max(begin + 1, int(np.searchsorted(done, before + block_bytes - size, side="right"))))
                held.append(batch.slice(begin, end - begin))
                size += int(done[end - 1] - before)
                begin = end
                if size >= 0.9 * block_bytes or begin < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return B.stage_table(docs.mapInArrow(run, _STAGED))


def pair_counts(staged: DataFrame, salts: int = SALTS) -> DataFrame:
    """pair, n of each id pair in all blocks: summed per pair and salt, then per pair."""
    sent = staged.select("block", F.explode(F.arrays_zip("pair", "n")).alias("x")).select(F.pmod("block", F.lit(salts)).alias("salt"), "x.pair", "x.n")
    some = sent.groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    return some.groupBy("pair").agg(F.sum("n").alias("n"))


def token_pairs(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n_links of the corpus, and whether n_links is the highest of its b_id."""
    staged = aligned_blocks(B.documents(docs, id_col, text_col), paths or default_vocabularies(), True)
    n = pair_counts(staged).select((F.col("pair") % (1 << _SHIFT)).alias("a_id"), F.shiftright("pair", _SHIFT).alias("b_id"), F.col("n").alias("n_links"))
    best = n.groupBy("b_id").agg(F.max("n_links").alias("most"))
    return n.join(best, "b_id").select("a_id", "b_id", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (digest: groups_sha256) of each row.

    Null and empty texts, and those that a tokenizer doesn't give back byte for
    byte, have no tokens: zeros and empty groups. Very long texts are a block of
    their own, whole. Repeated and null ids each get a row and count as often as
    they stand; of equal counts of a B id all are best. An empty table gives no
    rows. Extra columns are not read.
    """
    staged = aligned_blocks(B.documents(docs, id_col, text_col), paths or default_vocabularies(), digest, block_bytes)
    total = B.stage_table(pair_counts(staged).withColumn("b_id", F.shiftright("pair", _SHIFT)))
    best = total.groupBy("b_id").agg(F.max("n").alias("most"))
    known = total.join(best, "b_id").select("pair", F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("best"))
    replies = staged.select(F.col("block").alias("to"), F.explode("pair").alias("pair")).join(known, "pair").select("to", "pair", "total", "best")
    name = "groups_sha256" if digest else "groups"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {name} string"

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        total, best = (right.column(c).to_numpy()[order] for c in ("total", "best"))
        row = {k: left.column(k)[0].as_buffer() for k in ("docs", "ptr", "segment", "link_ptr", "link")}
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        link, by, segment, ptr = (B.unzip_planes(row[k]).astype(np.int64) for k in ("link", "link_ptr", "segment", "ptr"))
        if left.column("pairs")[0].as_py() != len(total):
            raise ValueError("a block's replies don't fit its pairs")
        out = {k: docs.column(k) for k in ("doc_id", *PER_DOC)}
        for k, v in (("n_best", best.astype(np.int64)), ("count_sum", total)):
            out[k] = pa.array(_sums(_sums(v[link], by)[segment], ptr), pa.int64())
        return pa.table(out | {name: docs.column("groups")})

    return staged.withColumn("pairs", F.size("pair")).drop("n", "pair").groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(whole, schema)
