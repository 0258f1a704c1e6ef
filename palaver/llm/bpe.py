"""BPE encoding and decoding of whole texts through a table of distinct words.

Method: words are split in Spark tasks and cut further where the vocabulary's
own splitting rule always cuts (between ASCII letters, digits and punctuation).
Every distinct piece of the corpus goes to one fragment by its hash, is encoded
there once with the tokenizers library, and its ids return to the blocks that
hold it, where they are joined back by position. Decoding joins ids to the
vocabulary's pieces; that table is as long as the vocabulary, whatever the corpus.

The vocabulary file is a parameter. It must normalise with NFC, white space and
lower case and split words as that file does; its special tokens may stand in
a text (words with "<|" are encoded whole).
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .textcore import U64, Words, hash_spans, mix, ragged

VOCABULARY = "word_bpe_49k.json"

_KIND = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 other ASCII, 3 beyond ASCII
_KIND[:128] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer, one a worker; texts are never cut or padded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def id_pieces(path: str) -> np.ndarray:
    t = tokenizer(path)
    return np.array([(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size(with_added_tokens=True))], object)


class Pieces:
    """The pieces of a block's words, each with a key by which equal ones (but for the case of A-Z) agree."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        words = Words(buf, offsets)
        kind = _KIND[buf]
        a, b = kind[:-1], kind[1:]
        cut = (a < 3) & (b < 3) & ((a != b) | (a == 1)) & ~((buf[:-1] == 39) & (b == 0))
        begins = np.zeros(len(buf) + 1, bool)
        begins[1:-1] = cut
        whole = np.unique(np.searchsorted(words.starts, np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)), side="right") - 1) if len(buf) > 1 else np.zeros(0, int)
        for w in whole:
            begins[words.starts[w] : words.ends[w]] = False
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[words.starts] += 1
        inside[words.ends] -= 1
        begins[:-1] &= np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        begins[words.starts] = True
        self.buf, self.starts = buf, np.flatnonzero(begins)
        nxt = np.append(self.starts[1:], len(buf))
        word = np.searchsorted(words.starts, self.starts, side="right") - 1
        self.ends = np.minimum(nxt, words.ends[word]) if len(self.starts) else nxt[:0]
        self.keys = hash_spans(buf, self.starts, self.ends, lower=True)
        if len(whole):
            at = np.searchsorted(self.starts, words.starts[whole])
            self.keys[at] = mix(hash_spans(buf, self.starts[at], self.ends[at], lower=False) + U64(1))
        self.ptr = np.searchsorted(self.starts, offsets)


def encoded_blocks(docs: DataFrame, path: str) -> tuple[B.Blocks, DataFrame]:
    """Blocks, and for each its distinct pieces' ids in the order of their keys."""
    blocks = B.Blocks(docs)
    frags = blocks.frags

    def send(ids, buf, offsets):
        p = Pieces(buf, offsets)
        keys, first = np.unique(p.keys, return_index=True)
        lens = (p.ends - p.starts)[first]
        text, ends = ragged(buf, p.starts[first], lens), np.concatenate(([0], np.cumsum(lens)))
        edge = B.cuts(keys, frags, 64)
        full = [f for f in range(frags) if edge[f] < edge[f + 1]]
        squeeze = pa.Codec("zstd", 1)
        return {
            "frag": pa.array(full, pa.int32()),
            "keys": pa.array([B.zip_sorted(keys[edge[f] : edge[f + 1]]) for f in full], pa.binary()),
            "lens": pa.array([B.zip_planes(lens[edge[f] : edge[f + 1]]) for f in full], pa.binary()),
            "text": pa.array([squeeze.compress(text[ends[edge[f]] : ends[edge[f + 1]]].tobytes(), asbytes=True) for f in full], pa.binary()),
        }

    def encode(table: pa.Table) -> pa.Table:
        keys = [B.unzip_sorted(x.as_buffer()) for x in table.column("keys")]
        lens = [B.unzip_planes(x.as_buffer()).astype(np.int64) for x in table.column("lens")]
        sizes = np.array([len(x) for x in keys])
        text = b"".join(pa.Codec("zstd", 1).decompress(x.as_buffer(), decompressed_size=int(n.sum()), asbytes=True) for x, n in zip(table.column("text"), lens, strict=True))
        lens = np.concatenate(lens)
        ends = np.cumsum(lens)
        _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        t, got = tokenizer(path), []
        for i in range(0, len(first), 5000):
            part = first[i : i + 5000]
            words = [text[e - n : e].decode("utf-8", "replace") for e, n in zip(ends[part].tolist(), lens[part].tolist(), strict=True)]
            got += [x.ids for x in t.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        flat = np.array([i for x in got for i in x], np.uint32)
        begins = np.cumsum(counts) - counts
        out = {"counts": [], "ids": []}
        for b in np.split(back, np.cumsum(sizes)[:-1]):
            out["counts"].append(B.zip_planes(counts[b]))
            out["ids"].append(B.zip_planes(ragged(flat, begins[b], counts[b])))
        return pa.table({"block": table.column("block"), "frag": table.column("frag"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    sent = blocks.map(send, "block long, frag int, keys binary, lens binary, text binary", with_block=True)
    return blocks, sent.groupBy("frag").applyInArrow(encode, "block long, frag int, counts binary, ids binary")


class Encoded:
    """A block's pieces with their ids: those of piece i are flat[at[back[i]]:][:n[back[i]]]."""

    def __init__(self, buf, offsets, replies):
        p = Pieces(buf, offsets)
        keys, self.back = np.unique(p.keys, return_inverse=True)
        rows = [replies[k] for k in sorted(replies)]
        none = np.zeros(0, np.uint64)
        self.n = np.concatenate([B.unzip_planes(r["counts"]) for r in rows] or [none]).astype(np.int64)
        self.flat = np.concatenate([B.unzip_planes(r["ids"]) for r in rows] or [none]).astype(np.uint32)
        if len(self.n) != len(keys):
            raise ValueError("a block's replies don't fit its words: the input gave other rows when read again")
        self.at, self.ptr = np.cumsum(self.n) - self.n, p.ptr

    def of(self, i: int) -> np.ndarray:
        b = self.back[self.ptr[i] : self.ptr[i + 1]]
        return ragged(self.flat, self.at[b], self.n[b])


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids array<int> and decoded, or ids_sha256 and decoded_sha256 (digest=True), of each row.

    Null texts are empty: no ids, empty decoded text. Rows with a repeated or a
    null id each get a row. Extra columns are not read.
    """
    path = path or default_vocabulary()
    blocks, replies = encoded_blocks(B.documents(docs, id_col, text_col), path)

    def whole(ids, buf, offsets, got):
        e = Encoded(buf, offsets, got)
        pieces = id_pieces(path)
        flat, at = e.flat.tolist(), [*e.at.tolist(), len(e.flat)]
        number = [str(x).encode() for x in flat]
        names = pieces[e.flat].tolist()
        own = [(b" ".join(number[a:b]), b" ".join(names[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        texts = np.empty((len(own), 2), object)
        for i, x in enumerate(own):
            texts[i] = x
        out = {"n": [], "ids": [], "decoded": []}
        for i in range(len(ids)):
            b = e.back[e.ptr[i] : e.ptr[i + 1]]
            b = b[e.n[b] > 0]
            out["n"].append(int(e.n[b].sum()))
            said, text = b" ".join(texts[b, 0].tolist()), b" ".join(texts[b, 1].tolist())
            out["ids"].append(hashlib.sha256(said).hexdigest() if digest else e.of(i).astype(np.int32))
            out["decoded"].append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        last = "_sha256" if digest else ""
        return {"doc_id": ids, "n_tokens": pa.array(out["n"], pa.int64()), f"ids{last}": pa.array(out["ids"], pa.string() if digest else pa.list_(pa.int32())), f"decoded{last}": pa.array(out["decoded"], pa.string())}

    return blocks.answer(replies, whole, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"))
