"""Periodic runs, mixing and token alignment against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.llm import alignment, blocks, mixing, periodic, queries

_rng = np.random.default_rng(11)


def _periodic_text():
    w = []
    while len(w) < _rng.integers(0, 140):
        unit = [f"w{_rng.integers(0, 3)}" for _ in range(_rng.integers(1, 9))]
        w += unit * int(_rng.integers(1, 9)) if _rng.random() < 0.5 else unit
        w += unit[: _rng.integers(0, len(unit))]
    return " ".join(w)


def plain_runs(w):
    n, best = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in best.items())


def collapsed(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


RUN_TEXTS = [None, "", " \t\n", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "a c", *(_periodic_text() for _ in range(80)), "z " * 30_000, " ".join(f"v{i}" for i in _rng.integers(0, 300, 60_000))]
SCHEMA = "doc_id long, text string, start long, length long, n long, block long, shard long, size long"


@pytest.fixture(scope="module")
def run_docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in enumerate(RUN_TEXTS)] + [(None, RUN_TEXTS[4], 0, 0, 0, 0, 0, 0), (7, RUN_TEXTS[7], 0, 0, 0, 0, 0, 0)], SCHEMA)


def test_runs_equal_brute_force(spark, run_docs):
    got = periodic.periodic_runs(run_docs, points=5000).collect()
    assert len(got) == len(RUN_TEXTS) + 2
    long = {len(RUN_TEXTS) - 2: [(0, 30_000, 1)], len(RUN_TEXTS) - 1: []}
    for r in got:
        text = RUN_TEXTS[4 if r["doc_id"] is None else r["doc_id"]]
        w = (text or "").split()
        want = long[r["doc_id"]] if r["doc_id"] in long else plain_runs(w)
        assert (r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) == (len(w), want, collapsed(w, want))
    assert periodic.periodic_runs(run_docs.where("false")).count() == 0


def test_runs_of_words_whose_hashes_are_equal(monkeypatch):
    """Where two words share a hash, comparing bytes finds it and the document is done by its words."""
    texts = pa.array(["a b a a b a b b a b " * 3, "a b " * 8])
    blind = periodic.Words

    class Same(blind):
        def hashes(self, lower=False, kind=11):
            return np.zeros(len(self.starts), np.uint64)

    monkeypatch.setattr(periodic, "Words", Same)
    w, b, e, p = periodic._slice_runs(*blocks.text_bytes_of(texts), 100)
    for i, t in enumerate(texts.to_pylist()):
        own = [(int(x - w.ptr[i]), int(y - x), int(q)) for x, y, q in zip(b, e, p, strict=True) if w.ptr[i] <= x < w.ptr[i + 1]]
        assert own == plain_runs(t.split())


def test_runs_of_the_query_repeat_words_as_its_contract_says(spark, tmp_path):
    texts = {i: " ".join(f"u{x}" for x in _rng.integers(0, 40, 50 + i % 90)) for i in range(120)} | {500: None, 501: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best) and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest() and r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def plain_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left, all_ = 1.5 * sum(size.values()) - sum(target.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / all_ for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            free.discard(s)
    return target


def _mixed_docs(spark):
    rows = []
    for i in range(300):
        source = [None, "big", "big", "big", "é", "a b", "s1", "s2"][i % 8]
        text = None if i % 50 == 7 else " ".join(["w"] * int(_rng.integers(0, 60)))
        rows.append((i, text, source))
    rows += [(900, " ".join(["x"] * 4000), "big"), (901, "same text here", "s1"), (901, "same text here", "s1"), (None, "no id at all", "s2"), (902, "only", "single"), (903, "", "empty")]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, rank long, block long, draws long")


def test_mixing_meets_targets_and_places_each_draw_once(spark):
    docs = _mixed_docs(spark)
    rows = mixing.mix_sources(docs, keep=("text",), shard_words=1000).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r["source"]] += len((r["text"] or "").split())
    want, taken, per = plain_targets(dict(size)), collections.Counter(), collections.Counter()
    for r in rows:
        assert (r["shard"] is None) == (r["words"] is None) == (r["position"] is None)
        assert r["size"] == len((r["_text"] or "").split()) and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        taken[r["source"]] += r["words"] or 0
        per[r["rank"], r["block"], r["no"]] += r["words"] or 0
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert len(per) == docs.count() and all(per[r["rank"], r["block"], r["no"]] <= 2 * r["size"] for r in rows)
    # the draws of a pass over a block are in one shard; positions of a shard have no gaps
    shards = collections.defaultdict(list)
    for r in rows:
        if r["shard"] is not None:
            shards[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 3
    again = mixing.mix_report(docs.repartition(5), shard_words=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix_report(docs, shard_words=1000).collect()))
    assert len(again) == docs.count() and sum(r["taken"] for r in again) == sum(taken.values())


def test_mixing_without_words_or_rows(spark):
    d = "doc_id long, text string, source string"
    assert mixing.mix_report(spark.createDataFrame([], d)).count() == 0
    r = mixing.mix_report(spark.createDataFrame([(1, None, "a"), (2, "", None)], d)).collect()
    assert [(x["size"], x["target"], x["taken"], x["places"]) for x in sorted(r)] == [(0, 0.0, 0, "")] * 2


def test_far_sources_are_joined_by_salted_keys(spark, monkeypatch):
    docs = _mixed_docs(spark)
    near = sorted(map(str, mixing.mix_report(docs, shard_words=1000).collect()))
    monkeypatch.setattr(mixing, "NEAR_SOURCES", 0)
    assert sorted(map(str, mixing.mix_report(docs, shard_words=1000).collect())) == near


def test_splitting_tree_keeps_quotas_and_draws_by_chance(spark):
    q = spark.createDataFrame([(1, 4000), (2, 37), (3, 1), (4, 0), (5, 900)], "rank int, n long")
    rows = mixing.shard_quotas(q, 13).collect()
    total, load = collections.Counter(), collections.Counter()
    for r in rows:
        total[r["rank"]] += r["quota"]
        load[r["shard"]] += r["quota"]
    assert total == {1: 4000, 2: 37, 3: 1, 5: 900} and max(load.values()) - min(load.values()) <= 2 and len(load) == 13
    # mean and variance of the hypergeometric draw
    n, k, m = 500, 200, 120
    u = (F.col("id") + 0.5) / 4000
    x = np.array([r[0] for r in spark.range(4000).select(mixing.hypergeometric(u, F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"))).collect()], float)
    assert x.mean() == pytest.approx(m * k / n, abs=0.01) and x.var() == pytest.approx(m * (k / n) * (1 - k / n) * (n - m) / (n - 1), rel=0.01)


TOKEN_TEXTS = [None, "", " ", "a", "  a  b ", "tab\t x\n\n y", "x  y", "　 z", "▁a b", "<s> a </s> <|endoftext|> b", "é ñ 日本 語", "don't  stop", "x  y  ", "\x00 a", "á b", "<0x41> b", "\u0085 q r", "the cat, the hat. the bat", "the cat, the hat. the bat", "q" * 3000, "word " * 4000]


def plain_alignment(texts):
    a_path, b_path = alignment.default_vocabularies()
    t, a_table = alignment.byte_tokenizer(a_path)
    s, b_table, _ = alignment.piece_tokenizer(b_path)
    piece = lambda table, i: table[0][table[1][i] : table[1][i] + table[2][i]].tobytes()
    count, per = collections.Counter(), []
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, s.encode(x)) if x else ([], [])
        ba, bb = [piece(a_table, i) for i in a], [piece(b_table, i) for i in b]
        if not x or b"".join(ba) != (" " + x).encode() or b"".join(bb) != (" " + x).encode():
            per.append(None)
            continue
        ea, eb = np.cumsum([len(y) for y in ba]).tolist(), np.cumsum([len(y) for y in bb]).tolist()
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({*ea} & {*eb}):
            left, right = [], []
            while i < len(a) and ea[i] <= cut:
                left.append(a[i])
                i += 1
            while j < len(b) and eb[j] <= cut:
                right.append(b[j])
                j += 1
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        i = j = 0
        while i < len(a):  # the ranges that overlap, in one walk
            links.append((a[i], b[j]))
            i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
        count.update(links)
        per.append((a, b, groups, links))
    return count, per


def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame([(i * 3, t, 0, 0, 0, 0, 0, 0) for i, t in enumerate(TOKEN_TEXTS)] + [(None, "the cat, the hat. the bat", 0, 0, 0, 0, 0, 0)], SCHEMA)
    texts = [*TOKEN_TEXTS, "the cat, the hat. the bat"]
    count, per = plain_alignment(texts)
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for i, x in enumerate(per):
        doc = i * 3 if i < len(TOKEN_TEXTS) else None
        if x is None:
            want.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = x
            want.append((doc, len(a), len(b), len(groups), len(links), sum(count[y] == most[y[1]] for y in links), sum(count[y] for y in links), ";".join(groups)))
    # small blocks, so that counts meet over many of them
    got = [tuple(r) for r in alignment.align_tokens(docs.repartition(4), block_bytes=2000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x is None for x in per) >= 3
    digests = {(r["doc_id"], r["groups_sha256"]) for r in alignment.align_tokens(docs, digest=True).collect()}
    assert digests == {(w[0], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want}
    pairs = alignment.token_pairs(docs).collect()
    assert {(r["a_id"], r["b_id"]): r["n_links"] for r in pairs} == dict(count) and all(r["best"] == (r["n_links"] == most[r["b_id"]]) for r in pairs)
    assert alignment.align_tokens(docs.where("false")).count() == 0


def test_remembered_segments_change_nothing(monkeypatch):
    paths = alignment.default_vocabularies()
    texts = [pa.array([" ".join(f"{x}{y}" for x in "abc" for y in range(k, k + 40))]) for k in (0, 20, 300, 10)]
    monkeypatch.setattr(alignment, "_memory", {})
    fresh = []
    for t in texts:
        alignment._memory.clear()
        fresh.append(alignment._block_row(pa.array([1]), *blocks.text_bytes_of(t), paths, False))
    alignment._memory.clear()
    monkeypatch.setattr(alignment, "REMEMBERED", 200)
    for t, f in zip(texts, fresh, strict=True):
        row = alignment._block_row(pa.array([1]), *blocks.text_bytes_of(t), paths, False)
        assert all(row[k].equals(f[k]) for k in f)
