"""Repeated rows, null ids, long texts, clashing columns and empty tables, over operators whose own tests don't have them."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from palaver.llm import bpe, forest, ngram_join, packing, pii, quality, rules, toxicity

_rng = np.random.default_rng(3)
_pool = [f"word{i}" for i in range(80)]
TEXTS = {i: " ".join(_rng.choice(_pool, 30 + i)) for i in range(40)}
TEXTS |= {40: None, 41: "", 42: " ".join(_rng.choice(_pool, 60_000)), 43: "mail me at a.b@example.com, token = 0123456789abcdef0123456789abcdef"}
ROWS = [*TEXTS.items(), (5, TEXTS[5]), (5, TEXTS[5]), (6, TEXTS[7]), (None, TEXTS[8]), (None, TEXTS[8]), (None, None)]
CLASH = "doc_id long, text string, n long, block long, kind string, row long, part long, y long, d double, frag int, votes string, score double, predicted int, label int, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4, 5, 0.5, 6, "v", 0.1, 1, 2, "en", "s", 7) for r in ROWS], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, "x", 1) for i in range(40)], "doc_id long, quality int, toxic int, text string, y int")


def rows_of(df):
    return collections.Counter(str(r) for r in df.collect())


OPERATORS = {
    "ngram_join": lambda d, _: ngram_join.similar_classes(d),
    "quality": lambda d, y: quality.score_quality(d, y),
    "pii": lambda d, _: pii.find_personal_data(d).select("doc_id", "base", "spans"),
    "bpe": lambda d, _: bpe.encode_texts(d, digest=True),
    "toxicity": lambda d, y: toxicity.score_toxicity(d, y),
    "rules": lambda d, _: rules.judge_quality(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_its_result_whatever_stands_beside(name, plain, clashing, labels):
    got = rows_of(OPERATORS[name](clashing, labels))
    assert got == rows_of(OPERATORS[name](plain, labels)) and sum(got.values()) == len(ROWS)


def test_packing_of_repeated_rows_null_ids_and_long_texts(plain, clashing):
    t = bpe.tokenizer(bpe.default_vocabulary())
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in ROWS)
    for d in (plain, clashing):
        pieces = packing.pack_documents(d).collect()
        total = collections.Counter()
        for p in pieces:
            total[p["doc_id"], p["doc_tokens"]] += p["length"]
        assert total == collections.Counter({k: k[1] * n for k, n in want.items()})
        fill = collections.defaultdict(list)
        for p in pieces:
            fill[p["sequence_id"]].append((p["offset"], p["length"]))
        for spots in fill.values():
            end = 0
            for offset, length in sorted(spots):
                assert offset == end
                end += length
            assert end <= 2048


def test_vectors_beside_clashing_columns_and_of_great_length(spark):
    rows = [(i, [float(x) for x in _rng.normal(size=4)]) for i in range(200)] + [(1000 + i, [1e9 + i, 1e9, 0.0, 0.0]) for i in range(20)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    column = [c for c in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").columns if c != "vec_id"][0]
    plain = plain.withColumnRenamed("embedding", column)
    more = plain.selectExpr("*", "1 AS d", "2 AS v", "3 AS part", "4 AS block", "5 AS ids", "6 AS most", "7 AS salt")
    got = rows_of(forest.nearest_neighbours(more))
    assert got == rows_of(forest.nearest_neighbours(plain))
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    found = collections.defaultdict(list)
    for r in forest.nearest_neighbours(plain).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
    for q in (1000,):
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:20]
        assert [i for _, i in sorted(found[q])] == [i for _, i in order]


def test_pipeline_of_an_empty_table(spark, tmp_path, clashing, labels):
    docs = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    labels.select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
