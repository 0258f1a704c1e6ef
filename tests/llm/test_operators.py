"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from palaver.llm import blocks, bpe, forest, graph, ngram_join, packing, pii, quality, rnn_lm, rules, substring, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_rng = np.random.default_rng(5)
_pool = [f"w{i}" for i in range(60)]


def _text(n):
    return " ".join(_rng.choice(_pool, n))


LONG = _text(30_000)
BASE = _text(120)
NEAR = BASE.replace(BASE.split()[50], "zzz", 1)
TEXTS = [BASE, BASE, NEAR, BASE.upper(), None, "", "   ", "one two", "One TWO", _text(40) + "\n" + BASE, LONG, "é ñ 日本", "!!", "a b c d e"]
SCHEMA = "doc_id long, text string, n long, block long, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 7, t, 1, 2, "x") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_rounds_of_components_have_short_plans_without_broadcasts(spark, monkeypatch, capsys):
    """The driver kept the plans and broadcast tables of all rounds; a half round is written before it is read twice."""
    stage, plans = graph.stage_table, []

    def seen(df):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return stage(df)

    monkeypatch.setattr(graph, "stage_table", seen)
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert {r["v"]: r["label"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert len(plans) > 2 and max(p.count("Exchange") for p in plans) <= 5 and not any("Broadcast" in p for p in plans)


def test_components_of_paths_stars_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 130)] + [(5, 5), (3, 2)], "a long, b long")
    got = {r["v"]: r["label"] for r in graph.components(edges).collect()}
    assert {got[v] for v in range(21)} == {0} and {got[v] for v in range(100, 130)} == {100}
    assert graph.components(edges.where("false")).count() == 0


def test_ngram_join_equals_brute_force(docs, none):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = WORDS.findall(low(t))
        sets[i * 7] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = by_id(ngram_join.similar_classes(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}
    assert ngram_join.similar_classes(none).count() == 0


def test_ngram_join_of_rows_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words[:-1]), " ".join(f"v{i}" for i in range(30))
    rows = [(None, " ".join(words)), (5, near), (None, other), (7, other), (None, "quite alone here"), (9, None), (8, near), (8, near)]
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    said = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert said == collections.Counter([(None, 56, 5), (5, 55, 5), (None, 26, 7), (7, 26, 7), (None, 1, None), (9, 0, 9), (8, 55, 5), (8, 55, 5)])


def test_fragments_hold_each_shared_shingle_once():
    rng = np.random.default_rng(3)
    at = np.array([0, 0, 5, 40, 41])
    grams, counts = np.arange(41, dtype=np.uint64) * np.uint64(1 << 58), rng.integers(1, 30, 41).astype(np.uint64)
    got = ngram_join.fragments(grams, counts, at).to_pylist()
    edges = [*ngram_join.CUTS, 1 << 40]
    for i, row in enumerate(got):
        own = range(at[i], at[i + 1])
        assert [sorted(x) for x in row] == [sorted(int(grams[j].view(np.int64)) for j in own if a <= counts[j] < b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_ngram_join_of_a_family_in_turns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "DIRECT", 0)
    base = _text(200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[3 * (i % 50) + 2] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_substring_equals_brute_force(docs, none):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (key := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i * 7] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = by_id(substring.dedup_substrings(docs, digest=True))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert substring.dedup_substrings(none).count() == 0


def test_substring_of_rows_with_repeated_or_no_id(spark):
    a, b = _text(300), _text(300)
    twice = f"{a} {a}"
    rows = spark.createDataFrame([(7, a), (7, a), (8, b), (8, f"{b} x"), (None, twice), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.dedup_substrings(rows).collect())
    assert got == [(0, 300), (7, 300), (7, 300), (8, 0), (8, 0), (9, 300)]
    same = spark.createDataFrame([(7, a), (7, a), (7, a)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.dedup_substrings(same).collect()] == [0, 0, 0]
    keyed = spark.createDataFrame([(None, a, 3), (None, a, 1), (5, a, 0), (5, b, 9), (5, b, 4)], "doc_id long, text string, key long")
    assert {r["row"]: r["n_removed"] for r in substring.dedup_substrings(keyed, row_col="key").collect()} == {1: 0, 3: 300, 0: 300, 4: 0, 9: 300}
    none = spark.createDataFrame([(None, a)] * 3, "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring.dedup_substrings(none).collect()) == [0, 300, 300]


def test_bpe_and_packing_equal_the_library(spark, docs, none):
    odd = ["Don't 'tis x''s I'LL ,'s", "<|endoftext|>foo <|EndOfText|> a<|b", "ñ ≠ áb.c", "1234,5.6-7 9é", "İI Σ", "\x00a b", None]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    t = bpe.tokenizer(bpe.default_vocabulary())
    got, all_ids = by_id(bpe.encode_texts(table)), {}
    for r in table.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        all_ids[r["doc_id"]] = [*ids, 1]
        assert got[r["doc_id"]]["ids"] == ids and got[r["doc_id"]]["decoded"] == t.decode(ids, skip_special_tokens=False)
    pieces = packing.pack_documents(table, capacity=64).collect()
    filled = collections.defaultdict(list)
    for p in pieces:
        part = np.array(all_ids[p["doc_id"]], "<u4")[p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(all_ids[p["doc_id"]])
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(map(len, all_ids.values()))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none).count() == bpe.encode_texts(none).count() == 0


def test_best_fit_takes_the_tightest():
    b = packing.BestFit(10)
    assert [b.place(n) for n in (7, 6, 5, 4, 3, 5)] == [(0, 0), (1, 0), (2, 0), (1, 6), (0, 7), (2, 5)]


def test_quality_and_toxicity_tell_clear_cases_apart(spark, none):
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 3 == 0, i % 4 == 0
        w = _text(50).split()
        rows.append((i, " ".join(x + "!!" if bad else x for x in w) + (" clown idiot" if toxic else "")))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None), (901, "")]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    q, t = by_id(quality.score_quality(d, y)), by_id(toxicity.score_toxicity(d, y))
    assert len(q) == len(t) == len(rows) and q[900]["score"] == q[901]["score"]
    assert all(q[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert np.mean([q[i]["predicted"] == a for i, a, _ in labels]) > 0.97 and np.mean([t[i]["predicted"] == b for i, _, b in labels]) > 0.97
    assert quality.score_quality(none, y).count() == toxicity.score_toxicity(none, y.where("false")).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    docs = [(np.unique(np.append(rng.integers(1, 8, 2), rng.integers(8, 80, 5))).astype(np.uint64), None) for _ in range(500)]  # terms of both kinds of list
    docs = [(t, np.ones(len(t))) for t, _ in docs]
    y = np.array([int(3 in t or 5 in t) for t, _ in docs])
    df = lambda terms: (np.array([sum(t in d for d, _ in docs) for t in terms]) * 3, 1500)
    index = toxicity.Index(np.arange(500), y, docs, df, 0.3, 384, 16.0)
    assert index.blocks > 2 * toxicity.LEAD - 1 and set(index.terms) == {t for d, _ in docs for t in d}
    telling = {t for t, w, n in zip(index.terms, index.weight, df(index.terms)[0], strict=True) if w > 1.01 * np.log(1501 / (n + 0.5))}
    assert {3, 5} <= telling
    unit = np.zeros((500, 80))
    for i, (t, c) in enumerate(docs):
        at, own = index.query(t, c)
        unit[i, t.astype(int)] = own
    assert np.allclose((unit**2).sum(axis=1), 1)
    for i, (t, c) in enumerate(docs):
        near, cos = next(index.nearest_of([index.query(t, c)], 10))
        brute = unit @ unit[i]
        want = sorted((-round(v, 12), j) for j, v in enumerate(brute) if v > 0)[:10]
        assert [j for _, j in want] == list(index.ids[near]) and np.allclose([-v for v, _ in want], cos)
    scores = [s for s, _ in index.score_all(docs)]
    assert 0 < len(index.dense) < len(index.terms)
    assert np.mean([(s >= 0.5) == v for s, v in zip(scores, y, strict=True)]) > 0.97
    assert index.score_all([(np.array([99], np.uint64), np.ones(1))])[0][0] == 0.3


def test_block_max_search_reads_lists_once_where_maxima_spare_nothing(monkeypatch):
    """Each list here has one example in a block, and its maxima were read beside its postings."""
    n, read, ranges = 640, [], toxicity.ranges
    df = lambda terms: (np.full(len(terms), 50), n)

    def counted(starts, lengths):
        read.append(int(lengths.sum()))
        return ranges(starts, lengths)

    monkeypatch.setattr(toxicity, "ranges", counted)
    for m, most in ((40, n), (12, 3 * n)):
        docs = [(np.array([i % m, 10_000 + i], np.uint64), np.ones(2)) for i in range(n)]
        index = toxicity.Index(np.arange(n), np.arange(n) % 2, docs, df, 0.3, calibrated=False)
        text = index.query(np.arange(m, dtype=np.uint64), np.arange(1.0, m + 1))
        read.clear()
        near, _ = next(index.nearest_of([text], 15))
        assert index.ids[near].tolist() == list(range(m - 1, n, m))[:15]
        assert sum(read) <= most


def test_weighting_is_chosen_on_the_sample_alone():
    rng = np.random.default_rng(4)
    # many words of a topic hide the one that decides, or decide themselves
    topic = rng.integers(0, 6, 240)
    hidden, said = rng.integers(0, 2, 240), topic % 2
    words = [np.unique(np.append(100 * (1 + g) + rng.integers(0, 40, 30), rng.integers(5000, 9000, 10))) for g in topic]
    df = lambda terms: (np.full(len(terms), 20), 10_000)
    ids = np.arange(240)
    docs = [(np.sort(np.append(w, 1 + h)).astype(np.uint64), np.ones(len(w) + 1)) for w, h in zip(words, hidden, strict=True)]
    assert toxicity.choose(ids, hidden, docs, df, 0.5)["boost"] > 1
    plain = toxicity.choose(ids, said, docs, df, 0.5)
    assert plain == toxicity.choose(ids[::-1].copy(), said[::-1].copy(), docs[::-1], df, 0.5)
    assert toxicity.choose(ids, np.zeros(240, int), docs, df, 0.5) == {"telling": 0, "boost": 1.0, "k": 15, "prior": 0.25}


def test_document_frequencies_cover_the_corpus_and_edge_rows(spark, none):
    rows = [(1, "aa bb aa"), (2, "bb"), (2, "bb"), (None, "cc bb"), (5, None), (6, ""), (7, "dd " * 200_000 + "x" * 300_000)]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, term string, n int")
    words = toxicity.term_counts(np.frombuffer(b"aa bb cc dd zz", np.uint8), np.array([0, 14]))[1]
    df, total = toxicity.document_frequencies(blocks.documents(d), np.unique(words))
    assert total == 7 and sorted(df) == [0, 1, 1, 1, 4]
    y = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (7, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, y).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1


def test_pii_base_spans_and_bootstrapped_ones(spark, docs, none):
    texts = ["mail a@b.com_x@c.de or 1.2.3.4.5.6.7.8 not 999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (743) 555-3824 now", "é@é.com ñ a@b.co", "1" * 30 + " " + "1 2 " * 3000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_personal_data(d))
    assert got[0]["base"] == "email:5:12,email:12:19,ip:23:30,ip:31:38" and got[1]["base"] == "card:0:19" and got[2]["base"] == "phone:5:22"
    assert got[3]["base"] == "email:10:16" and got[4]["base"] == got[5]["base"] == ""
    seeds = [(i, f"my number is +1 555 010 {1000 + i} thanks a lot") for i in range(12)]
    more = by_id(pii.find_personal_data(spark.createDataFrame([*seeds, (99, "my number is 5550109999x thanks a lot"), (98, "see 5550109999y here")], "doc_id long, text string")))
    assert more[99]["base"] == "" and more[99]["spans"] == "phone:13:24" and more[98]["spans"] == ""
    assert pii.find_personal_data(none).count() == 0
    long = ["x@" + "a." * 20_000 + "a", "a@b.c " * 700 + "1.2" * 900]
    got = by_id(pii.find_personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")))
    assert got[0]["base"] == f"email:0:{len(long[0])}" and (got[1]["n_email"], got[1]["n_ip"]) == (700, 225)
    keys = [(i, f"{_text(8)} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" {_text(5)}") for i in range(12)] + [(29, "my token = zz99881122ab, so"), (30, f"see {'ab12' * 10} there"), (31, "the token = 123456789012 is none")]
    got = by_id(pii.find_personal_data(spark.createDataFrame(keys, "doc_id long, text string")))
    assert all(got[i]["spans"].startswith("secret:") and got[i]["base"] == "" for i in range(12)) and got[29]["spans"] == "secret:11:23" and got[30]["spans"] == got[31]["spans"] == ""


def test_rules_count_and_judge(spark, none):
    texts = ["a b c a b c\na b c\n\n \nq\nq", "w w w w", None, "", "# $ <x>", _text(200)]
    got = by_id(rules.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        tri = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(tri)
        cover = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (got[i]["kept"] is False or not got[i]["base_failed"])
    assert rules.judge_quality(none).count() == 0
    rows = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefghijkl"), 400))) for i in range(4)]
    clashing = by_id(rules.text_counts(spark.createDataFrame(rows, "doc_id long, text string"), spare=50))
    for i, t in rows:
        w = t.split()
        n = collections.Counter(zip(w, w[1:], w[2:]))
        assert clashing[i]["n_repeat_words"] == len({k + j for k in range(398) if n[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_language_model_base_scores_and_gradient(docs, none):
    got = by_id(rnn_lm.score_texts(docs, sample_docs=8))
    tok = {i * 7: [*WORDS.findall(low(t)), None] for i, t in enumerate(TEXTS)}
    c = collections.Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tok.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9) and got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(c[w] > 0 for w in t) and got[i]["train_tokens"] == n and got[i]["score"] < 0
    assert rnn_lm.score_texts(none).count() == 0
    m = rnn_lm.Model(np.ones(rnn_lm.CLASSES * rnn_lm.WIDTH))
    tokens = np.random.default_rng(0).integers(0, 1024, 50)
    both = m.log_likelihood(np.concatenate([tokens, tokens[:7]]), np.array([0, 50, 57]))
    assert np.isclose(both[0], m.log_likelihood(tokens, np.array([0, 50]))[0]) and np.isclose(both[1], m.log_likelihood(tokens[:7], np.array([0, 7]))[0], rtol=1e-4)


def test_language_model_gradient_equals_differences():
    rng = np.random.default_rng(2)
    model = rnn_lm.Model(np.ones(64))
    tokens = np.append(rng.integers(1, 64, 14), rnn_lm.END)  # one window
    start = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: -model.log_likelihood(tokens, np.array([0, len(tokens)]))[0] / len(tokens)
    model.fit([tokens], rate=0.0)
    found = {k: m / 0.1 for k, m in model.m1.items()}  # of one step
    model.p = start
    told, want = [], []
    for name, g in found.items():
        for spot in np.argsort(-np.abs(g), axis=None)[:4]:
            at, both = np.unravel_index(spot, g.shape), []
            for eps in (0.01, -0.01):
                model.p[name][at] += eps
                both.append(loss())
                model.p[name][at] -= eps
            told.append(g[at])
            want.append((both[0] - both[1]) / 0.02)
    told, want = np.array(told), np.array(want)
    scale = (told @ want) / (told @ told)  # long gradients are cut to length 1
    assert scale > 0.99 and np.allclose(scale * told, want, rtol=0.02, atol=1e-4)


def test_language_model_learns_from_all_documents(spark):
    rng = np.random.default_rng(4)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    order = {i: " ".join(f"v{(i + j) % 12}" for j in range(60)) for i in range(2000)}
    mixed = {**order, held[0]: " ".join(rng.permutation(order[held[0]].split()))}
    assert sorted(mixed[held[0]].split()) == sorted(order[held[0]].split())
    d = spark.createDataFrame(list(mixed.items()), "doc_id long, text string")
    got = by_id(rnn_lm.score_texts(d, sample_docs=1))
    assert got[held[1]]["base_score"] - got[held[0]]["base_score"] < 1 and got[held[1]]["score"] > got[held[0]]["score"] + 15
    own = blocks.documents(d)
    model = rnn_lm.train(own, np.ones(1024), lambda k: (k % np.uint64(1022)).astype(np.int64) + 2, 1, 5, 1)
    assert model.seen == got[0]["train_tokens"] == 61 * (2000 - len(held))
    assert rnn_lm.classes_of(0) == 32 < rnn_lm.classes_of(10**9) < rnn_lm.classes_of(3 * 10**10)


def test_neighbours_recall_ties_and_odd_vectors(spark):
    x = np.random.default_rng(2).standard_normal((3000, 16))
    x[100:140] = 2 * x[100] / np.linalg.norm(x[100]) * 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (None, [1.0] * 16), (5060, [1.0, None] * 8)]
    got = forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = collections.defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = r["vec_id"]
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20].tolist()) & set(found[q].values()))
    assert hits / (150 * 20) >= 0.9 and set(found) == set(range(0, 3000, 20))
    assert [found[100][k] for k in range(1, 21)] == list(range(101, 121))
    assert forest.nearest_neighbours(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).count() == 1


def test_neighbours_of_many_lengths_and_equal_vectors(spark):
    rows = [(20 * d + j, [1.0 + j] * d) for d in range(1, 81) for j in (0, 1)] + [(5000 + i, [9.0] * 80) for i in range(300)] * 2
    got = forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in got}
    assert all(near[20 * d, 1] == 20 * d + 1 for d in range(1, 80))
    assert [near[1600, k] for k in range(1, 21)] == list(range(5000, 5020))


def test_blocks_keep_a_key_and_its_counts(docs):
    b = blocks.Blocks(blocks.documents(docs), block_bytes=4096)
    rows = b.map(lambda ids, buf, offsets: {"doc_id": ids}, "doc_id long").collect()
    assert sorted(r["doc_id"] for r in rows) == [i * 7 for i in range(len(TEXTS))]


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = blocks.stage_table(stage(spark, docs, d))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 100, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).agg({"length": "max"}).first()[0] <= 2048


def test_pipeline_decides_for_each_row(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    both = docs.union(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    kept = p.keep_quality(spark, both, d).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == sorted(r["text"] for r in kept if r["doc_id"] is not None)
    a, b, c = _text(80), _text(80), _text(80)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda *rows: spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], schema)
    ids = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    rows = table((1, a), (1, a), (2, b), (2, c), (None, b), (None, LONG))
    assert ids(p.keep_one_of_each_class(spark, rows, d)) == sorted([(1, a), (2, b), (2, c), (0, LONG)])
    assert ids(p.drop_repeated_passages(spark, table((1, a), (1, a), (2, b), (2, c)), d)) == sorted([(1, a), (2, b), (2, c)])
    assert ids(p.drop_repeated_passages(spark, table((None, a), (None, a), (None, c)), d)) == sorted([(0, a), (0, c)])
    masked = p.mask_personal_data(spark, table((2, "mail a@b.com now"), (2, "no mail here"), (None, "or c@d.org too")), d)
    assert ids(masked) == [(0, "or <email> too"), (2, "mail <email> now"), (2, "no mail here")] and masked.columns == docs.columns
