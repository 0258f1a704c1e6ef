"""Checks, myths, appeals, parallels and packs on hand-made texts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators import claims, extract, recent, verdicts
from palaver.sources import packs

SHAPES = {
    "Crime went up 40% last year": [("change", 40.0)],
    "Coffee drinkers are 20% less likely to get diabetes": [("change", -20.0)],
    "It's up 300 percent": [("change", 300.0)],
    "prices fell by about 8 percent": [("change", -8.0)],
    "it increases your risk of cancer by 20%": [("change", 20.0)],
    "a 30% increase in crime": [("change", 30.0)],
    "a 30% reduction": [("change", -30.0)],
    "spiked 40%": [("change", 40.0)],
    "rose by roughly 20%": [("change", 20.0)],
    "up to 40% of people": [("percent", 40.0)],
    "up 0% of it": [("percent", 0.0)],
    "the score went up by 3.": [],
    "Smoking increases your risk of cancer by 15 to 30 times": [("ratio", 22.5)],
    "20-30% of people": [("percent", 25.0)],
    "15—30% of us": [("percent", 22.5)],
    "50 pct of us": [("percent", 50.0)],
    "a three-fold rise": [("ratio", 3.0)],
    "by a factor of about 3": [("ratio", 3.0)],
    "3x faster": [("ratio", 3.0)],
    "I'm 90 percent certain": [],
    "one hundred percent of people who drink water die": [("percent", 100.0)],
    "80 percent of crime is committed by 5 percent of people": [("percent", 80.0), ("percent", 5.0)],
    "no one cares": [("percent", 1.0)],
    "two-thirds of us": [("percent", 67.0)],
    "she texted me 5 times later that night": [],
    "we met 3 times per week": [],
    "seventy% of people": [("percent", 70.0)],
    "1,500 people came": [],
    "see you at 8 tonight, bring 2 friends": [],
    "1 in every 4": [("percent", 25.0)],
}
#: Text, the fact that checks it and the verdict; None where there is none.
CHECKED = {
    "70% of people drink beer": ("alcohol-us", "close"),
    "seventy percent of individuals drink beer": ("alcohol-us", "close"),
    "1 in 5 adults have a tattoo": ("tattoo-us", "off"),
    "About a third of Americans are obese": ("obese-us", "off"),
    "most people drink coffee": ("coffee-us", "fair"),
    "70% of the earth is covered by water": ("earth-water", "fair"),
    "the human body is 60% water": ("body-water", "fair"),
    "30% of the world has no clean water": ("unsafe-water", "fair"),
    "Most Americans can't afford a $400 emergency": ("mo-emergency", "off"),
    "NBA players hit 90% of free throws": ("sp-free-throw", "off"),
    "70% of people don't drink beer": None,
    "70% of Brits drink beer": None,
    "70% of cars are red": None,
    "70% of beer drinkers don't read books": None,
    "Unemployment is at 3.5%": None,
    "Crime went up 40% last year": None,
}


def texts(spark, listed):
    return spark.createDataFrame(list(enumerate(listed)), "msg_id long, text string")


@pytest.fixture(scope="module")
def book(spark):
    return packs.open_book(spark, enabled=["money", "sports"])


def test_shapes_of_claims(spark):
    got = {i: [] for i in range(len(SHAPES))}
    for r in extract.extract_claims(texts(spark, SHAPES)).orderBy("msg_id", "start").collect():
        got[r["msg_id"]].append((r["kind"], round(r["value"], 4)))
    assert {t: got[i] for i, t in enumerate(SHAPES)} == SHAPES


def test_checks_and_parallels(spark, book):
    rows = verdicts.analyse(texts(spark, CHECKED), book, per_claim=5).collect()
    got = dict.fromkeys(range(len(CHECKED)))
    for r in rows:
        if r["part"] == "check":
            got[r["msg_id"]] = (r["fact_id"], r["verdict"])
    assert {t: got[i] for i, t in enumerate(CHECKED)} == CHECKED
    lines = {(r["msg_id"], r["part"]): r["line"] for r in rows}
    assert "8 points high" in lines[0, "check"] and "12 points low" in lines[2, "check"] and "“a third” is too low" in lines[3, "check"]
    # the fact that checks a claim is never its parallel; changes meet multiples only
    for i, want in enumerate(CHECKED.values()):
        met = {r["fact_id"] for r in rows if r["msg_id"] == i and r["part"] == "parallel"}
        assert met and (want is None or want[0] not in met)
    ratios = {f["id"] for f in book.facts if f["kind"] == "ratio"}
    assert {r["fact_id"] for r in rows if r["kind"] == "change"} <= ratios
    assert not any("{" in (r["line"] or "") for r in rows)


def test_myths_and_appeals(spark, book):
    examples = [(m["id"], e) for m in book.myths for e in m["examples"]]
    plain = ["my dog is 7 years old", "he has blue blood", "10% of my salary goes on rent", "the bats are in the shed", "she shaved this morning"]
    d = texts(spark, [e for _, e in examples] + plain)
    got = {i: [] for i in range(len(examples) + len(plain))}
    for r in claims.myths_in(d, book).collect():
        got[r["msg_id"]].append(r["myth"])
    assert [got[i] for i in got] == [[m] for m, _ in examples] + [[] for _ in plain]
    talk = ["You only use 10% of your brain. Also 70% of people drink beer.", "Studies show it's bad for you", "It's been proven that 97% of scientists agree", "everyone knows that the earth is flat"]
    rows = verdicts.analyse(texts(spark, talk), book).collect()
    assert {r["part"] for r in rows if r["msg_id"] == 0} == {"myth", "check", "parallel"} and {r["value"] for r in rows if r["msg_id"] == 0 and r["value"]} == {70.0}
    assert [(r["part"], r["kind"]) for r in rows if r["msg_id"] == 1] == [("appeal", "authority")]
    assert [r["kind"] for r in rows if r["msg_id"] == 2 and r["part"] == "appeal"] == ["proof"]
    assert [r["part"] for r in rows if r["msg_id"] == 3] == ["myth"]


def test_a_session_answers_once(spark, book):
    d = spark.createDataFrame([("s", 1, "70% of people like it"), ("s", 2, "like I said, 70% of people like it. Everyone knows that"), ("s", 3, "everyone knows that"), ("t", 4, "70% of people like it")], "session string, msg_id long, text string")
    rows = verdicts.analyse(d, book, keep=["session", "msg_id"], session=["session"]).collect()
    assert {r["msg_id"] for r in rows if r["part"] == "parallel"} == {1, 4} and [r["msg_id"] for r in rows if r["part"] == "appeal"] == [2]


def test_empty_and_null_texts(spark, book):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "   \n"), (None, "70% of people drink beer")], "msg_id long, text string")
    assert {r["msg_id"] for r in verdicts.analyse(d, book).collect()} == {None}
    assert verdicts.analyse(d.where("false"), book).count() == 0


def test_numbers_in_lines(spark):
    d = spark.createDataFrame([(0.0,), (70.0,), (12.5,), (100.0,), (33.3333333,), (0.1,), (1234567.0,)], "x double")
    assert [r[0] for r in d.select(verdicts.general(F.col("x"))).collect()] == ["0", "70", "12.5", "100", "33.3333", "0.1", "1234570"]


def test_packs_of_a_folder(spark, tmp_path):
    fact = {"id": "a", "kind": "percent", "value": 5.0, "statement": "A", "short": "a", "source": "s", "year": 2020, "tags": ["x"]}
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "facts": [{**fact, "value": 7.0}, {**fact, "id": "c"}]}))
    (tmp_path / "z.json").write_text(json.dumps({"id": "base", "always_on": True, "facts": [fact]}))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "l.json").write_text(json.dumps({"id": "shut", "facts": [{**fact, "id": "d"}], "myths": [{"id": "m", "patterns": ["moon"]}]}))
    p = packs.packs(spark, str(tmp_path), enabled=["b", "shut"], locked=["shut"])
    # what is always on comes first and wins; a locked pack gives nothing
    assert [(r["id"], r["value"], r["pack"]) for r in packs.facts(p).orderBy("ord").collect()] == [("a", 5.0, "base"), ("c", 5.0, "b")]
    assert packs.myths(p).count() == 0 and packs.myths(packs.packs(spark, str(tmp_path), enabled=["shut"])).count() == 1
    assert {r["id"]: (r["enabled"], r["locked"]) for r in packs.pack_list(p).collect()} == {"base": (True, False), "b": (True, False), "shut": (False, True)}
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "house.json").write_text(json.dumps({"id": "house", "percent": ["{fact}."], "ratio": ["{fact}."], "fallacy_percent": ["x"]}))
    (tmp_path / "v" / "odd.json").write_text(json.dumps({"percent": ["{fact}!"]}))
    (tmp_path / "v" / "bad.json").write_text("{ not json")
    b = packs.open_book(spark, str(tmp_path), voice="odd", voice_path=str(tmp_path / "v"))
    assert b.voice["percent"] == ["{fact}!"] and b.voice["fallacy_percent"] == ["x"]
    assert packs.open_book(spark, str(tmp_path), voice="unknown", voice_path=str(tmp_path / "v")).voice["percent"] == ["{fact}."]


def test_every_voice_says_every_shape(spark):
    d = texts(spark, ["70% of people drink beer", "most people agree", "3 times more likely to crash", "prices fell 20%", "You only use 10% of your brain", "Studies show it", "Everyone knows", "It's proven", "Millions of people agree"])
    for voice in ("house", "formal"):
        b = packs.open_book(spark, voice=voice)
        rows = verdicts.analyse(d, b).collect()
        assert {r["msg_id"] for r in rows} == set(range(9)) and all(r["line"] and "{" not in r["line"] for r in rows)


def test_topics_name_facts_that_exist(spark, book):
    known = {f["id"]: f["kind"] for f in book.facts}
    assert all(known[i] == "percent" for t in book.topics for i in t["facts"])


def plain_recent(rows, book, k):
    """Each claim's choice by a loop over all facts."""
    out, lately = [], {}
    for r in rows:
        tol = 5.0 if r["kind"] != "percent" else 12.0 if r["quantifier"] == "vague" else 6.0
        import math

        size = max(max(1 + r["value"] / 100, 0.01), 1 / max(1 + r["value"] / 100, 0.01)) if r["kind"] == "change" else r["value"]
        scored = []
        for f in book.facts:
            if (f["kind"] == "percent") == (r["kind"] == "percent"):
                gap = abs(size - f["value"]) if r["kind"] == "percent" else 10 * abs(math.log(size) - math.log(f["value"]))
                scored.append((gap > tol, f["id"] in lately.get(r["contact"], []), gap, f["ord"], f["id"]))
        for rank, x in enumerate([x for x in sorted(scored)[:k] if x[-1] != r["fact_id"]], 1):
            lately[r["contact"]] = (lately.get(r["contact"], []) + [x[-1]])[-12:]
            out.append((r["msg_id"], rank, x[-1]))
    return out


def test_recent_facts_rank_behind_in_batch_and_stream(spark, book, tmp_path):
    said = ["70% of people drink beer", "70% of cars are red", "it rose 40%", "3 times faster", "most people drink coffee", "71% of it is gone", "nobody came", "crime fell 30%", "1 in 5 adults have a tattoo", "68% of us agree"]
    t0 = datetime(2024, 1, 1)
    rows = [(f"c{i % 3}", t0 + timedelta(minutes=i), i, said[i % len(said)]) for i in range(60)]
    m = spark.createDataFrame(rows, "contact string, ts timestamp_ntz, msg_id long, text string")
    checked = verdicts.checked_claims(m, book, ["contact", "ts", "msg_id"])
    want = sorted(plain_recent([r.asDict() for r in checked.orderBy("ts", "start").collect()], book, 2))
    got = recent.without_repeats(checked, book)
    assert sorted((r["msg_id"], r["rank"], r["fact_id"]) for r in got.collect()) == want
    table = tmp_path / "claims"
    stored = checked.select(*recent.KEYS, "kind", "value", "quantifier", "fact_id")
    for i in range(3):  # files in order of time
        stored.where(f"msg_id >= {20 * i} and msg_id < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(table))
    stream = recent.stream_without_repeats(spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(table)), book)
    stream.writeStream.format("memory").queryName("lately").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["msg_id"], r["rank"], r["fact_id"]) for r in spark.table("lately").collect()) == want
