"""Claim extraction on hand-made texts, archives, and streams against their batch views."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators import conversations, extract, search
from palaver.sources import archives
from palaver.streaming import live

CASES = {
    "from 20% to 30% of us": [("change", 50.0)],
    "it fell by 20 percent, then rose 5%": [("change", -20.0), ("change", 5.0)],
    "you save up to 40% of it": [("percent", 40.0)],
    "20% less likely": [("change", -20.0)],
    "15 to 30% of adults": [("percent", 22.5)],
    "12,5% of them": [("percent", 12.5)],
    "seventy five percent of people": [("percent", 75.0)],
    "one in five people": [("percent", 20.0)],
    "5 in 3 people": [],
    "3 times more likely": [("ratio", 3.0)],
    "3 times over": [],
    "a tenfold rise": [("ratio", 10.0)],
    "by a factor of 4": [("ratio", 4.0)],
    "twice as many": [("ratio", 2.0)],
    "I'm 100% sure": [],
    "I'm 100% with you": [],
    "100% of them": [("percent", 100.0)],
    "150% of them": [],
    "0.1% of people control most of the wealth": [("percent", 0.1)],
    "0.1% of people rule, but most of the rest obey": [("percent", 0.1), ("percent", 65.0)],
    "most people like half of it": [("percent", 65.0), ("percent", 50.0)],
    "nothing to see": [],
    "": [],
    "marks a5 and 10% of us": [("percent", 10.0)],
}


def test_claims_of_hand_made_texts(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(99, None)], "msg_id long, text string")
    got = {i: [] for i in range(len(CASES))}
    for r in extract.extract_claims(d).orderBy("msg_id", "start").collect():
        got[r["msg_id"]].append((r["kind"], round(r["value"], 4)))
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES


def test_subject_context_offset_and_limit(spark):
    d = spark.createDataFrame([(1, "Well, I think 70% of the people drink beer, often"), (2, "10% of a. " * 30)], "msg_id long, text string")
    r = extract.extract_claims(d).where("msg_id = 1").first()
    assert (r["start"], r["core"], r["subject"], r["context"]) == (14, "70%", "people drink beer", "I think 70% of the people drink beer")
    assert extract.extract_claims(d).where("msg_id = 2").count() == 20 and extract.extract_claims(d, limit=0).where("msg_id = 2").count() == 30
    assert len(extract.extract_claims(d).select(extract.claim_key(F.col("kind"), F.col("value"), F.col("subject")).alias("k")).first()["k"]) == 12


def test_claims_in_mythic_sentences_go(spark):
    d = spark.createDataFrame([(1, "10% of us. 20% of them.")], "msg_id long, text string")
    s = spark.createDataFrame([(1, 0, 10)], "msg_id long, start long, end long")
    assert [r["value"] for r in extract.outside_myths(extract.extract_claims(d), s).collect()] == [20.0]


@pytest.mark.parametrize("packed", [True, False])
def test_package_of_channels(spark, tmp_path, packed):
    files = {
        "messages/c1/channel.json": {"id": "1", "type": 1, "recipients": ["Ann", {"username": "Bo"}]},
        "messages/c1/messages.json": [{"ID": "5", "Timestamp": "2024-07-01 19:00:00", "Contents": "hi"}, {"ID": "6", "Timestamp": "2024-07-01 19:01:00", "Contents": ""}],
        "messages/c2/channel.json": {"id": "2", "type": 0, "guild": {"name": "club"}},
        "messages/c2/messages.json": [{"ID": "7", "Timestamp": "2024-07-02 19:00:00", "Contents": "yo"}],
        "messages/c3/messages.json": [{"ID": "8", "Timestamp": "2024-07-03 19:00:00", "Contents": "lone"}],
    }
    if packed:
        with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
            for n, c in files.items():
                z.writestr(n, json.dumps(c))
    else:
        for n, c in files.items():
            (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / n).write_text(json.dumps(c))
    got = archives.discord_export(spark, str(tmp_path / "p.zip" if packed else tmp_path), "me").orderBy("ts").collect()
    assert [(r["contact"], r["direction"], r["text"]) for r in got] == [("Ann, Bo", "sent", "hi"), ("club #2", "sent", "yo"), ("c3", "sent", "lone")]


def test_json_by_contact_and_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Ann": [{"From": "me", "date": "2024-07-01T19:00:00", "text": "x"}, {"contact": "Bo", "sender": "Bo", "date": "2024-07-01T19:00:00", "text": "y"}]}')
    got = sorted((r["contact"], r["direction"]) for r in archives.json_by_contact(spark, str(tmp_path / "a.json"), "me").collect())
    assert got == [("Ann", "sent"), ("Bo", "received")]
    for name, head in (("b.db", "SQLite format 3\0"), ("c.xml", "<smses/>"), ("d.json", '{"participants": []}'), ("e.csv", "a,b"), ("f.log", "01/07/2024, 19:00 - Ann: hi"), ("g.bin", "zzz")):
        (tmp_path / name).write_text(head)
    got = {r["path"].rsplit("/", 1)[1]: r["format"] for r in archives.sniff(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "json", "b.db": "imessage", "c.xml": "sms", "d.json": "meta", "e.csv": "csv", "f.log": "whatsapp", "g.bin": None}


def _messages(spark, n=60):
    t0 = datetime(2024, 3, 4, 10)
    rows = [(i, f"c{i % 3}", "me" if i % 2 else "x", "sent" if i % 2 else "received", t0 + timedelta(hours=i * (7 if i % 10 == 0 else 1)), "10% of us" if i % 4 else "hello", "t") for i in range(n)]
    return spark.createDataFrame(rows, live.SCHEMA)


def _all(query):
    query.processAllAvailable()
    query.stop()


def test_streamed_conversations_equal_the_batch_view(spark, tmp_path):
    m = _messages(spark)
    m.write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(10**6, "end", "x", "received", datetime(2030, 1, 1), "bye", "t")], live.SCHEMA)
    q = live.sessions(live.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    end.write.mode("append").parquet(str(tmp_path / "in"))
    _all(q)
    ours = sorted((r["contact"], r["start"], r["end"], r["n"]) for r in spark.table("sess").collect() if r["contact"] != "end")
    batch = conversations.split_conversations(conversations.adjacency(m))
    assert ours == sorted((r["contact"], r["start"], r["end"], r["n"]) for r in batch.collect())


def test_streamed_append_is_idempotent(spark, tmp_path):
    m = _messages(spark)
    m.union(m).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):
        live.append_stream(live.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / checkpoint), available_now=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == search.identity_dedupe(m).count()


def test_streamed_claims_come_once(spark, tmp_path):
    _messages(spark).write.parquet(str(tmp_path / "in"))
    q = live.new_claims(live.read_stream(spark, str(tmp_path / "in")), "365 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    _all(q)
    assert sorted(r["contact"] for r in spark.table("once").collect()) == ["c0", "c1", "c2"]
