"""Views on small hand-made tables, and every registered query against its SQL."""

import glob
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from palaver.functions.text import emoji_of, is_media, whole_word, words_of
from palaver.operators import conversations, lexical, search, volume
from palaver.plans.catalogue import ORACLE_SQL, QUERIES
from palaver.sources import decode, exports

SCHEMA = "msg_id long, contact string, sender string, direction string, ts timestamp_ntz, text string, source string"
T0 = datetime(2024, 3, 4, 10)


def messages(spark, rows):
    """(hours after the start, direction, text)"""
    return spark.createDataFrame([(i, "ann", "me" if d == "sent" else "ann", d, T0 + timedelta(hours=h), t, "test") for i, (h, d, t) in enumerate(rows)], SCHEMA)


def test_gap_of_exactly_six_hours_stays_in_one_conversation(spark):
    m = messages(spark, [(0, "sent", "a"), (6, "received", "b"), (12.001, "sent", "c")])
    assert conversations.split_conversations(conversations.adjacency(m)).count() == 2


def test_twelve_hours_is_still_a_reply_and_days_are_crossed(spark):
    m = messages(spark, [(0, "received", "a"), (12, "sent", "b"), (24.5, "received", "c")])
    r = conversations.reply_latency(conversations.adjacency(m)).first()
    assert (r["you_n"], r["them_n"], r["you_micros"]) == (1, 0, 12 * 3_600_000_000)


def test_double_texts_silence_and_summary(spark):
    m = messages(spark, [(0, "sent", "a"), (0.1, "sent", "b"), (0.2, "received", "c"), (216.2, "sent", "d")])
    r = conversations.conversation_health(conversations.adjacency(m)).first()
    assert (r["conversations"], r["your_double_texts"], r["longest_silence_days"]) == (2, 1, 9.0)
    assert conversations.conversation_summary(conversations.conversation_health(conversations.adjacency(m))).first()["ghosted_by"] is None


def test_empty_table_and_single_message(spark):
    none = messages(spark, [(0, "sent", "a")]).where("false")
    assert volume.overview(none).first()["total"] == 0 and volume.by_hour(none).count() == 24
    assert conversations.conversation_health(conversations.adjacency(none)).count() == 0
    assert conversations.conversation_health(conversations.adjacency(messages(spark, [(0, "sent", "a")]))).first()["longest_silence_days"] == 0.0


def test_streak_takes_the_earliest_of_equal_runs(spark):
    r = volume.longest_streak(messages(spark, [(24 * d, "sent", "x") for d in (0, 1, 2, 5, 6, 7)])).first()
    assert (r["days"], str(r["start"])) == (3, "2024-03-04")


def test_text_expressions(spark):
    d = spark.createDataFrame([("can’t stop 2day café", "<Media omitted>", "👍🏽🇩🇪👨‍👩‍👧")], "a string, b string, c string")
    r = d.select(words_of(F.col("a")).alias("w"), is_media(F.col("b")).alias("m"), F.size(emoji_of(F.col("c"))).alias("e"), whole_word(F.col("a"), "can't").alias("x"), whole_word(F.col("a"), "stop 2").alias("y")).first()
    assert r["w"] == ["can't", "stop", "day", "caf"] and r["m"] and r["e"] == 3 and r["x"]


def test_spelling_suggests_swapped_and_missing_letters(spark):
    d = spark.createDataFrame([("teh",), ("recieved",), ("brige",)], "lw string")
    got = {r["lw"]: r["suggestion"] for r in lexical.suggestions(d, ["the", "received", "bridge"]).collect()}
    assert got == {"teh": "the", "recieved": "received", "brige": "bridge"}


def test_dedupe_and_append_are_idempotent(spark, tmp_path):
    m = messages(spark, [(0, "sent", "a"), (0, "sent", "a"), (1, "received", "b")])
    assert search.identity_dedupe(m).count() == 2
    search.identity_dedupe(m).write.parquet(str(tmp_path / "t"))
    assert search.append(str(tmp_path / "t"), m) == 0


def test_timestamps_of_all_shapes_name_one_instant(spark):
    d = spark.createDataFrame([("1719874800000",), ("1719874800",), ("2024-07-01T23:00:00Z",)], "t string")
    got = {str(r[0]) for r in d.select(decode.timestamp(F.col("t"), "America/New_York")).collect()}
    assert got == {"2024-07-01 19:00:00"}


def test_mojibake_is_repaired_and_the_rest_left(spark):
    d = spark.createDataFrame([("cafÃ©",), ("café",), ("日本",), ("plain",)], "t string")
    assert [r[0] for r in d.select(decode.repair(F.col("t"))).collect()] == ["café", "café", "日本", "plain"]


def test_text_export_with_continuation_and_notice(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("01/07/2024, 19:00 - Ann: hi\nthere\n13/07/2024, 19:05 - Me: yo\n13/07/2024, 19:06 - Messages are encrypted\nlost\n14/07/2024, 8:00 pm - Ann: <Media omitted>\n")
    r = exports.read_messages(spark, str(tmp_path / "chat.txt"), "whatsapp", "me").orderBy("ts").collect()
    assert [(x["contact"], x["direction"], x["text"]) for x in r] == [("Ann", "received", "hi\nthere"), ("Ann", "sent", "yo"), ("Ann", "received", "<Media omitted>")]
    assert str(r[0]["ts"]) == "2024-07-01 19:00:00" and str(r[2]["ts"]) == "2024-07-14 20:00:00"


def test_csv_json_sms_and_chat_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Chat,From,Date,Message\nAnn,me,2024-07-01 19:00:00,hello\nAnn,Ann,1719874800,\n")
    (tmp_path / "a.json").write_text('[{"contact":"Ann","sender":"Ann","timestamp":"2024-07-01T19:00:00","text":"hey"}]')
    (tmp_path / "a.xml").write_text('<smses><sms address="1" date="1719874800000" type="2" body="yes" contact_name="Ann"/></smses>')
    (tmp_path / "m.json").write_text('{"participants":[{"name":"Ann"},{"name":"Me"}],"title":"Ann","thread_path":"inbox/x","messages":[{"sender_name":"Ann","timestamp_ms":1719874800000,"content":"cafÃ©"}]}')
    (tmp_path / "t.json").write_text('{"personal_information":{"user_id":7,"first_name":"Me"},"chats":{"list":[{"name":"Ann","type":"personal_chat","messages":[{"type":"message","date":"2024-07-01T19:00:00","from":"Me","from_id":"user7","text":["a ",{"type":"bold","text":"b"}]}]}]}}')
    got = {f: [(x["contact"], x["direction"], x["text"]) for x in exports.read_messages(spark, str(tmp_path / p), f, "me").collect()] for f, p in (("csv", "a.csv"), ("json", "a.json"), ("sms", "a.xml"), ("meta", "m.json"), ("telegram", "t.json"))}
    assert got == {"csv": [("Ann", "sent", "hello")], "json": [("Ann", "received", "hey")], "sms": [("Ann", "sent", "yes")], "meta": [("Ann", "received", "café")], "telegram": [("Ann", "sent", "a b")]}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    said = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    df = QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(str([tidy(r[c]) for c in columns]) for r in df.collect())
    assert ours == sorted(str([tidy(v) for v in r]) for r in said.fetchall())
