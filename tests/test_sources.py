"""Readers on generated files: a phone's database, archives, backups, text exports; spelling and kept views."""

import io
import json
import sqlite3
import zipfile
from datetime import datetime, timedelta

import pytest

from palaver.operators import lexical, search, volume
from palaver.sources import archives, exports, phone
from palaver.streaming import live


def body(text: bytes, size: bytes) -> bytes:
    return b"\x04\x0bstreamtyped\x81\xe8\x03NSString\x01\x94\x84\x01+" + size + text


def database(path, view=False, generated=False):
    db = sqlite3.connect(path)
    extra = ", twice INTEGER GENERATED ALWAYS AS (date * 2) VIRTUAL" if generated else ""
    name = "real_message" if view else "message"
    db.execute(f"CREATE TABLE {name} (ROWID INTEGER PRIMARY KEY, date INTEGER, is_from_me INTEGER, text TEXT, attributedBody BLOB, handle_id INTEGER{extra})")
    if view:
        db.execute("CREATE VIEW message AS SELECT * FROM real_message")
    db.execute("CREATE TABLE handle (ROWID INTEGER PRIMARY KEY, id TEXT)")
    db.execute("CREATE TABLE chat (ROWID INTEGER PRIMARY KEY, chat_identifier TEXT, display_name TEXT)")
    db.execute("CREATE TABLE chat_message_join (chat_id INTEGER, message_id INTEGER)")
    db.execute("INSERT INTO handle VALUES (1, '+15550001')")
    db.executemany("INSERT INTO chat VALUES (?, ?, ?)", [(1, "+15550001", ""), (2, "chat2", "Club")])
    long = "é" * 200
    rows = [
        (1, 741_550_800, 0, "hi", None, 1), (2, 741_550_860 * 10**9, 1, None, body("héllo".encode(), bytes([6])), None), (3, 741_550_900, 0, "", body(long.encode(), b"\x81" + len(long.encode()).to_bytes(2, "little")), 1),
        (4, 741_550_950, 0, None, b"no string here", 1), (5, None, 0, "no time", None, 1), (9, 741_551_000, 0, "last", None, 7),
    ]
    db.executemany(f"INSERT INTO {name} (ROWID, date, is_from_me, text, attributedBody, handle_id) VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.executemany("INSERT INTO chat_message_join VALUES (?, ?)", [(1, 1), (2, 1), (2, 2), (1, 3), (1, 4)])
    db.commit()
    db.close()
    return long


def test_phone_database_by_row_ranges(spark, tmp_path):
    long = database(tmp_path / "chat.db")
    d = exports.read_messages(spark, str(tmp_path / "chat.db"), "imessage", "Sam")
    got = sorted((r["text"], r["contact"], r["sender"], r["direction"]) for r in d.collect())
    assert got == sorted([("hi", "+15550001", "+15550001", "received"), ("héllo", "Club", "Sam", "sent"), (long, "+15550001", "+15550001", "received"), ("last", "Unknown", "Unknown", "received")])
    assert {r["ts"] for r in d.where("text = 'hi'").collect()} == {datetime(2024, 7, 1, 18, 20)} and d.where("text = 'héllo'").first()["ts"] == datetime(2024, 7, 1, 18, 21)
    small = phone.chat_database(spark, str(tmp_path / "chat.db"), "Sam", rows=2)
    assert small.rdd.getNumPartitions() == 5 and small.count() == 4


@pytest.mark.parametrize("how", [{"view": True}, {"generated": True}])
def test_phone_database_that_could_compute_is_refused(spark, tmp_path, how):
    database(tmp_path / "chat.db", **how)
    with pytest.raises(Exception, match="not a table|generated column"):
        phone.chat_database(spark, str(tmp_path / "chat.db"), "Sam").count()


def test_a_slow_query_is_cut_off(tmp_path):
    database(tmp_path / "chat.db")
    db = sqlite3.connect(tmp_path / "chat.db")
    db.execute("WITH RECURSIVE n(i) AS (SELECT 100 UNION ALL SELECT i + 1 FROM n WHERE i < 60000) INSERT INTO message (ROWID, date, is_from_me, text) SELECT i, i, 0, 'x' FROM n")
    db.commit()
    reader = phone.ChatReader({"path": str(tmp_path / "chat.db"), "seconds": "0"})
    with pytest.raises(phone.UnexpectedDatabase):
        list(reader.read(phone.RowRange(0, 60000)))


def test_typed_bodies(spark):
    cases = {
        "short": (body(b"abc", bytes([3])), "abc"), "two bytes": (body(b"y" * 300, b"\x81\x2c\x01"), "y" * 300), "cut": (body("é".encode(), bytes([1])), ""), "controls": (body(b"a\x00b\nc", bytes([5])), "ab\nc"),
        "none": (b"", ""), "null": (None, ""), "other": (b"xyz", ""), "ends": (b"NSString", ""), "longer than there is": (body(b"ab", bytes([90])), "ab"), "broken": (body(b"a\xffb", bytes([3])), "ab"), "written": (body("a�b".encode(), bytes([5])), "a�b"),
    }
    d = spark.createDataFrame([(k, b) for k, (b, _) in cases.items()], "k string, body binary")
    assert {r["k"]: r["t"] for r in d.select("k", phone.typed_text(d["body"]).alias("t")).collect()} == {k: t for k, (_, t) in cases.items()}


THREAD = {"participants": [{"name": "Alex"}, {"name": "Sam"}], "title": "Alex", "thread_path": "inbox/alex_1", "messages": [{"sender_name": "Alex", "timestamp_ms": 1704229200000, "content": "cafÃ© later?"}, {"sender_name": "Sam", "timestamp_ms": 1704229260000, "content": "yes"}, {"sender_name": "Alex", "timestamp_ms": 1704229320000}]}
CHAT = {"name": "Alex", "type": "personal_chat", "messages": [{"type": "message", "date": "2024-01-02T21:00:00", "from": "Alex", "from_id": "user2", "text": ["see ", {"type": "link", "text": "this"}]}, {"type": "service", "date": "2024-01-02T21:00:30", "text": "joined"}, {"type": "message", "date_unixtime": "1704229260", "from": "Other", "from_id": "user1", "text": "ok"}]}
EXPORT = {"personal_information": {"user_id": 1, "first_name": "Sam"}, "chats": {"list": [CHAT, {"name": "News", "type": "public_channel", "messages": [{"type": "message", "date": "2024-01-02T21:00:00", "from": "N", "text": "x"}]}]}}


def packed(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_zipped_threads_and_chats(spark, tmp_path):
    z = packed(tmp_path / "meta.zip", {"messages/inbox/alex_1/message_1.json": THREAD, "other.json": {"a": 1}, "messages/inbox/b/message_1.json": "{ broken"})
    rows = exports.read_messages(spark, z, "meta", "sam").orderBy("ts").collect()
    assert [(r["text"], r["direction"], r["sender"]) for r in rows] == [("café later?", "received", "Alex"), ("yes", "sent", "sam")]
    z = packed(tmp_path / "telegram.zip", {"export/result.json": EXPORT, "export/else.json": CHAT})
    rows = exports.read_messages(spark, z, "telegram", "nobody").orderBy("ts").collect()
    assert [(r["text"], r["direction"], r["contact"]) for r in rows] == [("see this", "received", "Alex"), ("ok", "sent", "Alex")]
    (tmp_path / "one.json").write_text(json.dumps(CHAT))
    assert [r["direction"] for r in exports.read_messages(spark, str(tmp_path / "one.json"), "telegram", "Other").orderBy("ts").collect()] == ["received", "sent"]
    found = {r["path"].rsplit("/", 1)[1]: r["format"] for r in archives.sniff(spark, str(tmp_path)).collect()}
    assert found == {"meta.zip": "meta", "telegram.zip": "telegram", "one.json": "telegram"}


def test_backups_with_pictures_and_refused_ones(spark, tmp_path):
    good = """<?xml version='1.0' encoding='UTF-8'?><smses count="3"><sms address="+1" date="1704229200000" type="2" body="hi" contact_name="(Unknown)" />
<mms address="+2" date="1704229260000" msg_box="1" contact_name="Bo"><parts><part ct="image/png" text="null"/><part ct="text/plain" text="one"/><part ct="text/plain; x" text="two"/></parts></mms>
<mms address="+2" date="1704229290000" msg_box="2" contact_name="Bo"><parts><part ct="image/png"/></parts></mms></smses>"""
    (tmp_path / "a.xml").write_text(good)
    (tmp_path / "b.xml").write_text("<?xml version='1.0'?><!DOCTYPE s [<!ENTITY x 'y'>]><smses><sms address='+1' date='1704229200000' type='1' body='&x;'/></smses>")
    (tmp_path / "c.xml").write_bytes(good.encode("utf-16"))
    assert {r["file"].rsplit("/", 1)[1] for r in exports.refused_backups(spark, str(tmp_path)).collect()} == {"b.xml", "c.xml"}
    rows = exports.read_messages(spark, str(tmp_path), "sms", "Sam").orderBy("ts").collect()
    assert [(r["contact"], r["sender"], r["text"], r["source"]) for r in rows] == [("+1", "Sam", "hi", "sms"), ("Bo", "Bo", "one\ntwo", "mms")]
    with pytest.raises(ValueError, match="entities"):
        exports.read_messages(spark, str(tmp_path / "b.xml"), "sms", "Sam")


def test_text_exports_of_several_formats_and_one_given_up(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1/2/24, 9:15 PM - Alex: hey\nsecond line\n1/2/24, 9:16 PM - notice\n1/2/24, 9:17PM - Sam: hi\n")
    (tmp_path / "b.txt").write_text("2024/03/25, 21:15 - Alex: year first\n25/3/24, 21:16 - Alex: day first\n")
    (tmp_path / "c.txt").write_text("".join("99/99/9999, 99:99 - a: x\n" for _ in range(1001)) + "1/2/24, 9:15 PM - a: never\n")
    d = exports.read_messages(spark, str(tmp_path), "whatsapp", "Sam")
    assert sorted((r["text"], str(r["ts"])) for r in d.collect()) == [("day first", "2024-03-25 21:16:00"), ("hey\nsecond line", "2024-01-02 21:15:00"), ("hi", "2024-01-02 21:17:00"), ("year first", "2024-03-25 21:15:00")]
    assert [(r["file"].rsplit("/", 1)[1], r["unread"]) for r in exports.unreadable_exports(spark, str(tmp_path), "Sam").collect()] == [("c.txt", 1001)]


def test_json_lists_beside_other_keys(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 3, "messages": [{"chat": "A", "isFromMe": "1", "date_sent": "2024-01-01T10:00:00", "body": "hi"}]}))
    (r,) = exports.read_messages(spark, str(tmp_path / "m.json"), "json", "Sam").collect()
    assert (r["contact"], r["direction"], r["text"]) == ("A", "sent", "hi")


def test_two_edit_suggestions_are_rationed(spark):
    t0 = datetime(2024, 3, 1, 9)
    short = ["qzxvbk", "xqzvkb", "vkqzxb", "bzqxvk"]
    texts = [w for w in ["q" + "zxvkbw" * 7] for _ in range(5)] + [w for w in short for _ in range(4)] + ["definitly"] * 2 + ["defintly"] * 2
    m = spark.createDataFrame([(i, "Alex", "me", "sent", t0 + timedelta(minutes=i), t, "t") for i, t in enumerate(texts)], "msg_id long, contact string, sender string, direction string, ts timestamp_ntz, text string, source string")
    words = ["definitely", "quiz", "weather"]
    got = {r["word"]: r["suggestion"] for r in lexical.misspellings_words(m, words).collect()}
    # three words were granted the far search, and all of them are junk
    assert got["definitly"] == "definitely" and got["defintly"] is None
    alone = m.where("text like 'def%'")
    assert {r["word"]: r["suggestion"] for r in lexical.misspellings_words(alone, words).collect()} == {"definitly": "definitely", "defintly": "definitely"}
    table = spark.createDataFrame([(w,) for w in words], "lw string")
    assert {r["word"]: r["suggestion"] for r in lexical.misspellings_words(alone, table).collect()} == {"definitly": "definitely", "defintly": "definitely"}


def test_words_leave_out_links_and_slang(spark):
    m = spark.createDataFrame([(1, "A", "me", "sent", datetime(2024, 1, 1), "see https://example.com/x @anna #trip btw ok ⭐ ⬅ ⭕", "t")], "msg_id long, contact string, sender string, direction string, ts timestamp_ntz, text string, source string")
    assert {r["word"] for r in lexical.word_frequency(m, limit=None, min_len=1).collect()} == {"see", "btw", "ok"}
    assert lexical.emoji_totals(m).first()["total"] == 3 and {r["lw"] for r in lexical.noise_words(m).collect()} == {"btw", "ok"}
    card = search.wrapped(m, 2024).first()
    assert card["words_written"] == 3 and not card["empty"] and search.wrapped(m, 1990).first()["empty"]


def test_kept_contacts_equal_the_batch_view(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"c{i % 4}", "me" if i % 3 else "x", "sent" if i % 3 else "received", t0 + timedelta(hours=(i * 7) % 50), f"word {i % 5}", "t") for i in range(60)]
    m = spark.createDataFrame(rows, live.SCHEMA)
    for part in ("msg_id < 25", "msg_id >= 25 and msg_id < 40 and contact <> 'c1'", "msg_id >= 40 or (msg_id >= 25 and contact = 'c1')"):
        m.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.keep_contacts(live.read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "table"), str(tmp_path / "view"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    now, want = live.contacts_now(spark, str(tmp_path / "view")), volume.contact_frequency(m)
    assert sorted(now.collect()) == sorted(want.select(*now.columns).collect())
    assert spark.read.parquet(str(tmp_path / "view")).select("version").distinct().count() > 1


def test_an_archive_with_a_swollen_index_is_refused(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        info = zipfile.ZipInfo("message_1.json")
        info.comment = b"x" * 60_000
        for i in range(3):
            z.writestr(info if not i else zipfile.ZipInfo(f"{i}.json"), "{}")
        z.comment = b"y" * 60_000
    (tmp_path / "z.zip").write_bytes(buf.getvalue())
    with pytest.raises(Exception, match="bounds"):
        archives.json_members(spark, str(tmp_path / "z.zip")).count()
