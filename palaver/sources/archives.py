"""Exports that come as archives or folders of JSON files, and the guess of a file's format."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decode

# Bounds of an archive.
MOST_MEMBERS, MOST_BYTES, MOST_MEMBER_BYTES, MOST_GROWTH, GROWTH_FREE = 50_000, 512 << 20, 64 << 20, 50, 32 << 20
# Bytes of an archive's index for each member, and what is free besides.
INDEX_BYTES, INDEX_FREE = 250, 64 << 10


def _unzip(contains: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = z.infolist()
                    # an index of many bytes a member is made to cost memory
                    if len(content) > INDEX_FREE and z.start_dir < len(content) - INDEX_FREE - INDEX_BYTES * max(1, len(infos)):
                        raise ValueError(f"archive {path} exceeds its bounds")
                    size = sum(i.file_size for i in infos)
                    if len(infos) > MOST_MEMBERS or size > MOST_BYTES or (size > GROWTH_FREE and size > MOST_GROWTH * len(content)):
                        raise ValueError(f"archive {path} exceeds its bounds")
                    for info in sorted(infos, key=lambda i: i.filename):
                        if info.filename.endswith(".json") and contains in info.filename:
                            if info.file_size > MOST_MEMBER_BYTES:
                                raise ValueError(f"{info.filename} in {path} is too large")
                            yield pd.DataFrame({"archive": [path], "member": [info.filename], "text": [z.read(info).decode("utf-8-sig", "replace")]})

    return run


def json_members(spark: SparkSession, path: str, contains: str = "") -> DataFrame:
    """archive, member and text of the JSON files in zip archives or in a folder; an archive is one task's work, of bounded size."""
    if path.endswith(".zip"):
        found = spark.read.format("binaryFile").load(path).select("path", "content")
        return found.mapInPandas(_unzip(contains), "archive string, member string, text string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return files.where(F.contains(name, F.lit(contains))).select(F.lit(path).alias("archive"), name.alias("member"), F.col("value").alias("text"))


def discord_export(spark: SparkSession, path: str, self_name: str, zone: str = "UTC") -> DataFrame:
    """A package of channel.json and messages.json by folder; it holds only what its owner sent. Broken JSON gives no rows."""
    folder = F.regexp_extract("member", "^(.*)/[^/]*$", 1)
    rows = F.from_json("text", "array<struct<ID string, Timestamp string, Contents string>>")
    messages = json_members(spark, path, "messages.json").select("archive", folder.alias("folder"), F.explode(rows).alias("m"))
    about = F.from_json("text", "struct<id string, recipients string, name string, guild struct<name string>>")
    channels = json_members(spark, path, "channel.json").select("archive", folder.alias("folder"), about.alias("c"))
    people = F.filter(F.transform(F.from_json("c.recipients", "array<string>"), lambda p: F.when(p.startswith("{"), F.get_json_object(p, "$.username")).otherwise(p)), lambda n: F.coalesce(n, F.lit("")) != "")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    guild = F.when(filled("c.guild.name").isNotNull(), F.concat_ws(" #", "c.guild.name", "c.id"))
    contact = F.coalesce(F.when(F.size(people) > 0, F.array_join(people, ", ")), filled("c.name"), guild, F.element_at(F.split("folder", "/"), -1))
    d = messages.join(channels, ["archive", "folder"], "left")
    return d.select(contact.alias("contact"), F.lit(self_name).alias("sender"), F.lit("sent").alias("direction"), decode.timestamp(F.col("m.Timestamp"), zone).alias("ts"), F.col("m.Contents").alias("text"), F.lit("discord").alias("source")).where("text <> '' and ts is not null")


def json_by_contact(spark: SparkSession, path: str, self_name: str) -> DataFrame:
    """{contact: [messages]}; a message that names its contact keeps it."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<map<string, string>>>")).alias("key", "list"))
    low = whole.select("key", F.explode("list").alias("m")).select("key", F.transform_keys("m", lambda k, _: F.lower(F.trim(k))).alias("m"))
    names = [n for group in decode.ALIASES.values() for n in group]
    value = lambda n: F.nullif(F.try_element_at("m", F.lit(n)), F.lit(""))
    return decode.generic(low.select(*[(F.coalesce(value(n), F.col("key")) if n == "contact" else value(n)).alias(n) for n in dict.fromkeys(names)]), self_name, "json")


def guess_format(name: Column, head: Column, inside: Column | None = None) -> Column:
    """From a file's name and the first 8 KB: database, archive (by the names inside), markup, known keys, then the name."""
    inside = F.lit("") if inside is None else F.lower(inside)
    holds = lambda *parts: [F.contains(inside, F.lit(x)) for x in parts]
    result, chats_, thread_, inbox, channel, folders = holds("result.json", "chats", "message_1.json", "/inbox/", "channel.json", "/messages/c")
    packed = F.when(result | (chats_ & F.contains(F.lower(name), F.lit("telegram"))), "telegram").when(thread_ | inbox, "meta").when(channel | folders, "discord")
    text, low = F.try_validate_utf8(head.cast("string")), F.lower(name)
    has = lambda *keys: [F.contains(head.cast("string"), F.lit(f'"{k}"')) for k in keys]
    start = F.ltrim(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""))
    entities, single, person, sender, thread, contents, stamp = has("text_entities", "from_id", "personal_information", "sender_name", "participants", "Contents", "Timestamp")
    return (
        F.when(F.left(head.cast("string"), F.lit(15)) == "SQLite format 3", "imessage").when(F.startswith(F.hex(head), F.lit("504B0304")), packed).when(start.startswith("<"), "sms")
        .when(start.rlike(r"^[\[{]"), F.when(entities | single | person, "telegram").when(sender | thread, "meta").when(contents & stamp, "discord").otherwise("json"))
        .when(low.endswith(".csv"), "csv").when(low.endswith(".txt") | start.rlike(r"(?m)^\[?\d{1,4}[./-]\d{1,2}[./-]\d{1,4},? \d{1,2}:\d{2}"), "whatsapp")
    )


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """path and format of each file; null where nothing fits."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    named = files.mapInPandas(_names_inside, "path string, head binary, inside string")
    return named.select("path", guess_format(F.regexp_extract("path", "[^/]*$", 0), F.col("head"), F.col("inside")).alias("format"))


def _names_inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first 8 KB of each file, and of archives the names of their members, as an archive's index stands at its end."""
    for frame in frames:
        inside = []
        for content in frame["content"]:
            names = ""
            if content[:4] == b"PK\x03\x04":
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = " ".join(i.filename for i in z.infolist()[:MOST_MEMBERS])
                except zipfile.BadZipFile:
                    pass
            inside.append(names)
        yield pd.DataFrame({"path": frame["path"], "head": [c[:8192] for c in frame["content"]], "inside": inside})
