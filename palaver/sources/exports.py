"""Readers of chat exports: each gives contact, sender, direction, ts, text, source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import archives, decode, phone

# Date and time patterns of text exports, day first or month first.
_DAY_FIRST, _MONTH_FIRST, _YEAR_FIRST = ["d/M/yyyy", "d/M/yy", "d.M.yyyy", "d.M.yy"], ["M/d/yyyy", "M/d/yy"], ["yyyy-M-d", "yyyy/M/d"]
_DATES = {True: [*_DAY_FIRST, *_MONTH_FIRST, *_YEAR_FIRST], False: [*_MONTH_FIRST, *_DAY_FIRST, *_YEAR_FIRST]}
_TIMES = ["H:mm", "H:mm:ss", "h:mm a", "h:mm:ss a"]
#: Header dates of a file that tell days from months, and lines with an unreadable time after which a file is given up.
TELLING_DATES, MOST_UNREAD = 500, 1000
LINE = r"^\[?(\d{1,4}[./-]\d{1,2}[./-]\d{1,4}),? (\d{1,2}:\d{2}(?::\d{2})?(?: ?[APap]\.?[Mm]\.?)?)\]?(?: -)? (.*)$"
_OUT = ["contact", "sender", "direction", "ts", "text", "source"]


def _way(sender, self_name: str):
    return F.when(F.lower(F.trim(sender)) == self_name.strip().lower(), "sent").otherwise("received")


def _text_messages(spark: SparkSession, path: str, self_name: str) -> DataFrame:
    """file, grp, sender, text, ts (null where no format reads it) and the file's unread of each message of a text export."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85  ]")).alias("no", "raw"))
    lines = lines.withColumn("line", decode.strip_bidi(F.translate("raw", " ", " "))).where("line <> ''")
    part = lambda i: F.regexp_extract("line", LINE, i)
    d = lines.select("file", "no", "line", part(1).alias("date"), part(2).alias("time"), part(3).alias("rest"))
    d = d.withColumn("stamped", F.col("date") != "").withColumn("sender", F.when(F.col("stamped"), F.regexp_extract("rest", r"^([^:]+): ?", 1)))
    d = d.withColumn("grp", F.sum(F.col("stamped").cast("int")).over(Window.partitionBy("file").orderBy("no")))
    number = lambda i: F.split("date", "[./-]")[i].cast("int")
    # a date that begins with a year tells nothing
    heads = d.where("sender <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("no"))).where(F.col("nth") <= TELLING_DATES)
    telling = heads.where(~F.col("date").rlike(r"^\d{4}"))
    order = telling.groupBy("file").agg(decode.day_first(number(0), number(1), F.col("no")).alias("day_first"))
    text = F.when(F.col("stamped"), F.regexp_replace("rest", r"^[^:]+: ?", "")).otherwise(F.col("line"))
    g = d.withColumn("t", text).groupBy("file", "grp").agg(F.min_by("date", "no").alias("date"), F.min_by("time", "no").alias("time"), F.min_by("sender", "no").alias("sender"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]), "\n").alias("text"))
    g = g.where("sender <> ''").join(order, "file", "left")  # a row per file
    # two-digit years from 69 on are of the last century
    date = F.when(F.col("date").rlike(r"[./-](69|[7-9]\d)$"), F.regexp_replace("date", r"(\d\d)$", "19$1")).otherwise(F.col("date"))
    stamp = F.concat_ws(" ", date, F.upper(F.regexp_replace(F.regexp_replace("time", r"\.", ""), r" ?([APap][Mm])$", " $1")))
    tried = lambda first: F.coalesce(*[F.try_to_timestamp(stamp, F.lit(f"{f} {t}")) for f in _DATES[first] for t in _TIMES])
    # where no date tells, month first is tried before day first
    g = g.withColumn("ts", F.when(F.col("day_first"), tried(True)).otherwise(tried(False)).cast("timestamp_ntz"))
    unread = g.groupBy("file").agg(F.count_if(F.col("ts").isNull()).alias("unread"))
    return g.join(unread, "file")


def unreadable_exports(spark: SparkSession, path: str, self_name: str) -> DataFrame:
    """file and unread of text exports that are given up: more than MOST_UNREAD of their lines have a time that no format reads."""
    return _text_messages(spark, path, self_name).where(F.col("unread") > MOST_UNREAD).select("file", "unread").distinct()


def text_export(spark: SparkSession, path: str, self_name: str, contact: str | None = None) -> DataFrame:
    """Lines 'date, time - sender: text' or '[date, time] sender: text'. Other lines continue a message; a stamped line without sender closes it.

    A file is one conversation, so its lines are ordered within the file. Dates
    are read day first or month first as the earliest telling date of the file says.
    A file that unreadable_exports() lists gives no messages; the others still do.
    """
    g = _text_messages(spark, path, self_name).where((F.col("unread") <= MOST_UNREAD) & F.col("ts").isNotNull())
    others = g.where(_way(F.col("sender"), self_name) == "received").groupBy("file").agg(F.collect_set("sender").alias("o"))
    g = g.join(others, "file", "left")
    other = F.lit(contact) if contact else F.when(F.size("o") == 1, F.get("o", F.lit(0))).when(F.size("o") > 1, "Group chat").otherwise(self_name)
    return g.select(other.alias("contact"), "sender", _way(F.col("sender"), self_name).alias("direction"), "ts", "text", F.lit("whatsapp").alias("source"))


def csv_export(spark: SparkSession, path: str, self_name: str) -> DataFrame:
    return decode.generic(spark.read.csv(path, header=True, multiLine=True, escape='"'), self_name, "csv")


def json_export(spark: SparkSession, path: str, self_name: str) -> DataFrame:
    """A list of objects, or {"messages": [...]} whatever else stands beside it."""
    raw = spark.read.json(path, multiLine=True)
    lists = dict(raw.dtypes).get("messages", "").startswith("array<struct")
    rows = raw.select(F.explode("messages").alias("m")).select("m.*") if lists else raw
    return decode.generic(rows, self_name, "json")


# A document type declaration of entities, which backups don't have.
_ENTITY = "<!ENTITY"


def refused_backups(spark: SparkSession, path: str) -> DataFrame:
    """file and reason of XML files that aren't parsed: they declare entities, or aren't UTF-8."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    wide = F.contains("value", F.lit("\0")) | F.startswith("value", F.lit("\ufffd\ufffd"))
    reason = F.when(wide, "the text is UTF-16 or UTF-32, not UTF-8").when(F.contains(F.upper("value"), F.lit(_ENTITY)), "it declares entities")
    return lines.select("file", reason.alias("reason")).where("reason is not null").groupBy("file").agg(F.min("reason").alias("reason"))


def sms_export(spark: SparkSession, path: str, self_name: str, zone: str = "UTC") -> DataFrame:
    """<sms> elements of a backup, and <mms> with the text/plain parts joined by lines.

    Files that refused_backups() lists are left out before anything is parsed; if none is left, that is an error.
    """
    bad = {r["file"]: r["reason"] for r in refused_backups(spark, path).collect()}
    paths = path
    if bad:
        # names of files, which the driver lists anyway
        every = [r["file"] for r in spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).collect()]
        plain = lambda x: x.replace("file:///", "/").replace("file:/", "/")
        paths = [x for x in every if plain(x) not in {plain(b) for b in bad}]
        if not paths:
            raise ValueError(f"no file of {path} can be read: {sorted(set(bad.values()))}")
    own = "_address string, _date string, _contact_name string"
    sms = spark.read.schema(f"{own}, _type int, _body string").xml(paths, rowTag="sms")
    sms = sms.select("_address", "_date", "_contact_name", F.col("_type").alias("box"), F.col("_body").alias("text"), F.lit("sms").alias("source"))
    mms = spark.read.schema(f"{own}, _msg_box int, parts struct<part: array<struct<_ct: string, _text: string>>>").xml(paths, rowTag="mms")
    said = F.filter("parts.part", lambda x: x["_ct"].startswith("text/plain") & (F.coalesce(x["_text"], F.lit("")) != ""))
    mms = mms.select("_address", "_date", "_contact_name", F.col("_msg_box").alias("box"), F.trim(F.array_join(F.transform(said, lambda x: x["_text"]), "\n")).alias("text"), F.lit("mms").alias("source"))
    d = sms.unionByName(mms).where("text is not null and text <> ''")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    contact = F.coalesce(F.nullif(filled("_contact_name"), F.lit("(Unknown)")), filled("_address"), F.lit("Unknown"))
    way = F.when(F.col("box") == 2, "sent").otherwise("received")
    return d.select(contact.alias("contact"), F.when(way == "sent", F.lit(self_name)).otherwise(contact).alias("sender"), way.alias("direction"), decode.timestamp(F.col("_date"), zone).alias("ts"), "text", "source").where("ts is not null")


def _documents(spark: SparkSession, path: str, contains: str) -> DataFrame:
    """The text of each JSON document: members of archives with `contains` in their name, or plain files."""
    if path.endswith(".zip"):
        found = archives.json_members(spark, path, contains).select("archive", "member", "text")
    else:
        found = spark.read.text(path, wholetext=True).select(F.lit("").alias("archive"), F.col("_metadata.file_path").alias("member"), F.col("value").alias("text"))
    return found.withColumn("text", F.regexp_replace("text", "^\ufeff", ""))


def meta_export(spark: SparkSession, path: str, self_name: str, zone: str = "UTC") -> DataFrame:
    """A thread per document (of a zip, those named message_): participants, title, thread_path, messages. A broken one gives no rows."""
    schema = "participants array<struct<name string>>, title string, thread_path string, messages array<struct<sender_name string, timestamp_ms long, content string>>"
    d = _documents(spark, path, "message_").dropDuplicates(["archive", "member"]).select(F.from_json("text", schema).alias("t")).select("t.*").select("*", F.explode("messages").alias("m"))
    mine = lambda n: F.lower(F.trim(n)) == self_name.strip().lower()
    others = F.filter(F.transform("participants", lambda p: decode.repair(p["name"])), lambda n: ~mine(n))
    contact = F.coalesce(decode.repair(F.nullif(F.col("title"), F.lit(""))), F.when(F.size(others) == 1, F.get(others, F.lit(0))), F.lit("Group chat"))
    sender = decode.repair(F.coalesce("m.sender_name", F.lit("Unknown")))
    source = F.when(F.contains(F.lower(F.coalesce("thread_path", F.lit(""))), F.lit("instagram")), "instagram").otherwise("messenger")
    rows = d.select(contact.alias("contact"), F.when(mine(sender), self_name).otherwise(sender).alias("sender"), F.when(mine(sender), "sent").otherwise("received").alias("direction"), decode.timestamp(F.col("m.timestamp_ms").cast("string"), zone).alias("ts"), decode.repair(F.col("m.content")).alias("text"), source.alias("source"))
    return rows.where("text is not null and text <> '' and ts is not null")


# Kinds of chats that are broadcasts.
_BROADCASTS = ("public_channel", "private_channel", "public_supergroup")


def telegram_export(spark: SparkSession, path: str, self_name: str, zone: str = "UTC") -> DataFrame:
    """chats.list of an export, or a document that is one chat; of a zip the members named result.json, or all if there is none.

    Broadcasts are skipped and formatted text is flattened. The exporter's local date is kept; without it, date_unixtime counts.
    """
    message = "struct<type: string, date: string, date_unixtime: string, `from`: string, from_id: string, text: string>"
    chat = f"name string, title string, type string, messages array<{message}>"
    me = "personal_information struct<user_id: string, first_name: string, last_name: string>"
    found = _documents(spark, path, "")
    results = found.where(F.contains("member", F.lit("result.json"))).select("archive").distinct()
    if path.endswith(".zip"):
        found = found.join(results.withColumn("has", F.lit(True)), "archive", "left").where(F.col("has").isNull() | F.contains("member", F.lit("result.json")))
    nested = "struct<" + chat.replace("name string", "name: string").replace("title string", "title: string").replace("type string,", "type: string,").replace("messages array", "messages: array") + ">"
    d = found.select(F.from_json("text", f"{me}, chats struct<list: array<{nested}>>, {chat}").alias("t")).select("t.*")
    alone = F.when(F.col("messages").isNotNull(), F.array(F.struct("name", "title", "type", "messages")))
    d = d.select("personal_information", F.explode(F.coalesce("chats.list", alone)).alias("c")).where(~F.coalesce("c.type", F.lit("")).isin(*_BROADCASTS))
    own, p = F.lower(F.lit(self_name.strip())), "personal_information"
    names = F.array(own, F.lower(F.trim(F.concat_ws(" ", f"{p}.first_name", f"{p}.last_name"))), F.lower(F.trim(F.coalesce(f"{p}.first_name", F.lit("")))))
    d = d.select(F.concat(F.lit("user"), F.col(f"{p}.user_id")).alias("me"), F.filter(names, lambda x: x != "").alias("names"), F.coalesce(F.nullif("c.name", F.lit("")), F.nullif("c.title", F.lit("")), F.lit("Saved messages")).alias("contact"), F.explode("c.messages").alias("m")).where("m.type = 'message'")
    parts = F.from_json("m.text", "array<string>")
    flat = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)), "")
    text = F.when(F.col("m.text").startswith("[") & parts.isNotNull(), flat).otherwise(F.col("m.text"))
    sender = F.coalesce("m.from", F.lit("Unknown"))
    way = F.when((F.col("m.from_id") == F.col("me")) | F.array_contains("names", F.lower(F.trim(sender))), "sent").otherwise("received")
    ts = F.coalesce(F.col("m.date").try_cast("timestamp_ntz"), decode.timestamp(F.col("m.date_unixtime"), zone))
    return d.select("contact", F.when(way == "sent", self_name).otherwise(sender).alias("sender"), way.alias("direction"), ts.alias("ts"), text.alias("text"), F.lit("telegram").alias("source")).where("text <> '' and ts is not null")


def chat_tables(message: DataFrame, handle: DataFrame, link: DataFrame, chat: DataFrame, zone: str = "UTC", self_name: str = "me") -> DataFrame:
    """Messages from a phone's chat tables that were exported one by one (rowid, handle_id, date, is_from_me, text, maybe attributedBody), the first chat of each."""
    first = link.groupBy("message_id").agg(F.min("chat_id").alias("chat_id"))
    j = message.join(handle.select(F.col("rowid").alias("handle_id"), F.col("id").alias("handle")), "handle_id", "left").join(first, message["rowid"] == first["message_id"], "left")
    j = j.join(chat.select(F.col("rowid").alias("chat_id"), "display_name", "chat_identifier"), "chat_id", "left")
    body = F.col("attributedBody") if "attributedBody" in message.columns else F.lit(None).cast("binary")
    return phone.messages_of(j.withColumn("body", body), self_name, zone)


READERS = {"whatsapp": text_export, "csv": csv_export, "json": json_export, "sms": sms_export, "meta": meta_export, "telegram": telegram_export, "discord": archives.discord_export, "imessage": phone.chat_database, "json_by_contact": archives.json_by_contact}


def read_messages(spark: SparkSession, path: str, fmt: str, self_name: str) -> DataFrame:
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(READERS)}")
    return READERS[fmt](spark, path, self_name).select(*_OUT)
