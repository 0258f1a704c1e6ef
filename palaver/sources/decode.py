"""Decoding of export fields: aliases, directions, times, date order, repaired text. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header names that exports use for each field.
ALIASES = {
    "contact": ["contact", "chat", "conversation", "thread", "name", "chat_name"], "sender": ["sender", "author", "from"], "direction": ["direction", "type", "msg_box", "is_from_me", "isfromme", "outgoing", "sent"],
    "timestamp": ["timestamp", "date", "time", "datetime", "ts", "date_sent", "created_at"], "text": ["text", "body", "message", "content", "msg"],
}
SENT_WORDS, RECEIVED_WORDS = ("sent", "outgoing", "out", "me", "true", "yes", "1"), ("received", "incoming", "in", "them", "false", "no", "0")
# Formats that are tried after ISO, in this order; those with dots and seconds are further ones.
FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy h:mm a", "M/d/yy H:mm", "d/M/yyyy H:mm", "yyyy-M-d H:mm", "yyyy-M-d H:mm:ss", "MMM d, yyyy h:mm a", "MMMM d, yyyy 'at' h:mm a", "d/M/yyyy H:mm:ss", "M/d/yyyy H:mm:ss", "yyyy/M/d H:mm:ss"]
BIDI = "[‎‏‪-‮⁦-⁩؜]"


def pick(columns: list[str], names: list[str]) -> tuple[Column, Column]:
    """The first alias with a value, and its name; headers match without case and spaces."""
    have = {c.strip().lower(): c for c in columns}
    cols = [(n, F.col(f"`{have[n]}`").cast("string")) for n in names if n in have]
    if not cols:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    value = F.coalesce(*[F.nullif(c, F.lit("")) for _, c in cols])
    name = F.coalesce(*[F.when(c.isNotNull() & (c != ""), F.lit(n)) for n, c in cols])
    return value, name


def direction(value: Column, alias: Column, sender: Column, self_name: str) -> Column:
    """Mailbox columns say 1 received, 2 sent; words otherwise; else who sent it; else received."""
    v = F.lower(F.trim(value))
    box = alias.isin("type", "msg_box")
    return (
        F.when(box & (v == "1"), "received").when(box & (v == "2"), "sent").when(v.isin(*SENT_WORDS), "sent").when(v.isin(*RECEIVED_WORDS), "received")
        .when(F.lower(F.trim(sender)) == self_name.strip().lower(), "sent").otherwise("received")
    )


def timestamp(value: Column, zone: str = "UTC") -> Column:
    """Epoch seconds or milliseconds (over 1e11), ISO, then further formats; instants become wall clock of `zone`, which stays naive."""
    # two-digit years from 69 on are of the last century
    v = F.regexp_replace(F.trim(value), r"^(\d{1,2}/\d{1,2}/)(69|[7-9]\d) ", "${1}19$2 ")
    n = v.try_cast("double")
    instant = F.when(n > 1e11, F.timestamp_millis(n.cast("long"))).when(n.isNotNull(), F.timestamp_seconds(n))
    offset = v.rlike(r"[Tt ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    iso = F.when(offset, F.from_utc_timestamp(v.try_cast("timestamp"), zone).cast("timestamp_ntz")).otherwise(v.try_cast("timestamp_ntz"))
    return F.coalesce(F.from_utc_timestamp(instant, zone).cast("timestamp_ntz"), iso, *[F.try_to_timestamp(v, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


def strip_bidi(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BIDI, ""))


def repair(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; any other text stays."""
    bytes_ = F.encode(F.when(text.rlike(r"^[\x00-\xFF]*$"), text), "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(bytes_.cast("string")), text)


def day_first(first: Column, second: Column, order: Column) -> Column:
    """An aggregate: the earliest date whose numbers tell days from months decides; null if none does."""
    says = F.when(first > 12, True).when(second > 12, False)
    return F.min_by(says, F.when(says.isNotNull(), order))


def generic(df: DataFrame, self_name: str, source: str, zone: str = "UTC") -> DataFrame:
    """Messages from a table with any of the known headers; rows without text or time are left out."""
    got = {k: pick(df.columns, names) for k, names in ALIASES.items()}
    sender = got["sender"][0]
    d = df.select(*[got[k][0].alias(k) for k in ALIASES], direction(got["direction"][0], got["direction"][1], sender, self_name).alias("way"))
    contact = F.coalesce("contact", F.when(F.col("way") == "received", F.col("sender")), F.lit("Unknown"))
    author = F.coalesce("sender", F.when(F.col("way") == "sent", F.lit(self_name)).otherwise(contact))
    out = d.select(contact.alias("contact"), author.alias("sender"), F.col("way").alias("direction"), timestamp(F.col("timestamp"), zone).alias("ts"), "text", F.lit(source).alias("source"))
    return out.where("text is not null and trim(text) <> '' and ts is not null")


def demo_alias(m: DataFrame) -> DataFrame:
    d = m.select("msg_id", F.when(F.col("msg_id") % 3 == 0, F.col("text")).alias("Body "), F.col("contact").alias("MESSAGE"))
    value, alias = pick(d.columns, ["body", "message"])
    return d.select("msg_id", value.alias("value"), alias.alias("alias"))


def demo_direction(m: DataFrame) -> DataFrame:
    value = F.when(F.col("msg_id") % 4 == 0, "2").when(F.col("msg_id") % 4 == 1, "1")
    return m.select("msg_id", direction(value, F.lit("type"), F.col("sender"), "Me").alias("direction"))


def demo_timestamp(m: DataFrame) -> DataFrame:
    s = F.date_trunc("second", F.col("ts").cast("timestamp"))
    seconds = F.unix_seconds(s)
    raw = F.when(F.col("msg_id") % 3 == 0, seconds.cast("string")).when(F.col("msg_id") % 3 == 1, (seconds * 1000).cast("string")).otherwise(F.date_format(s, "dd/MM/yyyy HH:mm:ss"))
    return m.select("msg_id", timestamp(raw).alias("ts"))


def demo_date_order(m: DataFrame) -> DataFrame:
    return m.groupBy("contact").agg(day_first(F.dayofmonth("ts"), F.month("ts"), F.struct("ts", "msg_id")).alias("day_first"))
