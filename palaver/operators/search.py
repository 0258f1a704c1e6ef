"""Drill-down search, ingest and the one-row summaries."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_media, ratio, whole_word, words_of
from . import conversations as C
from . import lexical, volume


def search(m: DataFrame, q: str = "", word: str = "", contact: str = "", sender: str = "", direction: str = "", hour: int | None = None, weekday: int | None = None, month: str = "", day: str = "", limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Messages that meet all given conditions, latest first (ties: smaller msg_id). Months and days become ranges of ts, which Parquet can skip by."""
    keep = []
    for name, value in (("contact", contact), ("sender", sender), ("direction", direction)):
        if value:
            keep.append(F.col(name) == value)
    if month:
        y, k = map(int, month.split("-"))
        keep += [F.col("ts") >= F.lit(datetime(y, k, 1)).cast("timestamp_ntz"), F.col("ts") < F.lit(datetime(y + k // 12, k % 12 + 1, 1)).cast("timestamp_ntz")]
    if day:
        first = datetime.combine(date.fromisoformat(day), datetime.min.time())
        keep += [F.col("ts") >= F.lit(first).cast("timestamp_ntz"), F.col("ts") < F.lit(first + timedelta(days=1)).cast("timestamp_ntz")]
    if hour is not None:
        keep.append(F.hour("ts") == hour)
    if weekday is not None:
        keep.append(F.weekday("ts") == weekday)
    if q:
        keep.append(F.contains(F.lower("text"), F.lit(q.lower())))
    if word:
        keep.append(whole_word(F.col("text"), word))
    out = m
    for k in keep:
        out = out.where(k)
    return out.orderBy(F.desc("ts"), "msg_id").offset(offset).limit(limit) if limit else out


IDENTITY = ["contact", "direction", "ts", "text", "who"]


def _identified(m: DataFrame) -> DataFrame:
    return m.withColumn("who", F.when(F.col("direction") == "received", F.col("sender")).otherwise(F.lit("")))


def identity_dedupe(m: DataFrame) -> DataFrame:
    """The first row (smallest msg_id) of each identity; a grouped minimum, so copies combine before the shuffle."""
    rest = F.struct(*[c for c in dict.fromkeys(["msg_id", *m.columns]) if c not in ("contact", "direction", "ts", "text")])
    return _identified(m).groupBy(*IDENTITY).agg(F.min(rest).alias("r")).select("contact", "direction", "ts", "text", "r.*").select(*dict.fromkeys(m.columns))


def new_messages(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """What an import adds: the batch without its own copies and without what is there."""
    return _identified(identity_dedupe(batch)).join(_identified(existing).select(*IDENTITY), IDENTITY, "left_anti").select(*batch.columns)


def append(existing_path: str, batch: DataFrame) -> int:
    """Appends new messages to a Parquet table and says how many."""
    spark = batch.sparkSession
    new = new_messages(spark.read.parquet(existing_path), batch).persist()
    n = new.count()
    new.write.mode("append").parquet(existing_path)
    new.unpersist()
    return n


def append_or_create(path: str, batch: DataFrame) -> int:
    """As append; the first batch makes the table."""
    spark = batch.sparkSession
    try:
        spark.read.parquet(path)
    except AnalysisException:
        batch.limit(0).write.mode("ignore").parquet(path)
    return append(path, batch)


def clear(path: str, spark: SparkSession) -> None:
    """Leaves the table without rows."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def import_report(parsed: DataFrame, added: DataFrame, fmt: str) -> DataFrame:
    a = parsed.agg(F.count("*").alias("parsed"), F.count_distinct("contact").alias("contacts"), F.count_if(F.col("direction") == "sent").alias("s"))
    note = F.when((F.col("parsed") > 0) & (F.col("s") == F.col("parsed")), "all messages are sent").when((F.col("parsed") > 0) & (F.col("s") == 0), "all messages are received").otherwise("")
    return a.crossJoin(added.agg(F.count("*").alias("added"))).select(F.lit(fmt).alias("format"), "parsed", "added", "contacts", note.alias("note"))


def distinct_contacts(m: DataFrame) -> DataFrame:
    return m.select("contact").distinct()


def of_contact(view, m: DataFrame, contact: str) -> DataFrame:
    """A view of one contact's messages; of an unknown contact it has no rows, not even those that a dense view fills in."""
    own = m.where(F.col("contact") == contact) if contact else m
    return view(own).join(F.broadcast(own.select(F.lit(True).alias("_known")).limit(1)), F.lit(True), "left_semi")


def status(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("messages"), F.count_distinct("contact").alias("contacts"))


def wrapped(m: DataFrame, year: int) -> DataFrame:
    """One flat row about a year; the year is a range of ts. A year without messages is empty and all else null.

    Totals come from one aggregate; hours, weekdays and days from counts by day and
    hour, which Spark shuffles once for all of them.
    """
    own = m.where((F.col("ts") >= F.lit(datetime(year, 1, 1)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(datetime(year + 1, 1, 1)).cast("timestamp_ntz")))
    written = F.sum(F.when(volume.sent() & ~is_media(F.col("text")), F.size(words_of(F.col("text")))))
    span = F.datediff(F.max("ts"), F.min("ts")).cast("long") + 1
    o = own.agg(F.count("*").alias("total"), F.count_if(volume.sent()).alias("sent"), F.count_if(volume.received()).alias("received"), F.count_distinct("contact").alias("people"), F.coalesce(span, F.lit(0)).alias("days"), F.count_if(F.hour("ts") < 5).alias("night_messages"), F.coalesce(written, F.lit(0)).cast("long").alias("words_written"))
    o = o.select("total", "sent", "received", ratio("sent", "total", 3).alias("sent_share"), ratio("total", "days", 2).alias("per_day"), "people", "words_written", "night_messages", ratio("night_messages", "total", 3).alias("night_share"))
    top = own.groupBy("contact").agg(F.count("*").alias("total"), F.count_if(volume.sent()).alias("sent"), F.min("ts").alias("first")).orderBy(F.desc("total"), "first", "contact").limit(2)
    top = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("k"), "first", "contact", "total", "sent"))).alias("p"))
    nth = lambda i, c: F.get("p", F.lit(i))[c]
    people = top.select(nth(0, "contact").alias("top_contact"), nth(0, "total").alias("top_total"), nth(0, "sent").alias("top_sent"), nth(1, "contact").alias("runner_up"), nth(1, "total").alias("runner_up_total"))
    cells = own.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    most = lambda part, name: cells.groupBy(part.cast("long").alias("p")).agg(F.sum("n").alias("n")).agg(F.min_by("p", F.struct(-F.col("n"), "p")).alias(name))
    by_day = cells.groupBy("day").agg(F.sum("n").alias("n"))
    busiest = by_day.agg(F.max(F.struct("n", (-F.unix_date("day")).alias("d"))).alias("b")).select(F.date_from_unix_date((-F.col("b.d")).cast("int")).alias("busiest_day"), F.col("b.n").alias("busiest_count"))
    adj = C.adjacency(own)
    summary = C.conversation_summary(C.conversation_health(adj)).select("conversations", ratio("you_opened", "conversations", 3).alias("you_opened_share"))
    one = lambda df, **names: df.agg(*[F.first(c).alias(n) for c, n in names.items()])
    # your own emoji come first; without any, everybody's count
    emoji = lexical.emoji_top(own, None).orderBy(F.desc("sent"), F.when(F.col("sent") == 0, -F.col("count")), "emoji").limit(1)
    bad = lexical.misspellings_totals(own).select(F.col("rate").alias("typo_rate"))
    typo = lexical.misspelled(own).groupBy("lw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lw").limit(1)
    parts = [people, most(F.col("hour"), "peak_hour"), most(F.weekday("day"), "peak_weekday"), busiest, C.reply_latency(adj).select("you_micros", "them_micros"), summary, one(volume.streak_of(by_day.select("day")), days="streak_days", start="streak_start", end="streak_end")]
    parts += [one(lexical.word_frequency(own, "sent", 1), word="top_word", count="top_word_count"), one(emoji, emoji="top_emoji"), one(typo, lw="top_typo"), bad, lexical.tone(own).select("net")]
    out = o
    for p in parts:
        out = out.crossJoin(F.broadcast(p))  # each is one row
    empty = F.col("total") == 0
    return out.select(F.lit(year).cast("long").alias("year"), empty.alias("empty"), *(F.when(~empty, F.col(c)).alias(c) for c in out.columns))


def dashboard_overview(m: DataFrame) -> DataFrame:
    top = volume.contact_frequency(m, 1).select("contact", F.col("total").alias("top_total"))
    return volume.overview(m).select("total", "contacts", "days").crossJoin(top.withColumnRenamed("contact", "top_contact")).crossJoin(volume.peaks(m)).crossJoin(C.conversation_summary(C.conversation_health(C.adjacency(m))).select("conversations", "double_texts", "ghosted_by"))


def longest_writers(m: DataFrame, limit: int = 12) -> DataFrame:
    return volume.contact_frequency(m).select("contact", "avg_words_received").orderBy(F.desc("avg_words_received"), "contact").limit(limit)


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("r") <= k).drop("r")
