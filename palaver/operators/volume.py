"""Who wrote how much, and when: totals, contacts, members, hours, weekdays, months, days, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_media, ratio, words_of


def sent():
    return F.col("direction") == "sent"


def received():
    return F.col("direction") == "received"


def _span():
    return F.datediff(F.max("ts"), F.min("ts")).cast("long") + 1


def overview(m: DataFrame) -> DataFrame:
    """One row: totals and the calendar span; an empty table gives zeros and nulls."""
    g = m.agg(F.count("*").alias("total"), F.count_if(sent()).alias("sent"), F.count_if(received()).alias("received"), F.count_distinct("contact").alias("contacts"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.coalesce(_span(), F.lit(0).cast("long")).alias("days"))
    return g.withColumn("per_day", ratio("total", "days", 2))


def contact_frequency(m: DataFrame, limit: int | None = None) -> DataFrame:
    """Per contact, most messages first (ties: seen first, then by name); averages leave media out."""
    n = F.when(~is_media(F.col("text")), F.size(words_of(F.col("text"))))
    by = m.withColumn("n", n).groupBy("contact").agg(
        F.count("*").alias("total"), F.count_if(sent()).alias("sent"), F.count_if(received()).alias("received"), F.sum(F.when(sent(), F.col("n"))).alias("ws"), F.count(F.when(sent(), F.col("n"))).alias("ns"), F.sum(F.when(received(), F.col("n"))).alias("wr"), F.count(F.when(received(), F.col("n"))).alias("nr"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), _span().alias("active_days"), F.count_distinct(F.when(received(), F.col("sender"))).alias("members"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = by.select("contact", "total", "sent", "received", ratio("sent", "total", 3).alias("sent_share"), ratio(zero("ws"), zero("ns"), 1).alias("avg_words_sent"), ratio(zero("wr"), zero("nr"), 1).alias("avg_words_received"), "first", "last", "active_days", ratio("total", "active_days", 2).alias("per_day"), (F.col("members") > 1).alias("is_group"))
    return out.orderBy(F.desc("total"), "first", "contact").limit(limit) if limit else out


def contact_members(m: DataFrame) -> DataFrame:
    return m.where(received()).groupBy("contact", "sender").agg(F.count("*").alias("n"))


def by_part(m: DataFrame, part, size: int, name: str) -> DataFrame:
    """Dense rows 0..size-1 with counts by direction."""
    counts = m.groupBy(part.cast("long").alias(name)).agg(F.count_if(sent()).alias("sent"), F.count_if(received()).alias("received"))
    return m.sparkSession.range(size).withColumnRenamed("id", name).join(counts, name, "left").na.fill(0)


def by_hour(m: DataFrame) -> DataFrame:
    return by_part(m, F.hour("ts"), 24, "hour")


def by_weekday(m: DataFrame) -> DataFrame:
    """0 is Monday."""
    return by_part(m, F.weekday("ts"), 7, "weekday")


def heatmap(m: DataFrame) -> DataFrame:
    cells = by_part(m, F.weekday("ts") * 24 + F.hour("ts"), 168, "cell")
    return cells.select(F.expr("cell div 24").alias("weekday"), (F.col("cell") % 24).alias("hour"), (F.col("sent") + F.col("received")).alias("n"))


def by_month(m: DataFrame) -> DataFrame:
    return m.groupBy(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(F.count_if(sent()).alias("sent"), F.count_if(received()).alias("received"))


def busiest_day(m: DataFrame) -> DataFrame:
    return m.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)


def peaks(m: DataFrame) -> DataFrame:
    """The hour and weekday with most messages; ties go to the lower."""
    best = lambda part, name: m.groupBy(part.cast("long").alias("p")).count().agg(F.min_by("p", F.struct(-F.col("count"), "p")).alias(name))
    return best(F.hour("ts"), "peak_hour").crossJoin(best(F.weekday("ts"), "peak_weekday"))


def contact_peaks(m: DataFrame, limit: int | None = 20) -> DataFrame:
    hour = m.groupBy("contact", F.hour("ts").cast("long").alias("p")).agg(F.count("*").alias("n"))
    day = m.groupBy("contact", F.weekday("ts").cast("long").alias("p")).agg(F.count("*").alias("n"))
    best = lambda d, name: d.groupBy("contact").agg(F.min_by("p", F.struct(-F.col("n"), "p")).alias(name), F.sum("n").alias("total"))
    out = best(hour, "peak_hour").join(best(day, "peak_weekday").drop("total"), "contact").select("contact", "total", "peak_hour", "peak_weekday")
    return out.orderBy(F.desc("total"), "contact").limit(limit) if limit else out


def hour_profile(m: DataFrame) -> DataFrame:
    """Per contact a dense list of 24 counts, written with commas."""
    at = F.map_from_entries(F.collect_list(F.struct("h", "n")))
    per = m.groupBy("contact", F.hour("ts").alias("h")).agg(F.count("*").alias("n")).groupBy("contact").agg(at.alias("at"))
    return per.select("contact", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("at", h), F.lit(0)).cast("string")), ",").alias("profile"))


def longest_streak(m: DataFrame) -> DataFrame:
    """The longest run of consecutive days, the earliest of equal ones. Days are few, so one window over them is."""
    return streak_of(m.select(F.to_date("ts").alias("day")).distinct())


def streak_of(days: DataFrame) -> DataFrame:
    """As longest_streak, of distinct days."""
    island = days.withColumn("i", F.date_sub("day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day"))))
    return island.groupBy("i").agg(F.count("*").alias("days"), F.min("day").alias("start"), F.max("day").alias("end")).orderBy(F.desc("days"), "start").limit(1).select("days", "start", "end")


def years(m: DataFrame) -> DataFrame:
    return m.select(F.year("ts").cast("long").alias("year")).distinct()


def night_share(m: DataFrame) -> DataFrame:
    return m.agg(F.count_if(F.hour("ts") < 5).alias("night_messages"), F.count("*").alias("total")).select("night_messages", ratio("night_messages", "total", 3).alias("night_share"))


def group_members(m: DataFrame, contact: str) -> DataFrame:
    """Per sender of one contact; the peak hour's ties go to the hour seen first."""
    own = m.where(F.col("contact") == contact).withColumn("n", F.when(~is_media(F.col("text")), F.size(words_of(F.col("text")))))
    hours = own.groupBy("sender", F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("k"), F.min(F.struct("ts", "msg_id")).alias("seen"))
    peak = hours.groupBy("sender").agg(F.min_by("h", F.struct(-F.col("k"), "seen")).alias("peak_hour"), F.sum("k").alias("count"))
    facts = own.groupBy("sender").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("w"), F.count("n").alias("k"), F.min("ts").alias("first"), F.max("ts").alias("last"), (F.min_by("direction", F.struct("ts", "msg_id")) == "sent").alias("is_you"))
    total = own.agg(F.count("*").alias("all"))
    return peak.join(facts, "sender").crossJoin(total).select("sender", "count", ratio("count", "all", 3).alias("share"), ratio("w", "k", 1).alias("avg_words"), "peak_hour", "first", "last", "is_you")
