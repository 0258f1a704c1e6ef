"""Conversations split on silence, runs, reply times.

Everything here rests on which message came before. A window over a whole contact
would put a busy contact in one task; windows here run within a contact's day,
and the step from day to day is made on one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio


def _day():
    return Window.partitionBy("contact", "day").orderBy("ts", "msg_id")


def _days():
    return Window.partitionBy("contact").orderBy("day")


def _to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def seconds(late: str, early: str):
    return F.unix_micros(F.col(late).cast("timestamp")) - F.unix_micros(F.col(early).cast("timestamp"))


def adjacency(m: DataFrame, gap_hours: int = 6) -> DataFrame:
    """Adds prev_ts, prev_dir, gap (microseconds), conv_no and run_no, counted from 1 within a contact.

    A conversation ends where the gap is longer than gap_hours; an equal gap doesn't end it.
    """
    d = m.withColumn("day", F.to_date("ts"))
    before = d.withColumn("p", F.lag(F.struct("ts", "direction")).over(_day()))
    last = d.groupBy("contact", "day").agg(F.max(F.struct("ts", "msg_id", "direction")).alias("l"))
    last = last.select("contact", "day", F.lag("l").over(_days()).alias("l"))
    a = before.join(last, ["contact", "day"]).withColumn("prev_ts", F.coalesce("p.ts", "l.ts")).withColumn("prev_dir", F.coalesce("p.direction", "l.direction")).drop("p", "l")
    a = a.withColumn("gap", seconds("ts", "prev_ts"))
    new = F.col("gap").isNull() | (F.col("gap") > gap_hours * 3_600_000_000)
    a = a.withColumn("new_conv", new.cast("long")).withColumn("new_run", (new | (F.col("direction") != F.col("prev_dir"))).cast("long"))
    offs = a.groupBy("contact", "day").agg(F.sum("new_conv").alias("c"), F.sum("new_run").alias("r"))
    offs = offs.select("contact", "day", (F.sum("c").over(_to_here(_days())) - F.col("c")).alias("c0"), (F.sum("r").over(_to_here(_days())) - F.col("r")).alias("r0"))
    running = lambda c: F.sum(c).over(_to_here(_day()))
    return a.join(offs, ["contact", "day"]).withColumn("conv_no", F.col("c0") + running("new_conv")).withColumn("run_no", F.col("r0") + running("new_run")).drop("c0", "r0", "day")


def split_conversations(adj: DataFrame) -> DataFrame:
    at = F.struct("ts", "msg_id")
    return adj.groupBy("contact", "conv_no").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("direction", at).alias("opened"), F.max_by("direction", at).alias("closed"))


def runs(adj: DataFrame) -> DataFrame:
    return adj.groupBy("contact", "conv_no", "run_no").agg(F.first("direction").alias("direction"), F.count("*").alias("n"))


def _reply_gaps(max_gap_hours: int):
    """The time until a change of direction, by who answers."""
    reply = (F.col("direction") != F.col("prev_dir")) & (F.col("gap") <= max_gap_hours * 3_600_000_000)
    return [F.when(reply & (F.col("direction") == way), F.col("gap")) for way in ("sent", "received")]


def _replies(adj: DataFrame, max_gap_hours: int):
    you, them = _reply_gaps(max_gap_hours)
    return [F.median(you).alias("you_micros"), F.median(them).alias("them_micros"), F.count(you).alias("you_n"), F.count(them).alias("them_n")]


def reply_latency(adj: DataFrame, max_gap_hours: int = 12) -> DataFrame:
    """Median time until a change of direction, for you and for them; gaps of exactly max_gap_hours count."""
    return adj.agg(*_replies(adj, max_gap_hours))


def reply_latency_by_contact(adj: DataFrame, max_gap_hours: int = 12) -> DataFrame:
    return adj.groupBy("contact").agg(*_replies(adj, max_gap_hours))


def conversation_health(adj: DataFrame, max_gap_hours: int = 12) -> DataFrame:
    """Per contact: who opens and closes, double texts (runs of two and more), silence, reply times.

    Everything is summed up by run, then by contact. A reply is the first message of
    a run; what stands before a new conversation closed the last one.
    """
    you, them = _reply_gaps(max_gap_hours)
    new = F.col("new_conv") == 1
    by_run = adj.groupBy("contact", "run_no").agg(
        F.count("*").alias("n"), F.first("direction").alias("direction"), F.max("new_conv").alias("new_conv"), F.max(F.when(new, F.col("prev_dir"))).alias("closed"),
        F.max("gap").alias("gap"), F.max(you).alias("you"), F.max(them).alias("them"), F.max(F.struct("ts", "msg_id", "direction")).alias("last"),
    )
    mine = F.col("direction") == "sent"
    out = by_run.groupBy("contact").agg(
        F.sum("new_conv").alias("conversations"), F.sum("n").alias("messages"), F.count_if(new & mine).alias("you_opened"), (F.count_if(F.col("closed") == "sent") + (F.max("last")["direction"] == "sent").cast("long")).alias("you_closed"),
        F.count_if(mine & (F.col("n") >= 2)).alias("your_double_texts"), F.count_if(~mine & (F.col("n") >= 2)).alias("their_double_texts"), F.coalesce(F.max("gap"), F.lit(0)).alias("silence_micros"),
        F.median("you").alias("you_micros"), F.median("them").alias("them_micros"), F.count("you").alias("you_n"), F.count("them").alias("them_n"),
    )
    return out.select(
        "contact", "conversations", "you_opened", ratio("you_opened", "conversations", 3).alias("you_opened_share"), "you_closed", ratio("you_closed", "conversations", 3).alias("you_closed_share"), "your_double_texts", "their_double_texts",
        ratio("messages", "conversations", 1).alias("avg_length"), ratio("silence_micros", F.lit(86_400_000_000), 1).alias("longest_silence_days"), "you_micros", "them_micros", "you_n", "them_n",
    )


# Hours of silence that a view offers.
GAPS = (1, 3, 6, 12, 24)


def snap_gap(hours: float) -> int:
    """The offered gap that is nearest, the smaller of two."""
    return min(GAPS, key=lambda g: (abs(g - hours), g))


def clamp_rows(limit: int, most: int = 200) -> int:
    """A view's limit: 1 to 200 rows, to 500 in a search, to 5 parallels a claim."""
    return max(1, min(most, limit))


def conversation_view(m: DataFrame, gap_hours: float = 6, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Contacts with most conversations, and the summary, which counts them all whatever the limit."""
    health = conversation_health(adjacency(m, snap_gap(gap_hours)))
    return health.orderBy(F.desc("conversations"), "contact").limit(clamp_rows(limit)), conversation_summary(health)


def conversation_summary(health: DataFrame, least: int = 5) -> DataFrame:
    """One row; reply times are medians of the contacts' medians, ghosted_by the contact you close most with, of those with enough conversations."""
    enough = F.col("conversations") >= least
    rank = F.when(enough, F.struct(F.col("you_closed_share"), F.col("conversations"), F.col("contact")))
    return health.agg(
        F.sum("conversations").alias("conversations"), F.sum("you_opened").alias("you_opened"), F.sum("your_double_texts").alias("double_texts"), F.median("you_micros").alias("you_micros"), F.median("them_micros").alias("them_micros"), F.max(rank)["contact"].alias("ghosted_by")
    )
