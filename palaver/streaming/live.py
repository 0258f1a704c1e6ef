"""Streams of messages: the same questions asked of messages as they arrive.

Every stream takes the columns of a message (see sources/driver_tables.py).
State is bounded by a watermark; what comes later than that is left out, and a
batch view over the written table still counts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, search, volume

SCHEMA = "msg_id long, contact string, sender string, direction string, ts timestamp_ntz, text string, source string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of messages, as they are added to a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(m: DataFrame, late: str) -> DataFrame:
    """Event time with a zone, which watermarks need; the session zone is UTC, so the wall clock stays."""
    return m.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def sessions(m: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Conversations of each contact, given once they can't grow any more.

    A window of sessions ends `gap` after its last message and takes one that comes
    exactly then, as the batch view does.
    """
    s = _timed(m, late).groupBy("contact", F.session_window("at", gap).alias("w"))
    done = s.agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "sent").alias("sent"), F.max("at").alias("last"))
    return done.select("contact", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("end"), "n", "sent")


def volume_by_hour(m: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages in each hour of the calendar, by direction."""
    w = _timed(m, late).groupBy(F.window("at", "1 hour").alias("w"), "direction").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "direction", "n")


def new_claims(m: DataFrame, late: str = "1 hour") -> DataFrame:
    """Claims of each contact, each key once while the watermark remembers it."""
    found = extract.extract_claims(_timed(m, late), keep=["contact", "at"])
    keyed = found.withColumn("key", extract.claim_key(F.col("kind"), F.col("value"), F.col("subject")))
    return keyed.dropDuplicatesWithinWatermark(["contact", "key"])


def append_stream(m: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Adds each batch to a Parquet table without what is there already.

    The anti-join makes a batch that is run again after a lost driver add nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        search.append_or_create(table, batch)

    writer = m.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def keep_contacts(m: DataFrame, table: str, view: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Adds each batch to a table of messages and counts the contacts that it touches anew, over all their messages.

    Late messages always count, as whole contacts are read again. What a batch makes
    of its contacts is one version of the view; the last version of a contact holds.
    A batch that is run again overwrites its version.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        search.append_or_create(table, batch)
        touched = batch.select("contact").distinct()
        own = batch.sparkSession.read.parquet(table).join(touched, "contact", "left_semi")
        volume.contact_frequency(own).write.mode("overwrite").parquet(f"{view}/version={number}")
        batch.unpersist()

    writer = m.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def contacts_now(spark: SparkSession, view: str) -> DataFrame:
    """The newest version of each contact."""
    v = spark.read.parquet(view)
    last = v.groupBy("contact").agg(F.max("version").alias("version"))
    return v.join(last, ["contact", "version"]).drop("version")
