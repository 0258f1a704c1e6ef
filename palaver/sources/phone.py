"""A phone's message database (SQLite) as a Spark data source, partitioned by row id, and the decoding of typed bodies.

The file must lie where the driver and all executors reach it. It is opened read-only. Before a
row is read, the four relations must be plain tables without generated columns, as a
view could compute without end; and each query ends after a time budget.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The relations that are read, and seconds between the epochs of 1970 and 2001.
TABLES = ("message", "handle", "chat", "chat_message_join")
EPOCH_2001 = 978_307_200
BUDGET_SECONDS = 10.0
ROWS_PER_PARTITION = 200_000
SCHEMA = "row_id long, date long, is_from_me int, text string, body binary, handle string, chat_identifier string, display_name string"


class UnexpectedDatabase(ValueError):
    """The file is not a plain message database."""


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ChatDatabase(DataSource):
    """Options: path, rows (per partition), seconds (a query's budget)."""

    @classmethod
    def name(cls) -> str:
        return "chat_db"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChatReader(dict(self.options))


class ChatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rows, self.seconds = int(options.get("rows", ROWS_PER_PARTITION)), float(options.get("seconds", BUDGET_SECONDS))

    def _open(self):
        import sqlite3

        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        kinds = dict(db.execute(f"SELECT name, type FROM sqlite_master WHERE name IN ({', '.join('?' * len(TABLES))})", TABLES))
        for table in TABLES:
            if kinds.get(table) != "table":
                raise UnexpectedDatabase(f"{table} is {kinds.get(table, 'missing')}, not a table")
            # the last field tells stored and virtual generated columns
            if any(column[6] in (2, 3) for column in db.execute(f"PRAGMA table_xinfo({table})")):
                raise UnexpectedDatabase(f"{table} has a generated column")
        end = time.monotonic() + self.seconds
        db.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
        return db

    def _run(self, db, query: str, values=()) -> Iterator[tuple]:
        import sqlite3

        try:
            yield from db.execute(query, values)
        except sqlite3.OperationalError as e:
            raise UnexpectedDatabase(f"reading took more than {self.seconds} s or failed: {e}") from e

    def partitions(self) -> list[InputPartition]:
        db = self._open()
        try:
            first, last = next(self._run(db, "SELECT min(ROWID), max(ROWID) FROM message"))
        finally:
            db.close()
        if first is None:
            return []
        return [RowRange(i, min(last, i + self.rows - 1)) for i in range(first, last + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        db = self._open()
        try:
            # a message in several chats is of the first
            query = """
                SELECT m.ROWID, CAST(m.date AS INTEGER), m.is_from_me, m.text, m.attributedBody, h.id, c.chat_identifier, c.display_name
                FROM message m LEFT JOIN handle h ON h.ROWID = m.handle_id
                LEFT JOIN (SELECT message_id, min(chat_id) AS chat_id FROM chat_message_join WHERE message_id BETWEEN ? AND ? GROUP BY message_id) j ON j.message_id = m.ROWID
                LEFT JOIN chat c ON c.ROWID = j.chat_id
                WHERE m.ROWID BETWEEN ? AND ?"""
            for row in self._run(db, query, (partition.first, partition.last) * 2):
                body = row[4].encode() if isinstance(row[4], str) else row[4]
                yield (*row[:3], None if row[3] is None else str(row[3]), body, *(None if x is None else str(x) for x in row[5:]))
        finally:
            db.close()


def typed_text(body: Column) -> Column:
    """The string of a typed body: behind NSString and five bytes a length, in one byte or as 0x81 and two little-endian bytes, then UTF-8.

    Empty where there is none. Bytes that are no UTF-8 and control characters go.
    """
    # one character for each byte, so that positions are bytes
    b = F.decode(body, "ISO-8859-1")
    at = F.instr(b, "NSString")
    rest = F.substr(b, at + 8)
    rest = F.when(F.length(rest) > 5, F.substr(rest, F.lit(6))).otherwise(rest)
    size = lambda r, i: F.ascii(F.substr(r, F.lit(i), F.lit(1)))

    def read(r: Column) -> Column:
        long = size(r, 1) == 0x81
        raw = F.when(long, F.substr(r, F.lit(4), size(r, 2) + 256 * size(r, 3))).otherwise(F.substr(r, F.lit(2), size(r, 1)))
        # U+FFFD that was written stays, what stands for broken bytes goes
        kept = F.replace(raw, F.lit("ï¿½"), F.lit("\u0001"))
        text = F.replace(F.make_valid_utf8(F.encode(kept, "ISO-8859-1").cast("string")), F.lit("�"), F.lit(""))
        return F.replace(F.regexp_replace(text, r"[\x00\x02-\x08\x0b-\x1f]", ""), F.lit("\u0001"), F.lit("�"))

    found = F.get(F.transform(F.array(rest), read), F.lit(0))
    return F.when(body.isNull() | (at == 0) | (F.length(rest) == 0), "").otherwise(found)


def seconds_since_1970(date: Column) -> Column:
    """Of seconds, or on newer systems nanoseconds, since 2001."""
    return F.when(date > 10**12, date / 10**9).otherwise(date.cast("double")) + EPOCH_2001


def messages_of(rows: DataFrame, self_name: str, zone: str = "UTC") -> DataFrame:
    """Rows of SCHEMA as messages; those without text or time are left out. The contact is the chat's name, else its id, else the other's."""
    text = F.coalesce(F.nullif("text", F.lit("")), typed_text(F.col("body")))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    me, handle = F.col("is_from_me") == 1, F.coalesce(filled("handle"), F.lit("Unknown"))
    ts = F.from_utc_timestamp(F.timestamp_seconds(seconds_since_1970(F.col("date"))), zone).cast("timestamp_ntz")
    out = rows.select(F.coalesce(filled("display_name"), filled("chat_identifier"), handle).alias("contact"), F.when(me, self_name).otherwise(handle).alias("sender"), F.when(me, "sent").otherwise("received").alias("direction"), ts.alias("ts"), text.alias("text"), F.lit("imessage").alias("source"))
    return out.where("ts is not null and text <> ''")


def chat_database(spark: SparkSession, path: str, self_name: str, zone: str = "UTC", rows: int = ROWS_PER_PARTITION, seconds: float = BUDGET_SECONDS) -> DataFrame:
    spark.dataSource.register(ChatDatabase)
    own = path.removeprefix("file://").removeprefix("file:")
    return messages_of(spark.read.format("chat_db").option("path", own).option("rows", rows).option("seconds", seconds).load(), self_name, zone)
