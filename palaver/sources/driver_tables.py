"""Messages projected from the test tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own phrases: text of message i is phrase i modulo their number.
PHRASES = [
    "See you at the station around nine.", "I love this place, it is wonderful!", "That was awful and I am sad about it.", "<Media omitted>",
    "Happy birthday 🎉🎉 have a great day", "ok", "Did you read the report? 45% of trains were late.", "Around 1 in 5 people skip breakfast.",
    "Most people never check the label.", "teh meeting moved to friday", "I can't come, don't wait for me", "I can’t come, don’t wait for me",
    "Good morning 😀 how are you?", "image omitted", "We recieved the parcel today.", "Three of us went hiking near the lake last weekend.",
    "Everyone knows that vaccines are bad. Experts say so.", "haha that is sooo funny lol", "Half of all adults own a bike.", "It grew from 10% to 15% last year.",
    "www.example.org has the map, see https://example.com/a?b=1 @anna #trip", "My garden is happy and bright.", "HELLO THERE FRIEND", "1 out of 4 flights leave late and 60% of them are full.",
    "Nobody likes a broken lamp, what a terrible mess.", "Few people cook every day.", "Thanks 👍🏽 that helps", "Beautiful weather, nice walk, good food.",
]

#: Sentences with figures, one for each message of a conversation; {v} is 0..100, {w} is v + 2, {n} is 2..10, {a} and {b} are 10..29 and 31..60.
CLAIMS = [
    "{v}% of Americans own a smartphone.", "{v}% of people don't drink alcohol.", "{v}% of the world lives in cities.", "{v}% of Brits drink wine.",
    "You only use 10% of your brain.", "Studies show {v}% of adults have a tattoo.", "Crime went up {w}% last year.", "It is {w} times faster, they say.",
    "Everyone knows that the earth is flat.", "Honestly, most people drink coffee.", "1 in {n} adults are obese.", "nobody reads books.",
    "It fell from {b}% to {a}% again.", "I am 100% sure about it.", "Millions of people have no electricity.", "Hardly anyone smokes.",
]

COLUMNS = ["msg_id", "contact", "sender", "direction", "ts", "text", "source"]


def messages_from_events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    contact = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    sent = F.col("event_type").isin("click", "purchase")
    phrases = F.array(*map(F.lit, PHRASES))
    return e.select(
        F.col("event_id").cast("long").alias("msg_id"), contact.alias("contact"), F.when(sent, F.lit("me")).otherwise(F.concat_ws("_", contact, "event_type")).alias("sender"),
        F.when(sent, "sent").otherwise("received").alias("direction"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.get(phrases, (F.col("event_id") % len(PHRASES)).cast("int")).alias("text"), F.lit("events").alias("source"),
    )


def messages_from_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    user = F.col("role") == "user"
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("contact"), F.when(user, "me").otherwise(F.col("role")).alias("sender"),
        F.when(user, "sent").otherwise("received").alias("direction"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int))").alias("ts"), F.coalesce("text", F.lit("")).alias("text"), F.lit("conversations").alias("source"),
    )


def messages_with_claims(spark: SparkSession, d: str) -> DataFrame:
    """Messages of conversations, each with a sentence of CLAIMS before its own text; ids, turns and lengths choose it and its figures."""
    m = messages_from_conversations(spark, d)
    conv, turn = F.expr("msg_id div 1000"), F.col("msg_id") % 1000
    v = (conv * 13 + turn * 29 + F.length("text")) % 101
    text = F.get(F.array(*map(F.lit, CLAIMS)), ((conv * 7 + turn * 3) % len(CLAIMS)).cast("int"))
    for name, value in (("v", v), ("w", v + 2), ("n", v % 9 + 2), ("a", v % 20 + 10), ("b", v % 30 + 31)):
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    return m.withColumn("text", F.concat(text, F.lit("\n"), F.col("text")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EVENTS_SQL = f"""msgs AS (
  SELECT event_id AS msg_id, 'user_' || user_id AS contact,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'me' ELSE 'user_' || user_id || '_' || event_type END AS sender,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'sent' ELSE 'received' END AS direction,
         CAST(ts AS TIMESTAMP) AS ts, ([{", ".join(map(_quoted, PHRASES))}])[event_id % {len(PHRASES)} + 1] AS text, 'events' AS source
  FROM events)"""

CONVERSATIONS_SQL = """msgs AS (
  SELECT conv_id * 1000 + turn AS msg_id, 'conv_' || conv_id AS contact, CASE WHEN role = 'user' THEN 'me' ELSE role END AS sender,
         CASE WHEN role = 'user' THEN 'sent' ELSE 'received' END AS direction,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts, coalesce(text, '') AS text, 'conversations' AS source
  FROM conversations)"""

#: As messages_with_claims, with t (the sentence) and v besides.
CLAIMS_SQL = f"""talk AS (SELECT *, CASE WHEN role = 'user' THEN 'me' ELSE role END AS sender, coalesce(text, '') AS own, conv_id * 1000 + turn AS msg_id, (conv_id * 7 + turn * 3) % {len(CLAIMS)} AS t, (conv_id * 13 + turn * 29 + length(coalesce(text, ''))) % 101 AS v FROM conversations),
msgs AS (SELECT msg_id, 'conv_' || conv_id AS contact, sender, CASE WHEN role = 'user' THEN 'sent' ELSE 'received' END AS direction, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts,
  replace(replace(replace(replace(replace(([{", ".join(map(_quoted, CLAIMS))}])[t + 1], '{{v}}', v::VARCHAR), '{{w}}', (v + 2)::VARCHAR), '{{n}}', (v % 9 + 2)::VARCHAR), '{{a}}', (v % 20 + 10)::VARCHAR), '{{b}}', (v % 30 + 31)::VARCHAR) || chr(10) || own AS text, 'conversations' AS source, t, v FROM talk)"""
