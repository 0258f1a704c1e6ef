"""Plain claims of digits and words, and what a corpus of claims meets in the packs of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packs import Book
from . import verdicts as V

# Order, phrase, point, low, high.
VAGUE = [(1, "most", 65.0, 50.5, 100.0), (2, "few", 10.0, 1.0, 25.0), (3, "half", 50.0, 42.0, 58.0), (4, "nobody", 1.0, 0.0, 1.0)]


def percent_claims(m: DataFrame) -> DataFrame:
    """Percentages in digits, one row each, in text order; over 100 they are no share."""
    found = F.regexp_extract_all("text", F.lit(r"([0-9]+)% of"), F.lit(1))
    return m.select("msg_id", F.posexplode(found).alias("i", "v")).select("msg_id", F.col("i").cast("long").alias("claim_no"), F.col("v").cast("double").alias("value")).where("value <= 100")


def one_in_n(m: DataFrame) -> DataFrame:
    """'a in b' and 'a out of b' with 0 < a <= b, as 100 a / b."""
    found = F.regexp_extract_all("text", F.lit("([0-9]+) (?:in|out of) [0-9]+"), F.lit(0))
    r = m.select("msg_id", F.posexplode(found).alias("i", "s")).select("msg_id", F.col("i").cast("long").alias("claim_no"), F.regexp_extract("s", "^([0-9]+)", 1).cast("double").alias("a"), F.regexp_extract("s", "([0-9]+)$", 1).cast("double").alias("b"))
    return r.where("a > 0 and a <= b").select("msg_id", "claim_no", (100 * F.col("a") / F.col("b")).alias("value"))


def vague_quantifiers(m: DataFrame) -> DataFrame:
    t = m.sparkSession.createDataFrame(VAGUE, "ord long, phrase string, point double, lo double, hi double")
    return m.join(F.broadcast(t), F.expr("regexp_like(lower(text), '(^|[^a-z])' || phrase || '([^a-z]|$)')")).select("msg_id", "phrase", "point", "lo", "hi")


def coincidences(book: Book, claims: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Pairs of percentages close by chance (different subjects, neither of health), with how many claims each of the two is a parallel of.

    Where no pair is that close, the first two percentages are the pair. The table of facts is bounded by its packs.
    """
    f = book.fact_table(claims.sparkSession).where("kind = 'percent'")
    a, b = f.alias("a"), f.alias("b")
    apart = ~F.arrays_overlap(F.array_remove("a.tags", "us"), F.array_remove("b.tags", "us")) & ~F.array_contains("a.tags", "health") & ~F.array_contains("b.tags", "health")
    every = a.join(V.near(b, len(book.facts)), F.col("a.ord") < F.col("b.ord")).select(F.col("a.id").alias("one"), F.col("b.id").alias("other"), F.abs(F.col("a.value") - F.col("b.value")).alias("gap"), apart.alias("apart"), F.col("a.ord").alias("i"), F.col("b.ord").alias("j"))
    w = Window.orderBy(~(F.col("apart") & (F.col("gap") <= tolerance)), "i", "j")
    pairs = every.withColumn("r", F.row_number().over(w)).where((F.col("apart") & (F.col("gap") <= tolerance)) | (F.col("r") == 1))
    met = V.parallels(claims, book).groupBy(F.col("other_id").alias("id")).agg(F.count("*").alias("n"))
    for c in ("one", "other"):
        pairs = pairs.join(met.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    return pairs.select("one", "other", F.round("gap", 2).alias("gap"), F.coalesce("n_one", F.lit(0)).alias("n_one"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


def pack_counts(packs: DataFrame, book: Book, checked: DataFrame) -> DataFrame:
    """Each pack's facts and flags, and how many of the claims its facts check."""
    used = checked.where("fact_id is not null").groupBy("fact_id").agg(F.count("*").alias("n"))
    own = book.fact_table(checked.sparkSession).select(F.col("id").alias("fact_id"), "pack").join(used, "fact_id").groupBy("pack").agg(F.sum("n").alias("checks"))
    listed = packs.select("id", "name", F.size("facts").cast("long").alias("facts"), "always_on", "locked", "enabled")
    return listed.join(own, listed["id"] == own["pack"], "left").select(F.col("id").alias("pack"), "facts", "always_on", "locked", "enabled", F.coalesce("checks", F.lit(0)).alias("checks"))


def card_fact(card: DataFrame, book: Book) -> DataFrame:
    """A card's share of sent messages beside the fact of the nearest size."""
    claim = card.select("*", F.lit("percent").alias("kind"), F.round(F.col("sent_share") * 100, 1).alias("value"), F.lit("exact").alias("quantifier"))
    met = V.parallels(claim, book, 1)
    return met.select(*card.columns, F.col("other_id").alias("fact_id"), "fact", F.round("gap", 1).alias("gap"))


def sentences_of(m: DataFrame) -> DataFrame:
    return m.select("msg_id", F.posexplode(F.regexp_extract_all("text", F.lit(V.SENTENCE), F.lit(0))).alias("i", "s")).select("msg_id", F.col("i").cast("long").alias("sentence_no"), "s")


def topics_in(claims: DataFrame, book: Book) -> DataFrame:
    """The first topic of each claim's clause."""
    return claims.select("msg_id", "start", V.topic_of(F.col("context"), book).cast("long").alias("topic")).where("topic is not null")


def myths_in(m: DataFrame, book: Book) -> DataFrame:
    names = F.array(*(F.lit(x["id"]) for x in book.myths))
    found = m.select("msg_id", F.explode(V.mythic_spans(F.col("text"), book)).alias("x"))
    return found.select("msg_id", "x.start", "x.end", F.get(names, F.col("x.myth")).alias("myth"))


def appeals_in(m: DataFrame) -> DataFrame:
    return m.select("msg_id", F.explode(V.appeals(F.col("text"))).alias("x")).select("msg_id", F.col("x.kind").alias("appeal"), "x.start", "x.said")
