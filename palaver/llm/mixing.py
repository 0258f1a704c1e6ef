r"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, by DataFrame expressions only.

Each source has a weight and thereby a target in words. Its documents fall by a
hash into blocks; blocks stand in a permuted order, anew in each pass over the
source. A source draws whole passes, then blocks of one more pass until its
target is met to the word: the last block gives its documents in hash order, and
the last document is cut. So each source has an exact quota of block draws.

The quotas are then shared out among output shards by a tree. A node holds its
sources' quotas and a range of shards; it gives its left half a multivariate
hypergeometric sample of them, drawn source by source by inversion from a hash,
and the rest to its right half. A leaf's quota of a source is the next stretch of
that source's draws, so shards draw disjoint blocks. In each shard, documents are
shuffled by a hash.

All random numbers are hashes of the seed and of what is drawn, so reruns agree.
A block has at most some millions of words, so the tables of blocks and draws are
small beside the corpus; all other rows are ids and sizes, dealt by source and
block, so that a hot source is dealt like many small ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all words that the mix takes: numerator and denominator
PASSES = 2
#: Blocks of all sources together, but for rounding up: so many, and one more for each BLOCK_WORDS words.
BLOCKS, BLOCK_WORDS = 8192, 1 << 24
#: Words of a shard, about.
SHARD_WORDS = 1 << 20
#: Up to so many sources (of at most a few hundred bytes each) their figures are sent to all executors; more are joined by salted keys.
NEAR_SOURCES = 10_000
SALTS = 64
SEED = 12


def _uniform(*of) -> Column:
    """A number in 0..1 (without 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11) / float(1 << 53)


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """doc_id, source, size (words), h (a hash that equal rows share) and the columns in keep."""
    text = docs[text_col].cast("string")
    h = F.xxhash64(F.lit(SEED), docs[id_col], text)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), *(docs[c].alias(f"_{c}") for c in keep))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, target, blocks, whole (passes) and rest (words of one more), a row for each source.

    Sources stand by code point, null last, and weigh WEIGHTS in turn. A target is
    the weight times one level, or PASSES times the source where that is less; the
    level is such that targets add up to SHARE of all words. Sources in order of
    size by weight: the first whose limit is above the level that the rest would
    share sets it. One row a source meets in one task, never its documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))).cast("int"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    s = s.withColumn("weight", weight.cast("long")).withColumn("limit", PASSES * F.col("source_size"))
    everyone, order = Window.partitionBy(), Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    s = s.withColumn("all", F.sum("source_size").over(everyone))
    s = s.withColumn("limits", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # words that are left for this source and all that stand behind it, times the denominator
    left = SHARE[0] * F.col("all") - SHARE[1] * F.col("limits")
    s = s.withColumn("free", SHARE[1] * big("limit") * big("weights") > left.cast("decimal(20,0)") * big("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "rank", left.alias("left"), "weights"))).over(everyone)
    s = s.withColumn("first", first)
    level = F.col("weight") * F.col("first.left") / (SHARE[1] * F.col("first.weights"))
    target = F.when(F.col("first").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), level))
    s = s.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    s = s.withColumn("blocks", F.greatest(F.lit(1), F.ceil((BLOCKS + F.col("all") / BLOCK_WORDS) * F.col("source_size") / F.greatest(F.col("all"), F.lit(1)))).cast("long"))
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(0).cast("long"))
    return s.select("source", "rank", "source_size", "target", "blocks", "whole", (F.col("take") - F.col("whole") * F.col("source_size")).alias("rest"))


def block_draws(blocks: DataFrame) -> DataFrame:
    """rank, pass, block, limit and at (from 0) of each draw: of a block's documents in order, the first `limit` words are taken.

    blocks has rank, block, words, whole, rest of each block with words.
    """
    d = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("pass"))
    order = Window.partitionBy("rank", "pass").orderBy(F.xxhash64(F.lit(SEED), "rank", "pass", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    limit = F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before")))
    d = d.withColumn("limit", limit).where("limit > 0")
    at = F.row_number().over(Window.partitionBy("rank").orderBy("pass", "before", "block")) - 1
    return d.select("rank", "pass", "block", "limit", at.cast("long").alias("at"))


def _log_factorial(n: Column) -> Column:
    """By Stirling's series from 10 on; below it, exactly."""
    small = F.get(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(10))), n.cast("int"))
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 10, small).otherwise(series)


def hypergeometric(u: Column, all_: Column, good: Column, drawn: Column) -> Column:
    """How many of `good` among `all_` are in a sample of `drawn`: by inversion at u, over all values within 12 standard deviations of the mean.

    Beyond those lies less than 1e-15 of the probability.
    """
    n, k, m = (x.cast("double") for x in (F.greatest(all_, F.lit(1)), good, drawn))
    mean = m * k / n
    wide = 12 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0)))) + 12
    low = F.greatest(F.greatest(F.lit(0).cast("long"), drawn + good - all_), F.ceil(mean - wide).cast("long"))
    high = F.least(F.least(good, drawn), F.floor(mean + wide).cast("long"))
    chance = lambda x: F.exp(-sum(map(_log_factorial, (x, good - x, drawn - x, all_ - good - drawn + x)), F.lit(0.0)) + sum(map(_log_factorial, (good, all_ - good, drawn, all_ - drawn)), F.lit(0.0)) - _log_factorial(all_))

    def step(acc, c):
        return F.struct((acc["sum"] + c).alias("sum"), (acc["x"] + F.when(acc["sum"] + c <= acc["goal"], 1).otherwise(0)).alias("x"), acc["goal"].alias("goal"))

    def drawn_at(values):
        chances = F.transform(values, chance)
        total = F.aggregate(chances, F.lit(0.0), lambda a, c: a + c)
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("x"), (u * total).alias("goal"))
        return F.least(high, low + F.aggregate(chances, zero, step, lambda a: a["x"]))

    # one value is possible: nothing to draw
    return F.when(low >= high, low).otherwise(drawn_at(F.sequence(low, F.greatest(low, high))))


def shard_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """shard, rank, quota: quotas (rank, n) shared out among `shards` shards, of about as many draws each.

    One row a node; a row holds the quotas that its node has, so the rows of a level together hold at most one entry for each draw.
    """
    node = quotas.where("n > 0").agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("q"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("q", "n", F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("count"))
    for level in range(math.ceil(math.log2(max(1, shards)))):
        lefts = F.col("count") - F.expr("count div 2")
        take = F.expr(f"n div count * ({'count - count div 2'}) + (n % count) * (count - count div 2) div count")

        def step(acc, x):
            m = hypergeometric(_uniform(F.col("first"), F.col("count"), x["rank"]), acc["n"], x["n"], acc["take"])
            made = F.transform(F.array(m), lambda m: F.struct((acc["n"] - x["n"]).alias("n"), (acc["take"] - m).alias("take"), F.concat(acc["out"], F.array(F.struct(x["rank"].alias("rank"), m.alias("n")))).alias("out")))
            return F.get(made, F.lit(0))

        zero = F.struct(F.col("n"), take.alias("take"), F.expr("cast(array() as array<struct<rank:int,n:bigint>>)").alias("out"))
        split = node.select("q", "n", "first", "count", lefts.alias("lefts"), take.alias("take"), F.explode(F.array(F.aggregate("q", zero, step, lambda acc: acc["out"]))).alias("l"))
        some = lambda q: F.filter(q, lambda x: x["n"] > 0)
        left = F.struct(some(F.col("l")).alias("q"), F.col("take").alias("n"), F.col("first"), F.col("lefts").alias("count"))
        rest = F.zip_with("q", "l", lambda a, b: F.struct(a["rank"].alias("rank"), (a["n"] - b["n"]).alias("n")))
        right = F.struct(some(rest).alias("q"), (F.col("n") - F.col("take")).alias("n"), (F.col("first") + F.col("lefts")).alias("first"), (F.col("count") - F.col("lefts")).alias("count"))
        node = split.select(F.explode(F.filter(F.array(left, right), lambda x: (x["count"] > 0) & (x["n"] > 0))).alias("x")).select("x.*")
        if level % 8 == 7:
            node = node.repartition("first")
    return node.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("shard", "x.rank", F.col("x.n").alias("quota"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (), shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each draw of each document, and one with no shard for each document that isn't drawn.

    doc_id, source, size, source_size, target, pass, words (of the document that
    this draw takes, from its beginning), shard, position (in the shard, from 0), and
    the columns in keep under _name; rank, block and no name the row.

    A null text has no words. Documents without words are in no draw. A null source
    is a source, the last. Very long documents are taken whole, or from their
    beginning where their source's target ends. Repeated rows are rows of their own
    with equal figures but for which of them is drawn. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = B.stage_table(sized(docs, id_col, source_col, text_col, list(keep)))
    sources = B.stage_table(source_targets(base.select("source", "size")))
    key = lambda d: d.withColumn("_none", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    wide, near = key(sources).drop("source"), sources.count() <= NEAR_SOURCES
    if near:
        rows = key(base).join(F.broadcast(wide), ["_none", "_name"])
    else:
        wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = key(base).withColumn("_salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(wide, ["_none", "_name", "_salt"]).drop("_salt")
    rows = rows.drop("_none", "_name").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    words = rows.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    draws = B.stage_table(block_draws(words.where("words > 0")))

    taken = sources.agg(F.sum(F.col("whole") * F.col("source_size") + F.col("rest"))).first()[0] or 0
    quotas = shard_quotas(draws.groupBy("rank").agg(F.count("*").alias("n")), max(1, math.ceil(taken / shard_words)))
    end = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))
    places = quotas.withColumn("end", end).select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("at"))
    of_block = draws.join(places, ["rank", "at"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "limit", "shard"))).alias("draws"))

    in_block = Window.partitionBy("rank", "block").orderBy("h", "doc_id", "size")
    rows = rows.drop("blocks", "whole", "rest").withColumn("no", F.row_number().over(in_block)).withColumn("before", F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    rows = rows.join(of_block, ["rank", "block"], "left")
    own = F.expr("filter(transform(draws, d -> struct(d.pass as pass, least(size, d.limit - before) as words, d.shard as shard)), d -> d.words > 0)")
    drawn = rows.withColumn("draw", F.explode_outer(own)).select("doc_id", "source", "size", "source_size", "target", "rank", "block", "no", "h", "draw.*", *(f"_{c}" for c in keep))
    # documents that are in no shard stand apart, so that they don't meet in one task
    local = Window.partitionBy("shard", F.when(F.col("shard").isNull(), F.struct("rank", "block"))).orderBy(F.xxhash64(F.lit(SEED), "shard", "h", "pass"), "rank", "block", "no", "pass")
    place = F.when(F.col("shard").isNotNull(), F.row_number().over(local) - 1).cast("long")
    return drawn.withColumn("position", place).drop("h")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, draws, and places as `shard:position` of each draw in order."""
    mixed = mix_sources(docs, **how)
    spot = F.when(F.col("shard").isNotNull(), F.struct("pass", F.concat_ws(":", "shard", "position").alias("at")))
    per = mixed.groupBy("rank", "block", "no").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.sort_array(F.collect_list(spot)).alias("p"))
    return per.select("doc_id", "size", "source_size", "target", "taken", F.size("p").cast("long").alias("draws"), F.array_join(F.col("p.at"), ",").alias("places"))
