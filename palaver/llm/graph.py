"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .blocks import stage_table


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex that links (a, b) lead to, for each vertex that has a link.

    Each round replaces links by links to smaller neighbours; the number of
    rounds grows with the logarithm of the longest path. No round holds a
    component in one task: minima are pre-aggregated, and the joins on a hub are
    plain equi-joins, which Spark splits when a hub is hot. Each half of a round
    is written before the next one reads it twice, and its joins are merge joins:
    long plans and tables to broadcast would pile up in the driver. Self-links,
    repeated links and an empty table are fine.
    """
    links = stage_table(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stage_table(both.join(low.hint("merge"), "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct())
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.hint("merge"), "u").select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).where("a <> b")
        told = Observation()
        links = stage_table(small.select("a", "b").distinct().observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
        now = (told.get["n"], told.get["s"])
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("label")).union(links.select("a", "a").distinct())
