"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Quality classifier, n-gram Jaccard join, substring dedup, personal data, packing.
All but the last return the columns of documents. Each gives its rows a key
first, so that every row gets its own decision, whether its doc_id is null or
repeated. A stage's intermediate tables go when the next stage begins, as its
result has been written by then: a stage's result must be written (or collected)
before another stage is called.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import blocks, ngram_join, packing, pii, quality, substring


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row (_row); written to the shared folder, so that the key stays what it is."""
    return blocks.stage_table(docs.withColumn("_row", F.monotonically_increasing_id()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    rows = keyed(docs)
    good = quality.score_quality(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col="_row").where("predicted = 1")
    return rows.join(good, rows["_row"] == good["row"], "left_semi").select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id (a null comes last; of equal ids the first row)."""
    rows = keyed(docs)
    classes = ngram_join.similar_classes(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    first = blocks.stage_table(rows.select("doc_id", "_row").join(classes, "_row").groupBy("component_id").agg(best.alias("best")).select(F.col("best._row").alias("_kept")))
    return rows.join(first, rows["_row"] == first["_kept"], "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that stand earlier, by id, then row; texts without any such word stay as they are, emptied ones go."""
    rows = keyed(docs)
    cut = substring.dedup_substrings(rows, row_col="_row").where("n_removed > 0").select("row", "kept")
    joined = rows.join(cut, rows["_row"] == cut["row"], "left").where("kept is null or kept <> ''")
    text = F.coalesce("kept", "text")
    return joined.withColumns({"text": text, "n_chars": F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long")}).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets."""
    rows = keyed(docs)
    found = pii.find_personal_data(rows, id_col="_row").where("spans <> ''").select(F.col("doc_id").alias("_found"), "found")
    joined = rows.join(found, rows["_row"] == found["_found"], "left")
    kinds = F.array(*(F.lit(f"<{k}>") for k in pii.KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        clear = F.substr("text", acc["at"] + 1, x["b"] - acc["at"])
        masked = F.struct(x["e"].alias("at"), F.concat(acc["out"], clear, F.get(kinds, x["k"])).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["b"] >= acc["at"], masked).otherwise(inside)

    text = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    joined = joined.withColumn("_new", F.when(F.col("found").isNotNull(), text))
    return joined.withColumns({"text": F.coalesce("_new", "text"), "n_chars": F.when(F.col("_new").isNull(), F.col("n_chars")).otherwise(F.length("_new")).cast("long")}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


#: Intermediate tables of the last stage that ran.
_last = blocks.Staged()


def _stage(f):
    @wraps(f)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        _last.drop(spark)
        with blocks.Staged() as own:
            out = f(spark, docs, sf_dir)
        _last = own if f is not pack else blocks.Staged()  # the last result may be read later
        return out

    return run_one


STAGES = [
    ("quality classifier", _stage(keep_quality)),
    ("n-gram Jaccard join", _stage(keep_one_of_each_class)),
    ("substring dedup", _stage(drop_repeated_passages)),
    ("personal data", _stage(mask_personal_data)),
    ("packing", _stage(pack)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = blocks.stage_table(docs)
    return docs
