"""Packs of facts, topics and myths, and voices of sentence templates, read from JSON files.

A folder of packs may lie wherever Spark reads; without one, the packs that come
with the library are taken. Files are whole JSON objects; one that doesn't parse or
has no id is skipped (a voice without an id goes by its file's name). Packs stand
with those that are always on first, then by file name. Of facts, topics and myths
with one id the first pack's row wins; locked packs give none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT = "struct<id:string,kind:string,value:double,statement:string,short:string,source:string,year:int,tags:array<string>,proper:boolean>"
TOPIC = "struct<patterns:array<string>,facts:array<string>>"
MYTH = "struct<id:string,claim:string,patterns:array<string>,truth:string,source:string,year:int,examples:array<string>>"
PACK = f"id string, name string, description string, always_on boolean, facts array<{FACT}>, topics array<{TOPIC}>, myths array<{MYTH}>"
VOICE_LISTS = ("percent", "percent_close", "ratio", "fallacy_percent", "fallacy_vague", "fallacy_ratio", "fallacy_change", "fallacy_myth", "appeal_proof", "appeal_authority", "appeal_popularity", "appeal_count")
VOICE = "id string, name string, " + ", ".join(f"{k} array<string>" for k in VOICE_LISTS)
HOUSE = "house"
#: Rows of packs and bytes of a file above which something else than a pack was given.
MOST_ROWS, MOST_BYTES = 20_000, 16 << 20


def _files(spark: SparkSession, path: str | None, folder: str) -> DataFrame:
    """file and content of each JSON file."""
    if path is None:
        top = resources.files("palaver") / "packs" / folder
        own = [(x.name, x.read_text(encoding="utf-8")) for x in sorted(top.iterdir(), key=lambda x: x.name) if x.name.endswith(".json")]
        return spark.createDataFrame(own, "file string, content string")
    found = spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))
    return found.where(F.col("size") <= MOST_BYTES).drop("size")


def packs(spark: SparkSession, path: str | None = None, enabled: list[str] | tuple[str, ...] = (), locked: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A row per pack: ord, the columns of PACK, locked and enabled. Of files with one id the first counts."""
    p = _files(spark, path, "").select("file", F.from_json("content", PACK).alias("p")).where("p.id is not null").select("file", "p.*")
    p = p.withColumn("always_on", F.coalesce("always_on", F.lit(False))).withColumn("name", F.coalesce("name", "id")).withColumn("description", F.coalesce("description", F.lit("")))
    # packs are a bounded table of files, so one window over them all is a small task
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("always_on"), "file"))).where("r = 1")
    p = p.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("always_on"), "file")).cast("long"))
    p = p.withColumn("locked", F.col("id").isin(list(locked)) & ~F.col("always_on")).withColumn("enabled", F.col("always_on") | (F.col("id").isin(list(enabled)) & ~F.col("locked")))
    return p.drop("file", "r")


def _items(p: DataFrame, what: str, key: str | None = "id") -> DataFrame:
    """The rows of one list of the enabled packs with pack and ord; of equal ids the first wins."""
    rows = p.where("enabled").select(F.col("ord").alias("pack_ord"), F.col("id").alias("pack"), F.posexplode(what).alias("i", "x")).select("pack_ord", "i", "pack", "x.*")
    if key:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("pack_ord", "i"))).where("r = 1").drop("r")
    return rows.withColumn("ord", (F.row_number().over(Window.orderBy("pack_ord", "i")) - 1).cast("long")).drop("pack_ord", "i")


def facts(p: DataFrame) -> DataFrame:
    f = _items(p, "facts")
    # a fact of the country has the tag or the ending
    return f.withColumn("american", F.array_contains(F.coalesce("tags", F.array()), "us") | F.col("id").endswith("-us"))


def topics(p: DataFrame) -> DataFrame:
    return _items(p, "topics", None)


def myths(p: DataFrame) -> DataFrame:
    return _items(p, "myths")


def pack_list(p: DataFrame) -> DataFrame:
    """id, name, description, facts, always_on, locked, enabled of each pack, those that are always on first, then by name."""
    return p.select("id", "name", "description", F.size("facts").cast("long").alias("facts"), "always_on", "locked", "enabled").orderBy(F.desc("always_on"), "name")


def voices(spark: SparkSession, path: str | None = None) -> DataFrame:
    v = _files(spark, path, "voices").select("file", F.from_json("content", VOICE).alias("v"), F.from_json("content", "map<string, string>").isNotNull().alias("ok")).where("ok and v is not null")
    v = v.select("file", F.coalesce("v.id", F.regexp_replace("file", r"\.json$", "")).alias("id"), *(F.col(f"v.{k}").alias(k) for k in ("name", *VOICE_LISTS)))
    v = v.where(F.coalesce(*(F.col(k) for k in VOICE_LISTS)).isNotNull())
    return v.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("file")))).where("r = 1").drop("r")


@dataclass
class Book:
    """What a set of enabled packs and a voice say, as plain rows: tables that are bounded by their files."""

    facts: list[dict] = field(default_factory=list)
    topics: list[dict] = field(default_factory=list)
    myths: list[dict] = field(default_factory=list)
    voice: dict[str, list[str]] = field(default_factory=dict)

    def fact_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f["ord"], f["id"], f["kind"], f["value"], f["statement"], f["short"], f["source"], f["year"], list(f["tags"] or []), bool(f["proper"]), f["american"], f["pack"]) for f in self.facts]
        return spark.createDataFrame(rows, "ord long, id string, kind string, value double, statement string, short string, source string, year int, tags array<string>, proper boolean, american boolean, pack string")


def open_book(spark: SparkSession, path: str | None = None, enabled=(), locked=(), voice: str = HOUSE, voice_path: str | None = None) -> Book:
    """The book of the enabled packs; an unknown voice is the house voice, which also fills a voice's gaps."""
    p = packs(spark, path, enabled, locked)

    def rows(df: DataFrame) -> list[dict]:
        got = [r.asDict(recursive=True) for r in df.orderBy("ord").limit(MOST_ROWS + 1).collect()]
        if len(got) > MOST_ROWS:
            raise ValueError(f"packs hold more than {MOST_ROWS} rows")
        return got

    known = {r["id"]: r.asDict() for r in voices(spark, voice_path).orderBy("file").limit(MOST_ROWS).collect()}
    if not known:
        raise ValueError("no voice was found")
    house = known.get(HOUSE) or next(iter(known.values()))
    own = known.get(voice) or house
    return Book(rows(facts(p)), rows(topics(p)), rows(myths(p)), {k: own[k] or house[k] or [] for k in VOICE_LISTS})


def first_of(conditions: list[Column]) -> Column:
    """The number of the first condition that holds, or null."""
    out = F.lit(None).cast("int")
    for i in range(len(conditions) - 1, -1, -1):
        out = F.when(conditions[i], F.lit(i)).otherwise(out)
    return out
