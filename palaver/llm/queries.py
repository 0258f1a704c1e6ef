"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, forest, mixing, ngram_join, packing, periodic, pii, quality, rnn_lm, rules, substring, toxicity


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.similar_classes(_table(spark, d, "documents"))


def op2_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op3_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, d, "documents"), digest=True)


def op4_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, d, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def op5_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, d, "documents"), digest=True)


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op7_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return rnn_lm.score_texts(_table(spark, d, "documents"))


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.judge_quality(_table(spark, d, "documents"))


def op9_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return forest.nearest_neighbours(_table(spark, d, "embeddings"))


def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"))


def _repeated_from(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 ends in 0 repeat a stretch of their words to their end, as the contract of op11 has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.withColumn("_w", F.when(h % 10 == 0, F.filter(F.split("text", rules.SPACES), lambda x: x != "")))
    d = d.withColumn("_g", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")).withColumn("_n", F.size("_w").cast("long"))
    d = d.withColumn("_a", F.expr("case when _n > 0 then _g % _n end")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    words = F.expr("transform(sequence(0, _n - 1), i -> get(_w, cast(if(i < _a, i, _a + (i - _a) % _p) as int)))")
    return d.select("doc_id", F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic.periodic_runs(_repeated_from(_table(spark, d, "documents"))).withColumn("best", periodic.strongest_run())
    said = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), sha(said).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_table(spark, d, "documents"))


def op13_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align_tokens(_table(spark, d, "documents"), digest=True)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_substring_dedup, op4_pii, op5_bpe, op6_toxicity, op7_lm_scoring, op8_quality_rules, op9_nearest_neighbours, op10_packing, op11_periodic_runs, op12_source_mixing, op13_token_alignment)}

_WORDS_SQL = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# the checksum's eight steps for each byte, which are marked by -1
_CRC_SQL = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

#: What SQL expresses whole is compared with DuckDB; the others are tested against brute force (tests/llm).
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL.format(_LOWER_SQL)} AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM w),
  grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
  links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
  ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM sets JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) ON v = doc_id""",
    "op3_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS w FROM documents),
  windows AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1:i + 20], ' '))) AS g FROM w WHERE len(w) >= 20),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_periodic_runs": f"""WITH d0 AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS w, {_CRC_SQL} AS h FROM documents),
  d1 AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d0), d2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d1),
  d3 AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT)]) ELSE w END AS w FROM d2),
  words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d3),
  same AS (SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
  isles AS (SELECT doc_id, p, min(i) AS b, max(i) + 1 + p AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same) GROUP BY doc_id, p, k),
  runs AS (SELECT doc_id, b, e - b AS l, min(p) AS p FROM isles WHERE e - b >= greatest(6, 4 * p) GROUP BY doc_id, b, e),
  gone AS (SELECT DISTINCT doc_id, unnest(range(b + p, b + l)) AS i FROM runs),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
  best AS (SELECT doc_id, b, l, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / p DESC, b, p) AS r FROM runs) WHERE r = 1),
  said AS (SELECT doc_id, count(*) AS n_runs, string_agg(b || ',' || l || ',' || p || chr(10), '' ORDER BY b, p) AS t FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b AS start, l AS length, best.p AS period, 1000 * l // best.p AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256 FROM d3 LEFT JOIN best USING (doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
