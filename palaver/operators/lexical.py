"""Words, emoji, tone and spelling. Word lists are parameters of a fixed size and ride along as literals or broadcast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import emoji_of, is_media, noise, ratio, sentences, shouted, words_of
from ..functions.words import DICTIONARY, NEGATIVE, POSITIVE, SLANG, STOPWORDS

#: Longest word list that is broadcast; a longer one is joined by a shuffle.
BROADCAST_WORDS = 200_000


# Words of a view that are searched two edits away, and their longest.
FAR_SEARCHES, FAR_LETTERS = 3, 12


def word_table(df: DataFrame, words: list[str] | DataFrame, **columns) -> DataFrame:
    """The words as a table (lw); a dictionary may be given as such a table and is then joined by a shuffle."""
    if isinstance(words, DataFrame):
        return words.select("lw").distinct().withColumns({k: F.lit(v) for k, v in columns.items()})
    t = df.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "lw string").withColumns({k: F.lit(v) for k, v in columns.items()})
    return F.broadcast(t) if len(words) <= BROADCAST_WORDS else t


def tokens(m: DataFrame, direction: str | None = None, media: bool = False) -> DataFrame:
    """A row per word of the messages: pos, word and lw (lower case)."""
    rows = m if direction is None else m.where(F.col("direction") == direction)
    rows = rows if media else rows.where(~is_media(F.col("text")))
    return rows.select("msg_id", "contact", "sender", "direction", "ts", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).withColumn("lw", F.lower("word"))


def word_frequency(m: DataFrame, direction: str | None = None, limit: int | None = 50, min_len: int = 3) -> DataFrame:
    t = tokens(m, direction).where(F.length("lw") >= min_len)
    out = t.join(word_table(m, STOPWORDS), "lw", "left_anti").groupBy(F.col("lw").alias("word")).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), "word").limit(limit) if limit else out


def sentence_tokens(m: DataFrame) -> DataFrame:
    s = m.select("msg_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "s"))
    return s.select("msg_id", F.col("sentence_no").cast("long").alias("sentence_no"), F.size(words_of(F.col("s"))).cast("long").alias("words")).where("words > 0")


def noise_words(m: DataFrame) -> DataFrame:
    return tokens(m).where(noise(F.col("lw"))).groupBy("lw").agg(F.count("*").alias("count"))


def _checked(m: DataFrame, direction: str | None) -> DataFrame:
    """Words that a spelling check looks at; names (capital inside a sentence) and noise only count as checked."""
    rows = m if direction is None else m.where(F.col("direction") == direction)
    rows = rows.where(~is_media(F.col("text"))).withColumn("loud", shouted(F.col("text")))
    s = rows.select("msg_id", "contact", "sender", "ts", "text", "loud", F.posexplode(sentences(F.col("text"))).alias("s_no", "s"))
    t = s.select("msg_id", "contact", "sender", "ts", "text", "loud", "s_no", F.posexplode(words_of(F.col("s"))).alias("pos", "word")).withColumn("lw", F.lower("word"))
    return t.withColumn("looked_at", ~noise(F.col("lw")) & ~((F.col("pos") > 0) & F.col("word").rlike("^[A-Z]") & ~F.col("loud")))


def misspelled(m: DataFrame, dictionary: list[str] | DataFrame = DICTIONARY, direction: str | None = "sent") -> DataFrame:
    known = word_table(m, dictionary).union(word_table(m, SLANG)) if isinstance(dictionary, DataFrame) else word_table(m, [*dictionary, *SLANG])
    t = _checked(m, direction).where("looked_at").withColumn("raw", F.col("lw"))
    t = t.join(known, "lw", "left_anti").withColumn("lw", F.regexp_replace("raw", "'s$", ""))
    return t.join(known, "lw", "left_anti").withColumn("lw", F.col("raw")).drop("raw")


def misspellings_totals(m: DataFrame, dictionary: list[str] | DataFrame = DICTIONARY, direction: str | None = "sent") -> DataFrame:
    bad = misspelled(m, dictionary, direction).agg(F.count("*").alias("misspelled_total"), F.count_distinct("lw").alias("unique_words"))
    return _checked(m, direction).agg(F.count("*").alias("words_checked")).crossJoin(bad).select("words_checked", "misspelled_total", "unique_words", ratio(1000 * F.col("misspelled_total"), F.col("words_checked"), 2).alias("rate"))


def suggestions(words: DataFrame, dictionary: list[str] | DataFrame = DICTIONARY) -> DataFrame:
    """The nearest dictionary word one edit away (or one swap of neighbours), by shared deletions rather than by all pairs."""
    deletions = lambda c: F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))))
    known = word_table(words, dictionary).select(F.col("lw").alias("suggestion"), F.explode(deletions("lw")).alias("key"))
    near = words.select("lw", F.explode(deletions("lw")).alias("key")).join(known, "key").drop("key").distinct()
    swap = (F.length("lw") == F.length("suggestion")) & (F.levenshtein("lw", "suggestion") == 2) & (F.array_sort(F.split("lw", "")) == F.array_sort(F.split("suggestion", "")))
    d = F.when(swap, 1).otherwise(F.levenshtein("lw", "suggestion"))
    return near.withColumn("d", d).where("d <= 1").groupBy("lw").agg(F.min("suggestion").alias("suggestion"))


def _swapped(word):
    """All words with two neighbouring letters of a word swapped."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2)))


def far_suggestions(top: DataFrame, near: DataFrame, dictionary: list[str] | DataFrame = DICTIONARY) -> DataFrame:
    """The nearest dictionary word two edits away (a swap is one), for the FAR_SEARCHES most frequent words of at most FAR_LETTERS letters without one that is nearer.

    A few words meet the whole dictionary, so that it is read once and not indexed.
    """
    granted = top.join(near, "lw", "left_anti").where(F.length("lw") <= FAR_LETTERS).orderBy(F.desc("count"), "lw").limit(FAR_SEARCHES).select("lw")
    known = word_table(top, dictionary).select(F.col("lw").alias("suggestion"))
    word, other = F.col("lw"), F.col("suggestion")
    close = (F.levenshtein(word, other) <= 2) | F.exists(_swapped(word), lambda v: (F.levenshtein(v, other) <= 1) | F.exists(_swapped(v), lambda x: x == other))
    return known.join(F.broadcast(granted), (F.abs(F.length(word) - F.length(other)) <= 2) & close).groupBy("lw").agg(F.min("suggestion").alias("suggestion"))


def misspellings_words(m: DataFrame, dictionary: list[str] | DataFrame = DICTIONARY, direction: str | None = "sent", limit: int = 50) -> DataFrame:
    bad = misspelled(m, dictionary, direction).groupBy("lw").agg(F.count("*").alias("count"), F.min_by(F.left("text", F.lit(140)), F.struct("ts", "msg_id", "s_no", "pos")).alias("example"))
    top = bad.orderBy(F.desc("count"), "lw").limit(limit)
    near = suggestions(top.select("lw"), dictionary)
    far = far_suggestions(top, near, dictionary)
    return top.join(near.unionByName(far), "lw", "left").select(F.col("lw").alias("word"), "count", "suggestion", "example")


def misspellings_by(m: DataFrame, key: str, dictionary: list[str] | DataFrame = DICTIONARY, direction: str | None = "sent") -> DataFrame:
    n = misspelled(m, dictionary, direction).groupBy(key, "lw").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "lw"))).groupBy(key).agg(F.sum("n").alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "lw")))), lambda x: x["lw"]), ",").alias("top_words"))
    return best


def emoji_rows(m: DataFrame) -> DataFrame:
    return m.select("msg_id", "contact", "direction", "ts", F.explode(emoji_of(F.col("text"))).alias("emoji"))


def emoji_totals(m: DataFrame) -> DataFrame:
    e = emoji_of(F.col("text"))
    found = m.agg(F.coalesce(F.sum(F.size(e)), F.lit(0)).cast("long").alias("total"), F.count_if(F.size(e) > 0).alias("carriers"), F.count("*").alias("n"))
    return found.crossJoin(emoji_rows(m).agg(F.count_distinct("emoji").alias("unique_emoji"))).select("total", "unique_emoji", "carriers", ratio("carriers", "n", 3).alias("share"))


def emoji_top(m: DataFrame, limit: int | None = 30) -> DataFrame:
    g = emoji_rows(m).groupBy("emoji").agg(F.count("*").alias("count"), F.count_if(F.col("direction") == "sent").alias("sent"), F.count_if(F.col("direction") == "received").alias("received"))
    return g.orderBy(F.desc("count"), "emoji").limit(limit) if limit else g


def emoji_by_contact(m: DataFrame) -> DataFrame:
    n = emoji_rows(m).groupBy("contact", "emoji").agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("contact").orderBy(F.desc("n"), "emoji")))
    return r.groupBy("contact").agg(F.sum("n").alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "emoji")))), lambda x: x["emoji"]), " ").alias("top_emoji"))


def _tone_rows(m: DataFrame, positive, negative) -> DataFrame:
    lexicon = word_table(m, positive, polarity=1).union(word_table(m, [w for w in negative if w not in set(positive)], polarity=-1))
    return tokens(m).join(F.broadcast(lexicon) if len(positive) + len(negative) <= BROADCAST_WORDS else lexicon, "lw")


_TONE = lambda: [F.count_if(F.col("polarity") > 0).alias("positive"), F.count_if(F.col("polarity") < 0).alias("negative")]


def tone(m: DataFrame, *by: str, positive=tuple(POSITIVE), negative=tuple(NEGATIVE)) -> DataFrame:
    """Positive and negative words in all, or by columns; net = (p - n) / (p + n), to three digits, half to even."""
    rows = _tone_rows(m, positive, negative).withColumn("month", F.month("ts").cast("long")).withColumn("year", F.year("ts").cast("long"))
    g = rows.groupBy(*by).agg(*_TONE()) if by else rows.agg(*_TONE())
    net = (F.col("positive") - F.col("negative")).cast("double") / F.nullif(F.col("positive") + F.col("negative"), F.lit(0).cast("long"))
    return g.withColumn("net", F.bround(F.coalesce(net, F.lit(0.0)), 3))


def tone_words(m: DataFrame, limit: int = 15, positive=tuple(POSITIVE), negative=tuple(NEGATIVE)) -> DataFrame:
    n = _tone_rows(m, positive, negative).groupBy("polarity", "lw").agg(F.count("*").alias("count"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("polarity").orderBy(F.desc("count"), "lw")))
    return r.where(F.col("r") <= limit).select(F.col("polarity").cast("long").alias("polarity"), F.col("lw").alias("word"), "count")
