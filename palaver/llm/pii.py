r"""Personal data: base patterns, and identifiers that bootstrapped contexts find.

Base spans are emails, IP addresses, card numbers (Luhn) and phone numbers. They
seed the method, together with long hexadecimal strings (kind "secret", which are
never base spans). Each seed's neighbouring words form lexical patterns: the word
before with the word after, the two words before, and the two words after; the
text's begin and end count as words. A pattern's score is the mean score of the
different identifier-like strings it stands by, an identifier's score the mean
score of its patterns, seeds staying at 1; the graph of patterns and identifiers
is scored in rounds. Patterns of enough different seeds and a high score then mark
the identifiers that they stand by. A run of digits that has a card's length but
fails its test is evidence against a pattern, and never found.

DataFrame functions only. Positions come from lengths of what lies between the
matches. Java's matcher recurses into repeated groups, unless they are possessive;
so the only one here is, and single separators between digits are first replaced
by one private character, which turns a card into a plain run. Texts of any
length then need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: The base kinds, and one that only contexts find.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4
#: Kinds of candidates: open, and refuted by a test that its form must pass.
OPEN, REFUTED = -1, -2
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_MARK, _UNMARK = "\ue000", "\ue001"
#: Digits and marks as long as a card at least; a shorter run holds no such match.
RUN = f"[0-9][0-9{_MARK}]{{11,}}"
CHUNK = 256
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit or @ in it.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*"
#: Different seeds that a pattern needs, and the score from which it is believed.
SUPPORT, BELIEF, ROUNDS = 3, 0.8, 3


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<b, e, m>>: begin, end and match of all matches, by code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("g"), m.alias("m")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<b int, e int, m string>>)").alias("out"))

    def step(acc, x):
        b = acc["at"] + x["g"]
        e = b + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(b.alias("b"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    # positions within pieces of CHUNK matches, then those of the pieces: appending stays short in texts of very many matches
    pieces = _bound(pairs, lambda ps: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(ps) - 1) / CHUNK).cast("int"), F.lit(0))), lambda c: F.aggregate(F.slice(ps, c * CHUNK + 1, F.lit(CHUNK)), start, step)))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    starts = lambda ps: F.aggregate(ps, begin, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    moved = lambda p, by: F.transform(p["out"], lambda x: F.struct((x["b"] + by).alias("b"), (x["e"] + by).alias("e"), x["m"].alias("m")))
    return _bound(pieces, lambda ps: F.flatten(F.zip_with(ps, starts(ps), moved)))


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    double = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    value = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _base(text: Column) -> Column:
    """Kind number, begin and end of all base spans, sorted by begin, then kind."""
    only = lambda m: F.regexp_replace(m, "[^0-9]", "")
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    good_ip = lambda x: F.forall(F.split(x["m"], r"\."), lambda p: small(p) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    good_card = lambda x: F.when(F.length(only(x["m"])).between(12, 19), _luhn(only(x["m"]))).otherwise(False)
    runs = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_UNMARK)), r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
    none = F.expr("cast(array() as array<struct<b int, e int, m string>>)")
    guard = lambda has, spans: F.when(has, spans).otherwise(none)
    by_kind = [
        guard(F.contains(text, F.lit("@")), _spans(text, EMAIL)),
        F.filter(guard(text.rlike(r"[0-9]\.[0-9]"), _spans(text, IP)), good_ip),
        F.filter(guard(text.rlike(r"[0-9][\x20-]?[0-9]"), _spans(runs, RUN)), good_card),
        F.filter(guard(F.contains(text, F.lit("+")), _spans(text, PHONE)), lambda x: F.length(only(x["m"])).between(9, 15)),
    ]
    of_kind = lambda k: lambda x: F.struct(x["b"].alias("b"), F.lit(k).alias("k"), x["e"].alias("e"))
    cut = [F.transform(spans, of_kind(k)) for k, spans in enumerate(by_kind)]
    return F.array_sort(F.concat(*cut))


def _patterns(near: Column, b: Column, e: Column) -> Column:
    """Lexical patterns around a span, from words in lower case without punctuation at their outer ends; near: the text from 60 before to 60 after it."""
    skip = F.least(b, F.lit(60))
    before = F.concat(F.lit("^ ^ "), F.substr(near, F.lit(1), skip))
    after = F.concat(F.substr(near, skip + e - b + 1, F.lit(60)), F.lit(" $ $"))
    word = r"[^\x20\x09-\x0D]"
    words = lambda v: F.filter(F.split(F.lower(v), r"[\x20\x09-\x0D]+"), lambda x: x.rlike(word))
    left = words(F.regexp_replace(before, r"[\"'(\[<{]+$", ""))
    right = F.transform(words(F.regexp_replace(after, r"^[\"')\]>}.,;:!?]+", "")), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", ""))
    n = F.size(left)
    l1, l2, r1, r2 = F.get(left, n - 1), F.get(left, n - 2), F.get(right, F.lit(0)), F.get(right, F.lit(1))
    return F.array(F.concat_ws("\t", l1, F.lit("*"), r1), F.concat_ws("\t", l2, l1, F.lit("*")), F.concat_ws("\t", F.lit("*"), r1, r2))


def mentions(docs: DataFrame) -> DataFrame:
    """Per row: base spans, and seeds and candidates as (b, e, kind, value, patterns)."""
    t = F.col("text")
    d = docs.withColumn("base", F.when(t.rlike("[0-9@]"), _base(t)).otherwise(F.expr("cast(array() as array<struct<b int, k int, e int>>)")))
    tokens = F.when(t.rlike("[0-9@]"), _spans(t, TOKEN)).otherwise(F.expr("cast(array() as array<struct<b int, e int, m string>>)"))
    like = lambda x: (F.regexp_count(x["m"], F.lit("[0-9]")) >= 6) | x["m"].rlike("[A-Za-z0-9]@[A-Za-z0-9]")
    trim = lambda x: F.regexp_extract(x["m"], r"^[\"'(\[<{]*", 0)
    core = lambda x: F.regexp_replace(F.substr(x["m"], F.length(trim(x)) + 1, F.length(x["m"])), r"[\"')\]>},.;:!?]*$", "")
    tokens = F.transform(F.filter(tokens, like), lambda x: F.struct((x["b"] + F.length(trim(x))).alias("b"), (x["b"] + F.length(trim(x)) + F.length(core(x))).alias("e"), core(x).alias("m")))
    free = lambda x: ~F.exists("base", lambda y: (y["b"] < x["e"]) & (x["b"] < y["e"]))
    d = d.withColumn("cand", F.filter(F.filter(tokens, like), free))
    part = lambda b, e, k, v: F.struct(b.alias("b"), e.alias("e"), k.alias("kind"), v.alias("value"), _bound(F.substr(t, F.greatest(b - 60, F.lit(0)) + 1, F.least(b, F.lit(60)) + e - b + 60), lambda near: _patterns(near, b, e)).alias("ctx"))
    seeds = F.transform("base", lambda x: part(x["b"], x["e"], x["k"], F.lower(F.substr(t, x["b"] + 1, x["e"] - x["b"]))))
    kind = lambda x: F.when(x["m"].rlike("^[0-9A-Fa-f]{32,}$") & x["m"].rlike("[A-Fa-f]"), SECRET).when(x["m"].rlike("^[0-9-]{12,}$"), REFUTED).otherwise(OPEN)
    found = F.transform("cand", lambda x: part(x["b"], x["e"], kind(x), F.lower(x["m"])))
    return d.select("doc_id", "base", F.concat(seeds, found).alias("seen"))


def believed(rows: DataFrame, support: int = SUPPORT, belief: float = BELIEF, rounds: int = ROUNDS) -> DataFrame:
    """(row, b, e, kind) of candidates in contexts that the scored graph trusts; of several contexts the most trusted tells the kind."""
    edges = rows.select("row", F.explode("seen").alias("x")).select("row", "x.b", "x.e", "x.kind", "x.value", F.explode("x.ctx").alias("ctx"))
    graph = B.stage_table(edges.groupBy("ctx", "value").agg(F.max("kind").alias("kind")))
    worth = graph.select("value", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0).alias("score"), (F.col("kind") >= 0).alias("seed")).groupBy("value").agg(F.max("score").alias("score"), F.max("seed").alias("seed"))
    for i in range(rounds):
        lit = graph.join(worth, "value")
        patterns = lit.groupBy("ctx").agg((F.sum("score") / (F.count("*") + 0.5)).alias("trust"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        if i + 1 < rounds:
            worth = B.stage_table(graph.join(patterns, "ctx").join(worth.select("value", "seed"), "value").groupBy("value").agg(F.when(F.max("seed"), 1.0).when(F.max("kind") == REFUTED, 0.0).otherwise(F.avg(F.when(F.col("seeds") >= support, F.col("trust")).otherwise(0.0))).alias("score"), F.max("seed").alias("seed")))
    kinds = graph.where("kind >= 0").groupBy("ctx", "kind").count().groupBy("ctx").agg(F.min(F.struct(-F.col("count"), "kind")).alias("m")).select("ctx", F.col("m.kind").alias("of"))
    trusted = B.stage_table(patterns.where((F.col("seeds") >= support) & (F.col("trust") >= belief)).join(kinds, "ctx").select("ctx", "of", "trust", "seeds"))
    marked = edges.where(F.col("kind").isin(OPEN, SECRET)).join(trusted, "ctx")
    best = F.max(F.struct("trust", "seeds", -F.col("of")))
    return marked.groupBy("row", "b", "e").agg(F.when(F.max("kind") == SECRET, SECRET).otherwise(-best.getField("col3")).cast("int").alias("k"))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["b"], x["e"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:begin:end, ...), spans, found (array of b, k, e) of every row.

    Counts are of base spans. Ends are exclusive; positions are code points. Null
    and empty texts have no spans; very long texts are read whole. Equal begins are
    ordered by kind; found kinds may be "secret" too. Repeated rows each get a row. `keep` names columns to carry along; others are not read.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = B.stage_table(mentions(own).withColumn("row", F.monotonically_increasing_id()))
    more = believed(rows).groupBy("row").agg(F.collect_list(F.struct("b", "k", "e")).alias("more"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<b int, k int, e int>>)")))))
    out = rows.join(more, "row", "left")
    of_kind = lambda k: lambda x: x["k"] == k
    count = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])]
    return out.select("doc_id", *count, _written(F.col("base")).alias("base"), _written(every).alias("spans"), every.alias("found"))
