"""Answers to claims: checks against facts on the same subject, myths, appeals, unrelated parallels, and the lines that say it.

Packs are small tables that a Book holds as rows (see sources/packs.py), so topics,
myths and appeals become conditions on columns and no text is joined with a table
of patterns. Facts are joined by keys, broadcast while their number is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packs import Book, first_of
from . import extract
from .extract import any_of, let

#: Facts that are broadcast; more are joined by a shuffle.
NEAR_FACTS = 5_000
# Percentage points up to which two figures are the same, and up to which they are close.
FAIR, CLOSE = 3.0, 10.0
# How near a fact must be to rank before others, by kind of claim.
TOLERANCE = {"exact": 6.0, "vague": 12.0, "multiple": 5.0}
SENTENCE = r"[^.!?\n]+[.!?]*"

# Words that turn a statement round.
NEGATIONS = "not no never none without lack lacks lacking cannot cant can't dont don't doesnt doesn't didnt didn't wont won't havent haven't hasnt hasn't isnt isn't arent aren't".split()
# Populations that facts are about, and some that they are not.
AMERICAN = ["american", "americans", "america", "us", "usa"]
WORLD = "world global globally worldwide earth planet humanity mankind".split()
ELSEWHERE = "brit brits british uk britain england english+people scot scots scottish welsh irish ireland canad* australi* new+zealand* kiwis europe* eu french france german germans germany spain spanish itali* dutch swed* norw* danes danish finn* japan* chin* indian indians india mexic* brazil* russian russians russia africa* asia* londoner londoners parisian parisians".split()
# Appeals without a number, in order, and the question that each gets.
APPEALS = [
    ("proof", r"\b(?:it'?s|it is|it has been|that'?s|this is) (?:been )?(?:scientifically |clinically )?proven\b|\b(?:known|proven|scientific) fact\b|\bthe science is settled\b", "Proven how?"),
    ("authority", r"\b(?:stud(?:y|ies)|research|science|scientists|experts|doctors|economists|statistics) (?:have |has )?(?:shows?|showed|shown|says?|said|prove[sdn]?|proven|found|finds|agrees?|suggests?|confirms?)\b", "Which study?"),
    ("popularity", r"\bevery(?:one|body) knows\b|\bcommon (?:knowledge|sense)\b|\bno one (?:disputes|disagrees)\b", "Everyone who?"),
    ("count", r"\b(?:hundreds|thousands|millions|billions) of (?:people|americans|users|kids|children|lives|deaths|cases|women|men|families|dollars)\b", "Out of how many?"),
]


def _words(words) -> str:
    """Any of the words as a whole; + is white space, a final * any ending."""
    return r"\b(?:" + "|".join(w.replace("+", r"\s+").replace("*", r"\w*") for w in words) + r")\b"


def negated(text: Column) -> Column:
    return text.rlike(rf"(?iU){_words(NEGATIONS)}|n['’]t\b")


def population(about: Column) -> Column:
    """elsewhere, american, world or any, decided in this order."""
    return F.when(about.rlike(rf"(?iU){_words(ELSEWHERE)}"), "elsewhere").when(about.rlike(rf"(?iU){_words(AMERICAN)}|\bU\.S\."), "american").when(about.rlike(rf"(?iU){_words(WORLD)}"), "world").otherwise("any")


def general(x: Column) -> Column:
    """A number to six significant digits without trailing zeros."""

    def show(v):
        scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(v), F.lit(1e-6)))))
        return F.regexp_replace((F.rint(v * scale) / scale).cast("decimal(30,9)").cast("string"), r"\.?0+$", "")

    return F.when(x == 0, "0").otherwise(let(x, show))


def topic_of(context: Column, book: Book) -> Column:
    """The number of the first topic all of whose patterns are in the lower-cased context."""
    conditions = []
    for t in book.topics:
        one = F.lit(True)
        for p in t["patterns"]:
            one = one & F.lower(context).rlike(p)
        conditions.append(one)
    return first_of(conditions)


def near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= NEAR_FACTS else df


def topic_facts(spark, book: Book) -> DataFrame:
    """topic, negated, population and the fact that checks such a claim: the first on the topic that is framed the same way and of the population."""
    f = book.fact_table(spark).where("kind = 'percent'").select("id", "value", "statement", "source", "year", "american", negated(F.col("statement")).alias("negated"))
    listed = [(i, j, x) for i, t in enumerate(book.topics) for j, x in enumerate(t["facts"])]
    t = spark.createDataFrame(listed, "topic int, place int, id string").join(near(f, len(book.facts)), "id")
    p = spark.createDataFrame([(x,) for x in ("american", "world", "any")], "population string")
    # of any population, one that isn't of the country comes first
    fits = t.join(F.broadcast(p), (F.col("population") == "any") | (F.col("american") == (F.col("population") == "american")))
    first = fits.withColumn("r", F.row_number().over(Window.partitionBy("topic", "negated", "population").orderBy(F.when(F.col("population") == "any", F.col("american")).otherwise(False), "place")))
    return first.where("r = 1").select("topic", "negated", "population", F.col("id").alias("fact_id"), F.col("value").alias("real"), "statement", "source", "year")


def check(claims: DataFrame, book: Book) -> DataFrame:
    """The claims with fact_id, real, delta, verdict and line; null where no fact measures the same thing for the same people.

    Only percentages are checked. The first topic decides: where its facts don't
    fit, no looser one is tried. Exact shares are fair up to FAIR points, close up to
    CLOSE, else off; shares in words are fair where their band holds the real figure.
    """
    about = F.when(F.col("context") == "", F.col("subject")).otherwise(F.col("context"))
    c = claims.withColumn("topic", F.when(F.col("kind") == "percent", topic_of(about, book))).withColumn("negated", negated(about)).withColumn("population", population(about))
    facts = near(topic_facts(claims.sparkSession, book), 6 * len(book.topics))
    c = c.join(facts, ["topic", "negated", "population"], "left")
    delta = F.round(F.col("value") - F.col("real"), 1)
    gap = F.abs(delta)
    vague = F.col("lo").isNotNull()
    c = c.withColumn("delta", delta)
    verdict = F.when(vague, F.when(F.col("real").between(F.col("lo"), F.col("hi")), "fair").otherwise("off")).when(gap <= FAIR, "fair").when(gap <= CLOSE, "close").otherwise("off")
    c = c.withColumn("verdict", F.when(F.col("fact_id").isNotNull(), verdict))
    way = F.when(F.col("delta") > 0, "high").otherwise("low")
    word = F.regexp_replace("core", r"(?iU)\s+(?:of|the)$", "")
    word = F.concat(F.lower(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))
    judged = F.when(F.col("verdict") == "fair", "holds up").when(F.col("real") > F.col("hi"), "is too low").otherwise("is too high")
    said = F.concat(F.col("statement"), F.lit(". You said "), general(F.col("value")), F.lit("%"))
    points = F.concat(F.lit(": "), general(gap), F.when(gap == 1, " point ").otherwise(" points "), way, F.lit("."))
    line = F.when(vague, F.concat("statement", F.lit(", so “"), word, F.lit("” "), judged, F.lit("."))).when(F.col("verdict") == "fair", F.concat(said, F.lit(", which is fair."))).otherwise(F.concat(said, points))
    title = F.when(vague, F.when(F.col("verdict") == "fair", "Fair enough.").otherwise("Not really.")).when(F.col("verdict") == "fair", "That checks out.").when(F.col("verdict") == "close", F.concat(F.lit("Close, but "), way, F.lit("."))).otherwise("Not quite.")
    out = c.withColumn("line", F.when(F.col("verdict").isNotNull(), line)).withColumn("title", F.when(F.col("verdict").isNotNull(), title))
    return out.drop("topic", "negated", "population", "statement")


def multiple(kind: Column, value: Column) -> Column:
    """A change as the factor it implies, above 1: 20% less is 1.25 times in the other direction."""
    factor = F.greatest(1 + value / 100, F.lit(0.01))
    return F.when(kind == "change", F.greatest(factor, 1 / factor)).otherwise(value)


def parallels(claims: DataFrame, book: Book, k: int = 2, recent: Column | None = None) -> DataFrame:
    """The k facts nearest in size to each claim, with rank and gap; shares meet shares, multiples and changes meet multiples.

    Facts beyond the tolerance rank last but count. A claim's own check (fact_id) is
    then left out. Each distinct size is matched once, however many claims have it.
    recent: an array column of claims with facts that rank behind others.
    """
    own = claims.withColumn("size", multiple(F.col("kind"), F.col("value"))).withColumn("class", F.when(F.col("kind") == "percent", "percent").otherwise("ratio"))
    tol = F.when(F.col("class") == "ratio", TOLERANCE["multiple"]).when(F.col("quantifier") == "vague", TOLERANCE["vague"]).otherwise(TOLERANCE["exact"])
    own = own.withColumn("tolerance", tol).withColumn("recent", F.array().cast("array<string>") if recent is None else F.array_sort(recent))
    key = ["class", "size", "tolerance", "recent"]
    f = book.fact_table(claims.sparkSession).select(F.col("kind").alias("class"), F.col("id").alias("other_id"), F.col("value").alias("other"), "ord", "short", F.col("statement").alias("fact"), "proper", "source", "year")
    d = own.select(*key).distinct().join(near(f, len(book.facts)), "class")
    gap = F.when(F.col("class") == "percent", F.abs(F.col("size") - F.col("other"))).otherwise(10 * F.abs(F.ln("size") - F.ln("other")))
    order = Window.partitionBy(*key).orderBy(F.col("gap") > F.col("tolerance"), F.array_contains("recent", F.col("other_id")), "gap", "ord")
    best = d.withColumn("gap", gap).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    same = [own[c].eqNullSafe(best[c]) for c in key]
    met = own.join(best, same[0] & same[1] & same[2] & same[3]).drop(*(best[c] for c in key))
    if "fact_id" in claims.columns:
        met = met.where(F.col("fact_id").isNull() | (F.col("fact_id") != F.col("other_id")))
    return met.drop("size", "class", "tolerance", "recent", "ord")


def mythic_spans(text: Column, book: Book) -> Column:
    """start, end and myth (its number) of each sentence all of a myth's patterns are in; the first myth of a sentence counts."""

    def hit(s):
        conditions = []
        for m in book.myths:
            one = F.lit(True)
            for p in m["patterns"]:
                one = one & s.rlike(f"(?i){p}")
            conditions.append(one)
        return first_of(conditions)

    # one pattern of each myth stands for all; few sentences have any
    maybe = "(?i)" + "|".join(f"(?:{m['patterns'][0]})" for m in book.myths)
    tiles = F.regexp_extract_all(text, F.lit(rf"{SENTENCE}|[.!?\n]"), F.lit(0))

    def found(parts):
        marked = F.transform(parts, lambda s, i: F.struct(i.alias("i"), F.when(s.rlike(maybe), hit(s)).alias("myth")))
        at = lambda x: F.length(F.array_join(F.slice(parts, F.lit(1), x["i"]), ""))
        span = lambda x: F.struct(at(x).cast("long").alias("start"), (at(x) + F.length(F.get(parts, x["i"]))).cast("long").alias("end"), x["myth"].alias("myth"), F.trim(F.get(parts, x["i"])).alias("said"))
        return F.transform(F.filter(marked, lambda x: x["myth"].isNotNull()), span)

    return let(tiles, found) if book.myths else F.expr("cast(array() as array<struct<start:bigint,end:bigint,myth:int,said:string>>)")


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence around an offset (code points before it), 160 characters at most."""
    both = F.concat(F.regexp_extract(F.left(text, at), r"([^.!?\n]*)\z", 1), F.regexp_extract(F.substr(text, at + 1), r"^[^.!?\n]*", 0))
    return F.left(F.trim(F.regexp_replace(both, r"(?U)\s+", " ")), F.lit(160))


def appeals(text: Column) -> Column:
    """kind, no, start and said of each kind of appeal that a text makes: its first place, and one kind for a sentence."""
    found = []
    for no, (kind, pattern, _) in enumerate(APPEALS):
        at = F.regexp_instr(text, F.lit(f"(?iU){pattern.replace(' ', '[ ]+')}")) - 1
        found.append(F.struct(F.lit(kind).alias("kind"), F.lit(no).alias("no"), at.cast("long").alias("start"), sentence_at(text, at.cast("int")).alias("said")))
    hits = F.filter(F.array(*found), lambda x: x["start"] >= 0)
    return let(hits, lambda h: F.filter(h, lambda x: ~F.exists(h, lambda y: (y["no"] < x["no"]) & (y["said"] == x["said"]))))


def pick(lists: list[str], *of: Column) -> Column:
    """One of the lines, always the same for the same columns."""
    if not lists:
        return F.lit(None).cast("string")
    at = F.pmod(F.conv(F.left(F.md5(F.concat_ws("|", *of)), F.lit(8)), 16, 10).cast("long"), F.lit(len(lists)))
    return F.get(F.array(*map(F.lit, lists)), at.cast("int"))


def fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def fallacy(book: Book, key: Column) -> Column:
    """The remark on a claim's kind of figure."""
    v = book.voice
    line = F.when(F.col("kind") == "ratio", pick(v["fallacy_ratio"], key)).when(F.col("kind") == "change", pick(v["fallacy_change"], key)).when(F.col("quantifier") == "vague", pick(v["fallacy_vague"], key)).otherwise(pick(v["fallacy_percent"], key))
    return fill(line, v=general(F.abs("value")), direction=F.when(F.col("value") < 0, "fall").otherwise("rise"))


def render(met: DataFrame, book: Book) -> DataFrame:
    """Rows of parallels() with line_1, line_2 (two templates of the voice, chosen by the claim and the fact), source_line and note.

    Lines that call two figures the same are only taken where they are within FAIR points.
    """
    first = F.regexp_extract("fact", r"^\S+", 0)
    keep = F.col("proper") | ((F.length(first) > 1) & (F.upper(first) == first) & (F.lower(first) != first))
    lower = F.when(keep, F.col("fact")).otherwise(F.concat(F.lower(F.left("fact", F.lit(1))), F.substr("fact", F.lit(2))))
    gap = F.round("gap", 1)
    values = {
        "fact_lc": lower, "fact_v": general(F.col("other")), "fact": F.col("fact"), "short": F.col("short"),
        "subject_or_that": F.when(F.col("subject") == "", "that").otherwise(F.concat(F.lit("'"), F.col("subject"), F.lit("'"))), "subject": F.when(F.col("subject") == "", "your claim").otherwise(F.col("subject")),
        "gap": F.concat(general(gap), F.when(gap == 1, " point").otherwise(" points")), "claim_v": general(F.col("value")),
    }
    key = extract.claim_key(F.col("kind"), F.col("value"), F.col("subject"))
    v = book.voice
    pools = [(F.col("kind") != "percent", v["ratio"]), (F.col("gap") <= FAIR, [*v["percent"], *v["percent_close"]]), (F.lit(True), v["percent"])]

    def line(no: int) -> Column:
        out = F.lit(None).cast("string")
        for condition, pool in reversed(pools):
            whole = F.array(*map(F.lit, pool))
            number = lambda salt, n: F.pmod(F.conv(F.left(F.md5(F.concat_ws("|", key, F.col("other_id"), F.lit(salt))), F.lit(8)), 16, 10).cast("long"), F.lit(max(1, n)))
            at = number("1", len(pool))
            if no == 2:
                at = F.pmod(at + 1 + number("2", len(pool) - 1), F.lit(max(1, len(pool))))
            text = F.get(whole, at.cast("int")) if len(pool) >= no else F.lit(None).cast("string")
            out = F.when(condition, text).otherwise(out)
        return fill(out, **values)

    source = F.concat(F.lit("Source: "), F.col("source"), F.lit(", "), F.col("year").cast("string"), F.lit("."))
    return met.withColumn("line_1", line(1)).withColumn("line_2", line(2)).withColumn("source_line", source).withColumn("note", fallacy(book, key))


#: Columns of an answer: part is myth, check, appeal or parallel; no counts from 0 within a part of a text.
ANSWER = ["part", "no", "key", "said", "start", "kind", "value", "fact_id", "real", "gap", "verdict", "line"]


def checked_claims(m: DataFrame, book: Book, keep: list[str]) -> DataFrame:
    """The claims of each text but those in a sentence with a myth, with their key and check()."""
    texts = m.select(*keep, "text").withColumn("myths", mythic_spans(F.col("text"), book))
    c = extract.extract_claims(texts, keep=[*keep, "myths"])
    c = c.where(~F.exists("myths", lambda s: (F.col("start") >= s["start"]) & (F.col("start") < s["end"]))).drop("myths")
    return check(c, book).withColumn("key", extract.claim_key(F.col("kind"), F.col("value"), F.col("subject")))


def analyse(m: DataFrame, book: Book, per_claim: int = 2, keep: list[str] | None = None, session: list[str] | None = None) -> DataFrame:
    """The answers to each text: myths, checks of its claims, appeals, then parallels.

    A claim or an appeal in a sentence that holds a myth gets no other answer. A
    claim's own check is never its parallel. session: columns of keep; of answers and
    claims with one key only the first of a session stays (by the columns of keep,
    then place), as in a conversation that goes on.
    """
    keep = ["msg_id"] if keep is None else keep
    nothing = lambda kind: F.lit(None).cast(kind)
    texts = m.select(*keep, "text").where("text is not null")

    def once(rows: DataFrame, *place: str) -> DataFrame:
        if session is None:
            return rows
        w = Window.partitionBy(*session, "key").orderBy(*(c for c in keep if c not in session), *place)
        return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

    said = texts.withColumn("myths", mythic_spans(F.col("text"), book)).withColumn("appeals", appeals(F.col("text")))
    said = said.where((F.size("myths") > 0) | (F.size("appeals") > 0))
    names = F.array(*(F.lit(x["id"]) for x in book.myths)) if book.myths else F.array(F.lit(""))
    truths = F.array(*(F.lit(x["truth"] + ".") for x in book.myths)) if book.myths else F.array(F.lit(""))
    myths = said.select(*keep, F.posexplode("myths").alias("no", "x"))
    myths = myths.select(*keep, F.lit("myth").alias("part"), "no", F.concat(F.lit("myth:"), F.get(names, F.col("x.myth"))).alias("key"), F.col("x.said").alias("said"), F.col("x.start").alias("start"), nothing("string").alias("kind"), nothing("double").alias("value"), F.get(names, F.col("x.myth")).alias("fact_id"), nothing("double").alias("real"), nothing("double").alias("gap"), F.lit("myth").alias("verdict"), F.get(truths, F.col("x.myth")).alias("line"))
    inside = lambda x: F.exists("myths", lambda s: (x["start"] >= s["start"]) & (x["start"] < s["end"]))
    asks = said.select(*keep, F.explode(F.filter("appeals", lambda x: ~inside(x))).alias("x"))
    asks = asks.withColumn("key", F.concat(F.lit("appeal:"), F.col("x.kind")))
    line = F.lit(None).cast("string")
    for kind, *_ in APPEALS:
        line = F.when(F.col("x.kind") == kind, pick(book.voice[f"appeal_{kind}"], F.col("key"))).otherwise(line)
    asks = asks.select(*keep, F.lit("appeal").alias("part"), F.col("x.no").alias("no"), "key", F.col("x.said").alias("said"), F.col("x.start").alias("start"), F.col("x.kind").alias("kind"), nothing("double").alias("value"), nothing("string").alias("fact_id"), nothing("double").alias("real"), nothing("double").alias("gap"), F.lit("ask").alias("verdict"), line.alias("line"))

    claims = once(checked_claims(m, book, keep), "start")
    no = F.row_number().over(Window.partitionBy(*keep).orderBy("start", *(["rank"]))) - 1
    met = render(parallels(claims.withColumnRenamed("line", "check_line").withColumnRenamed("source", "check_source").withColumnRenamed("year", "check_year"), book, per_claim), book)
    met = met.select(*keep, F.lit("parallel").alias("part"), no.alias("no"), "key", F.col("said"), "start", "kind", "value", F.col("other_id").alias("fact_id"), F.col("other").alias("real"), F.round("gap", 2).alias("gap"), nothing("string").alias("verdict"), F.col("line_1").alias("line"))
    checks = claims.where("verdict is not null")
    checks = checks.select(*keep, F.lit("check").alias("part"), (F.row_number().over(Window.partitionBy(*keep).orderBy("start")) - 1).alias("no"), "key", "said", "start", "kind", "value", "fact_id", "real", F.abs("delta").alias("gap"), "verdict", "line")
    columns = [*keep, *ANSWER]
    return once(myths, "start").select(*columns).unionByName(checks.select(*columns)).unionByName(once(asks, "start").select(*columns)).unionByName(met.select(*columns))
