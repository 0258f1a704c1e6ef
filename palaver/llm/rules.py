r"""Quality rules as weak supervision: rules vote or abstain, and a posterior replaces "all must pass".

Method: each rule says good, bad or nothing about a text. How often each rule is
right is not known; expectation-maximisation estimates it, with the share of good
texts, from how the votes of all texts agree. A text is kept if its posterior
probability of being good is at least one half. EM needs only how many texts show
each pattern of votes: at most 3**8 rows, whatever the corpus.

Everything on texts is DataFrame expressions. Words are runs of characters other
than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
RULES = ("length", "word_size", "symbols", "dup_lines", "repeats", "capitals", "shouts", "bars")


def text_counts(docs: DataFrame, spare: int = 0) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' other counts to rows with a text.

    Repeated 3-word windows are found by sorting (hash of window, position) as one
    number each; equal neighbours are then compared word by word. In a text in which
    two different windows share what is kept of their hashes, windows are sorted by
    their words instead. spare: so many bits of hashes less are kept (for tests).
    """
    d = docs.withColumn("w", F.filter(F.split("text", SPACES), lambda x: x != ""))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_upper", F.regexp_count("text", F.lit("[A-Z]")).cast("long")).withColumn("n_bang", (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long"))
    d = d.withColumn("n_bar", (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("long"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    d = d.withColumn("s", F.length(F.bin(F.size("w"))) + F.lit(spare))
    d = d.withColumn("k", F.expr("sort_array(transform(slice(w, 1, greatest(n_words - 2, 0)), (x, i) -> shiftleft(shiftright(xxhash64(x, get(w, i + 1), get(w, i + 2)), s), s) + i))"))
    d = d.withColumn("k", F.expr("filter(k, (x, i) -> shiftright(x, s) = shiftright(get(k, i - 1), s) or shiftright(x, s) = shiftright(get(k, i + 1), s))"))
    d = d.withColumn("p", F.expr("transform(k, x -> cast(x - shiftleft(shiftright(x, s), s) as int))"))
    same = "coalesce(shiftright(x, s) = shiftright(get(k, i + {0}), s) and get(w, get(p, i)) = get(w, get(p, i + {0})) and get(w, get(p, i) + 1) = get(w, get(p, i + {0}) + 1) and get(w, get(p, i) + 2) = get(w, get(p, i + {0}) + 2), false)"
    d = d.withColumn("r", F.expr(f"transform(filter(transform(k, (x, i) -> if({same.format(-1)} or {same.format(1)}, get(p, i), -1)), x -> x >= 0), x -> x)"))
    clash = f"exists(transform(k, (x, i) -> coalesce(shiftright(x, s) = shiftright(get(k, i - 1), s), false) and not {same.format(-1)}), v -> v)"
    by_words = "sort_array(transform(slice(w, 1, greatest(n_words - 2, 0)), (x, i) -> struct(x as a, get(w, i + 1) as b, get(w, i + 2) as c, i as i)))"
    equal = "coalesce(x.a = get(q, i + {0}).a and x.b = get(q, i + {0}).b and x.c = get(q, i + {0}).c, false)"
    d = d.withColumn("r", F.expr(f"if({clash}, get(transform(array({by_words}), q -> transform(filter(q, (x, i) -> {equal.format(-1)} or {equal.format(1)}), x -> x.i)), 0), r)"))
    d = d.withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(r, x -> array(x, x + 1, x + 2))))) as long)"))
    return d.drop("w", "k", "p", "r", "s", "text")


def votes() -> list[Column]:
    """1 for good, -1 for bad, 0 for nothing, per rule; a text without words gets bad from length only."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    say = lambda bad, good: F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)
    c = F.col
    return [
        F.when(c("n_words") < 60, -1).when((c("n_words") >= 120) & (c("n_words") <= 50_000), 1).otherwise(0),
        say((c("word_chars") > 9 * n) | (10 * c("word_chars") < 25 * n), (c("word_chars") <= 7 * n) & (2 * c("word_chars") >= 7 * n)),
        say(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        say(10 * c("n_dup_lines") > 3 * c("n_lines"), c("n_dup_lines") == 0),
        say(10 * c("n_repeat_words") > 3 * n, 10 * c("n_repeat_words") <= n),
        say(10 * c("n_upper") > 4 * c("word_chars"), 100 * c("n_upper") <= 15 * c("word_chars")),
        say(10 * c("n_bang") > 2 * n, 100 * c("n_bang") <= n),
        say(10 * c("n_bar") > 2 * n, F.lit(False)),
    ]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """The share of good texts, and per rule the log odds that each of its votes speaks for good.

    Starts from the majority of votes. Each rule's chances of each vote, given
    good and given bad, are re-estimated until they settle; small counts are
    added that hold a rule to being right rather than wrong where votes say little.
    """
    total = sum(patterns.values())
    rules = len(next(iter(patterns), ()))
    good = {v: 0.95 if sum(v) > 0 and min(v, default=0) >= 0 else 0.5 + 0.45 * math.tanh(sum(v) / 2 - 1.5 * v.count(-1)) for v in patterns}
    prior, odds = 0.5, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(rules)]
    for _ in range(rounds if total else 0):
        n1 = sum(good[v] * c for v, c in patterns.items())
        share = (n1 + 8) / (total + 10)
        for j in range(rules):
            mass = {(y, x): e for y in (0, 1) for x, e in ((-1, 4.0 if not y else 0.5), (0, 2.0), (1, 4.0 if y else 0.5))}
            for v, c in patterns.items():
                mass[1, v[j]] += good[v] * c
                mass[0, v[j]] += (1 - good[v]) * c
            sums = {y: sum(mass[y, x] for x in (-1, 0, 1)) for y in (0, 1)}
            odds[j] = {x: math.log(mass[1, x] / sums[1]) - math.log(mass[0, x] / sums[0]) for x in (-1, 0, 1)}
        new = {v: 1 / (1 + math.exp(-max(-50.0, min(50.0, math.log(share / (1 - share)) + sum(odds[j][x] for j, x in enumerate(v)))))) for v in patterns}
        moved = max(abs(new[v] - good[v]) for v in patterns)
        good, prior = new, share
        if moved < 1e-6:
            break
    return prior, odds


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and posterior of every row.

    Null and empty texts have no words and fail. Very long texts are counted whole. Repeated rows count as often as
    they stand. An empty table gives no rows. Extra columns are not read.
    """
    counted = text_counts(B.documents(docs, id_col, text_col)).withColumn("votes", F.array(*votes()))
    counted = B.stage_table(counted)
    seen = {tuple(r["votes"]): r["count"] for r in counted.groupBy("votes").count().collect()}
    prior, odds = estimate(seen)
    evidence = F.lit(math.log(prior / (1 - prior)))
    for j, by in enumerate(odds):
        vote = F.get("votes", F.lit(j))
        evidence = evidence + F.when(vote == 1, by[1]).when(vote == -1, by[-1]).otherwise(by[0])
    out = counted.withColumn("posterior", 1 / (1 + F.exp(-evidence)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
