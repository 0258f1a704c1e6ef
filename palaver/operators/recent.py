"""Parallels that don't repeat themselves: of each contact the last facts that were used rank behind others.

A claim's choice depends on those before it, so claims go through in order with a
short state for each contact. What a claim can choose from is found beforehand as
a column: K + MEMORY facts in order of nearness are enough, as no more than MEMORY
of them can be held back. A batch streams sorted rows through Python, so its
memory doesn't grow with a contact; a stream keeps the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.packs import Book
from . import verdicts as V

# Fixed value: facts that are remembered.
MEMORY = 12
KEYS = ["contact", "ts", "msg_id", "start"]
OUT = "contact string, ts timestamp_ntz, msg_id long, start long, value double, rank long, fact_id string"


def candidates(book: Book, k: int) -> Column:
    """far and id of the k + MEMORY facts nearest to a claim, the near ones first."""
    facts = [F.struct(F.lit(f["id"]).alias("id"), F.lit("percent" if f["kind"] == "percent" else "ratio").alias("class"), F.lit(float(f["value"])).alias("value"), F.lit(f["ord"]).alias("ord")) for f in book.facts]
    size, percent = V.multiple(F.col("kind"), F.col("value")), F.col("kind") == "percent"
    tol = F.when(~percent, V.TOLERANCE["multiple"]).when(F.col("quantifier") == "vague", V.TOLERANCE["vague"]).otherwise(V.TOLERANCE["exact"])

    def place(f: Column) -> Column:
        gap = F.when(percent, F.abs(size - f["value"])).otherwise(10 * F.abs(F.ln(size) - F.ln(f["value"])))
        return F.struct((gap > tol).alias("far"), gap.alias("gap"), f["ord"].alias("ord"), f["id"].alias("id"))

    own = F.filter(F.array(*facts), lambda f: (f["class"] == "percent") == percent)
    best = F.slice(F.array_sort(F.transform(own, place)), 1, k + MEMORY)
    return F.transform(best, lambda x: F.struct(x["far"].alias("far"), x["id"].alias("id")))


def choose(found: list, recent: list[str], k: int, check: str | None) -> list[str]:
    """The k that a claim gets, those used lately behind others; its own check then goes."""
    ranked = sorted(range(len(found)), key=lambda i: (bool(found[i]["far"]), found[i]["id"] in recent, i))
    return [found[i]["id"] for i in ranked[:k] if found[i]["id"] != check]


def _through(rows: pd.DataFrame, recent: list[str], k: int, out: list[tuple]) -> list[str]:
    """Adds a row for each choice; the facts remembered afterwards."""
    for r in rows.itertuples(index=False):
        for rank, fact in enumerate(choose(list(r.found), recent, k, r.fact_id), 1):
            out.append((r.contact, r.ts, r.msg_id, r.start, r.value, rank, fact))
            recent = [*recent, fact][-MEMORY:]
    return recent


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def prepared(checked: DataFrame, book: Book, k: int) -> DataFrame:
    """Checked claims (see verdicts.checked_claims with contact, ts, msg_id) with what they can choose from."""
    return checked.select(*KEYS, "value", "fact_id", candidates(book, k).alias("found"))


def without_repeats(checked: DataFrame, book: Book, k: int = 2) -> DataFrame:
    """A row for each choice of each claim, in a contact's order of time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contact, recent = None, []
        for frame in frames:
            out: list[tuple] = []
            # a contact's rows stand together, maybe over several frames
            for name, rows in frame.groupby("contact", sort=False, dropna=False):
                if name != contact:
                    contact, recent = name, []
                recent = _through(rows, recent, k, out)
            yield _frame(out)

    ready = prepared(checked, book, k)
    return ready.repartition("contact").sortWithinPartitions(*KEYS).mapInPandas(run, OUT)


def stream_without_repeats(checked: DataFrame, book: Book, k: int = 2) -> DataFrame:
    """The same of a stream: each batch goes on from what a contact's last one left."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(KEYS)
        out: list[tuple] = []
        recent = _through(rows, recent, k, out)
        state.update((recent,))
        yield _frame(out)

    ready = prepared(checked, book, k)
    return ready.groupBy("contact").applyInPandasWithState(run, OUT, "recent array<string>", "append", GroupStateTimeout.NoTimeout)
