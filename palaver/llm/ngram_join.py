"""N-gram Jaccard join: all texts whose sets of word shingles are similar, and the classes they form.

Method: vertical partitioning. The shingles have one global order, rarest
first. That order is cut into fragments, at fixed numbers of texts in which a
shingle occurs; each fragment counts a pair's overlap within itself, and the
partial overlaps are summed per pair and give the exact similarity. What comes
before the first cut stands in one text alone and can't overlap.

Two texts with Jaccard similarity >= t share a shingle among the first
n - ceil(t n) + 1 of each in any global order (prefix filter). Under rarest
first a text whose unshared shingles fill that prefix has no partner at all:
most of a corpus leaves here, before any pair exists. What is left is collapsed
to one representative for each distinct set.

Families of thousands of near copies must not become all their pairs. While much
is open, each class tests a few centres at a turn (classes that lead the list of
a shared prefix shingle). Links found join components, and in the end all pairs
of classes in different components that still share a prefix shingle are tested:
a pair within a component can't change the components. So none is lost, and no
cap applies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .graph import components
from .textcore import U64, Words, mix, window_starts, windows

#: Numbers of texts at which the global order, rarest first, is cut into fragments; shingles of fewer texts than the first have no overlap.
CUTS = (2, 3, 5, 17)
#: Pieces of a component in joins by its label.
SALTS = 16
#: Bits of a set's parity.
PARITY = 1024
#: Turns of testing centres, at most; what they leave open is tested pair by pair.
MOST_TURNS = 2
#: Open pairs that are tested at once without turns of centres.
DIRECT = 50_000


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin; texts of 1 to k-1 words are one shingle."""
    words = Words(buf, offsets)
    hashes, n = words.hashes(lower=True), np.diff(words.ptr)
    all_windows, starts = windows(hashes, k), window_starts(words.ptr, k)
    grams, owner = all_windows[starts] if len(starts) else all_windows[:0], np.searchsorted(words.ptr, starts, side="right") - 1
    edge = np.searchsorted(owner, np.arange(len(n) + 1))
    out = []
    for i in range(len(n)):
        if n[i] >= k:
            out.append(np.unique(grams[edge[i] : edge[i + 1]]))
        elif n[i]:
            out.append(mix(windows(hashes[words.ptr[i] : words.ptr[i + 1]], int(n[i])) + U64(n[i])))
        else:
            out.append(grams[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else grams[:0]), np.concatenate(([0], np.cumsum(sizes)))


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def fragments(grams: np.ndarray, counts: np.ndarray, at: np.ndarray) -> pa.Array:
    """The shared shingles of each text's set, as a list for each fragment of the global order."""
    n, width = len(at) - 1, len(CUTS)
    fragment = np.searchsorted(np.array(CUTS, U64), counts, side="right") - 1
    cell = np.repeat(np.arange(n), np.diff(at)) * width + fragment
    shared = fragment >= 0
    order = np.argsort(cell[shared], kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(cell[shared], minlength=n * width))))
    lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(grams[shared][order].view(np.int64)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), lists)


def shingle_profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per document: set size, a hash of the set (cls), and, where a partner is possible, its shared prefix and its fragments."""
    blocks = B.Blocks(docs)
    bits = B.sketch_bits(blocks.bytes // 6)
    replies = B.merged_counts(blocks, lambda ids, buf, offsets: shingle_sets(buf, offsets, k)[0], bits, cap=1 << 40)

    def profile(ids, buf, offsets, got):
        grams, at = shingle_sets(buf, offsets, k)
        counts = B.counts_for(grams, got, bits)
        n = np.diff(at)
        cls, unshared, prefix, parity = [], [], [], []
        live = np.zeros(len(n), bool)
        for i in range(len(n)):
            g, c = grams[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]
            cls.append(int(mix(np.array([np.bitwise_xor.reduce(mix(g + U64(n[i])))]) + np.sum(g, dtype=U64)).view(np.int64)[0]) if n[i] else None)
            alone, first = int((c < 2).sum()), int(n[i]) - _need(int(n[i]), percent) + 1
            unshared.append(alone)
            if n[i] and alone < first:
                prefix.append(g[np.lexsort((g, c))[alone:first]].view(np.int64))
                live[i] = True
                odd = (np.bincount((g & U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
                parity.append(np.packbits(odd).view(np.int64))
            else:
                prefix.append(None)
                parity.append(None)
        parts = fragments(grams, np.where(np.repeat(live, n), counts, U64(0)), at)
        return {"doc_id": ids, "n": pa.array(n), "cls": pa.array(cls, pa.int64()), "unshared": pa.array(unshared, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "parts": parts, "parity": pa.array(parity, pa.list_(pa.int64()))}

    return blocks.answer(replies, profile, "doc_id long, n long, cls long, unshared long, prefix array<long>, parts array<array<long>>, parity array<long>")


def overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, shared): exact set overlaps, summed over the fragments in which they are counted."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    parts = classes.select("cls", "parts").join(used, "cls", "left_semi").select("cls", F.posexplode("parts").alias("frag", "part")).where(F.size("part") > 0)
    left = pairs.select("a", "b").join(parts.select(F.col("cls").alias("a"), "frag", F.col("part").alias("x")), "a")
    both = left.join(parts.select(F.col("cls").alias("b"), "frag", F.col("part").alias("y")), ["b", "frag"])
    return both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("shared"))


def _linked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    size = classes.select("cls", "n")
    found = overlaps(pairs, classes).join(size.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    return found.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b", "shared")


def _fits(percent: int):
    """Whether a pair with a common shingle can be similar by sizes, and by what follows a first common one in the global order."""
    need = (percent * (F.col("na") + F.col("nb"))) / F.lit(100 + percent)
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)


def _parity_fits(percent: int):
    """A bit of parity tells whether a set has an odd number of shingles in a cell; sets that differ in d bits differ in d shingles at least."""
    need = (percent * (F.col("na") + F.col("nb"))) / F.lit(100 + percent)
    differ = sum((F.bit_count(F.get("xa", F.lit(i)).bitwiseXOR(F.get("xb", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return differ <= F.col("na") + F.col("nb") - 2 * need


def _with_label(rows: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """rows (cls, label) with a table of labels; a component is dealt over SALTS tasks, however large it is."""
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted, ["label", "salt"], how).drop("salt")


def _opened(tokens: DataFrame, joined: DataFrame | None) -> tuple[DataFrame, int]:
    """Prefix shingles that classes of different components share, and how many pairs across components these hold.

    Components only grow, so a shingle that one of them has to itself is never
    open again: a later turn's tokens are what was open before it.
    """
    tokens = tokens.select("tok", "cls", "n", "pos")
    labelled = tokens.withColumn("label", F.col("cls")) if joined is None else tokens.join(joined.select(F.col("v").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    if joined is not None:
        labelled = B.stage_table(labelled)
    mixed = labelled.groupBy("tok", "label").agg(F.count("*").alias("k")).groupBy("tok").agg(F.count("*").alias("labels"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("work")).where("labels > 1")
    mixed = B.stage_table(mixed)
    return B.stage_table(labelled.join(mixed.select("tok"), "tok", "left_semi")), int(mixed.agg(F.sum("work")).first()[0] or 0)


def _star_pairs(opened: DataFrame, tested: DataFrame | None, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each class some centres not tested yet, more at later turns: classes of another component that lead a shared shingle's list.

    Another class leads each shingle's list, and from the second turn on one of
    the list's largest component, so that a class meets many members before it
    is held unlike them.
    """
    h, ranked = F.xxhash64("cls", "tok", F.lit(turn)).alias("h"), opened
    if turn:
        larger = opened.select("label", "cls").distinct().groupBy("label").agg((-F.count("*")).alias("s")).where("s < -1")
        ranked = _with_label(opened, larger, "left").withColumn("s", F.coalesce("s", F.lit(-1)))
    order = F.struct("s", "label", h, "cls", "n", "pos") if turn else F.struct(h, "label", "cls", "n", "pos")
    heads = ranked.groupBy("tok").agg(F.min(order).alias("c")).select("tok", F.col("c.cls").alias("a"), F.col("c.label").alias("la"), F.col("c.n").alias("na"), F.col("c.pos").alias("pa"))
    pairs = opened.select("tok", F.col("cls").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(heads, "tok").where("la <> lb").where(_fits(percent)).groupBy("a", "b").agg(F.count("*").alias("w"))
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b").union(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    best = Window.partitionBy("b").orderBy(F.desc("w"), "a")
    few = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 3 * 6**turn).select("a", "b")
    for s in "ab":
        few = few.join(classes.select(F.col("cls").alias(s), F.col("n").alias("n" + s), F.col("parity").alias("x" + s)), s)
    return few.where(_parity_fits(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Shingles are distinct runs of k words of the text with A-Z in lower case;
    a text of fewer words is one shingle. Rows link when 100 * shared >=
    percent * union; component_id is the smallest id that links lead to, the
    row's own included. Texts that are null or without words link with nothing.
    Repeated rows each get a row. A row without id has no component_id unless
    it links with one that has an id. Other columns are not read.
    """
    own = B.documents(docs, id_col, text_col)
    with B.Staged() as wide:
        rows = B.stage_table(shingle_profiles(own, k, percent))
    summary = B.stage_table(rows.select("doc_id", "n", "cls"))
    first = B.stage_table(summary.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    live = rows.where("prefix is not null")
    classes = B.stage_table(live.groupBy("cls").agg(F.first("n").alias("n"), F.first("unshared").alias("unshared"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts"), F.first("parity").alias("parity")))
    wide.drop(own.sparkSession)  # only the summary and the classes are read from here on
    tokens = B.stage_table(classes.select("cls", "n", "unshared", F.posexplode("prefix").alias("i", "tok")).select("tok", "cls", "n", (F.col("unshared") + F.col("i")).alias("pos")))

    links = tested = None
    opened, work = _opened(tokens, None)
    enough = max(DIRECT, 8 * classes.count())
    for turn in range(MOST_TURNS):
        if work <= enough:
            break
        fresh = B.stage_table(_star_pairs(opened, tested, classes, turn, percent))
        new = B.stage_table(_linked(fresh, classes, percent).select("a", "b"))
        tested = fresh if tested is None else B.stage_table(tested.union(fresh))
        links = new if links is None else B.stage_table(links.union(new))
        joined = B.stage_table(components(links))
        opened, work = _opened(opened, joined)
    opened = B.stage_table(opened.join(classes.select("cls", "parity"), "cls"))
    side = lambda s: opened.select("tok", F.col("cls").alias(s), F.col("n").alias("n" + s), F.col("pos").alias("p" + s), F.col("label").alias("l" + s), F.col("parity").alias("x" + s))
    rest = side("a").join(side("b"), "tok").where("a < b and la <> lb").where(_fits(percent) & _parity_fits(percent)).select("a", "b").distinct()
    if tested is not None:
        rest = B.stage_table(rest).join(tested, ["a", "b"], "left_anti")
    more = _linked(B.stage_table(rest), classes, percent).select("a", "b")
    final = B.stage_table(components(more if links is None else links.union(more)))

    linked = B.stage_table(first.join(final.select(F.col("v").alias("cls"), "label"), "cls").select("cls", "label", "low"))
    named = _with_label(linked.select("cls", "label"), linked.groupBy("label").agg(F.min("low").alias("component_id"))).select("cls", "component_id")
    named = named.union(first.where("copies > 1").join(linked.select("cls"), "cls", "left_anti").select("cls", F.col("low").alias("component_id")))
    named = B.stage_table(named)  # short plans: the driver keeps each one, and Spark plans it anew after each of its stages
    return summary.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
