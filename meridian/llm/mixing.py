"""Mixing sources to target weights, by fitting the budget as a subset sum.

Sources in the order of their names weigh `weights` in turn and share a budget of
words, `share` of a hundred of all. A source's target stops at `most` times its
own size; what is above is shared anew by weight among the others, until none is
above. A source then takes all its documents as often as fits whole, and of its
documents some once more, whose sizes sum to what is left of the target:

1. documents are counted by source and exact size;
2. each size gives its even share of documents, rounded down; then single
   documents of sizes in a seeded order are taken back until the gap to the
   target is about `WINDOW` words (or all of a small source);
3. bounded-knapsack dynamic programming over the sizes, with as many copies as
   documents are left of each, finds the sum nearest to the gap (a set of
   reachable sums as the bits of one integer, copies in powers of two);
4. of each size the documents with the least seeded hashes are taken, as many as
   the counts say.

Whatever is dealt out stays bounded: one group of step 3 holds a source's distinct
sizes, at most sqrt(2 x words of the source) of them, for that many different sizes
sum to so much. Documents of one source and size are cut into cells of about CELL
by their hash and ranked there, so no group of equal sizes is one task's work,
and a hot source none either.

Defined cases: null, empty and blank texts have size 0 and are taken `whole` times
like their source; a null source is a source of its own, after all others, an
empty one comes first. Equal rows are each counted; which of rows that agree in
source, size, doc_id and text is taken makes no difference. A source of one
document, or of long documents only, ends up as near its target as whole
documents allow. Very long texts are counted whole. An empty table gives no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_batches, ranked

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 150, 2, 42
#: Words that the knapsack fits, at least; documents of one source and size that are ranked together, about.
WINDOW, CELL = 1 << 16, 256


def _source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts like it, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _source(key: Column) -> Column:
    return F.when(key != "~", F.substr(key, F.lit(2)))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, src, size, draw): source key and words of every row, and its seeded place in [0, 1), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t.split()) if t else 0 for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], ["doc_id", "text_key", "src", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), _source_key(F.col("source")).alias("src"), as_bytes())
    counted = map_batches(rows, run, "doc_id long, text_key long, src string, size long")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11) / F.lit(float(1 << 53))
    return cut(counted.withColumn("draw", place), "sizes")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """sources (src, source_size), one row each, with weight and target.

    The level of words a weight rises while sources are capped, so a capped one
    stays so. Each round takes one row of sums over the sources, which may be many.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    dealt = cut(ranked(sources, [F.col("src").asc()], sources.count()).withColumn("weight", turn).drop("rank"), "sources")
    all_ = dealt.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget = (all_.words or 0) * share / 100
    ceiling, rest, open_, capped = most * F.col("source_size"), budget, all_.weight or 0, 0
    while open_:
        above = F.col("weight") * F.lit(rest / open_) > ceiling
        got = dealt.agg(F.sum(F.when(above, ceiling)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if got.n == capped:
            return dealt.withColumn("target", F.when(above, ceiling.cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(open_))))
        rest, open_, capped = budget - (got.full or 0), got.open or 0, got.n
    return dealt.withColumn("target", ceiling.cast("double"))


def fit(size: np.ndarray, count: np.ndarray, gap: int, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """How many documents of each (distinct, positive) size to take, so that their sizes sum to about gap, at most count of each."""
    take = np.zeros(len(size), np.int64)
    total = sum(int(s) * int(c) for s, c in zip(size, count, strict=True))
    if gap <= 0 or not total:
        return take
    if gap >= total:
        return count.astype(np.int64)
    take[:] = [int(c) * gap // total for c in count]
    left = gap - sum(int(s) * int(t) for s, t in zip(size, take, strict=True))
    order = np.random.default_rng([seed, len(size)]).permutation(len(size))
    for k in order:  # an even share is rounded down, so single documents of some sizes are still due
        if size[k] <= left - window and take[k] < count[k]:
            take[k] += 1
            left -= int(size[k])
    for k in order:
        while left < window and take[k]:  # the knapsack gets some room
            back = min(int(take[k]), -(-(window - left) // int(size[k])))
            take[k] -= back
            left += back * int(size[k])
    free = count - take
    return take + knapsack(size, free, left, order)


def knapsack(size: np.ndarray, count: np.ndarray, goal: int, order: np.ndarray) -> np.ndarray:
    """Copies of each size, at most count, whose sum is nearest to goal (the lesser of two as near); sizes are tried in this order."""
    used = np.zeros(len(size), np.int64)
    # A sum beyond goal by a size or more is farther off without that document; one by goal or more than none at all.
    room = goal + min(goal, int(size[count > 0].max(initial=0)))
    mask, reach = (1 << room + 1) - 1, 1
    first = np.zeros(room + 1, np.int32)  # by which piece a sum was reached first
    pieces: list[tuple[int, int]] = []
    for k in order:
        copies, some = min(int(count[k]), room // int(size[k])), 1
        while copies:
            some = min(some, copies)
            new = (reach << some * int(size[k])) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(pieces)
                pieces.append((int(k), some))
                reach |= new
            copies, some = copies - some, some * 2
        if reach >> goal & 1:
            break
    below = (reach & ((1 << goal + 1) - 1)).bit_length() - 1
    above = reach >> goal
    over = (above & -above).bit_length() - 1 if above else goal + 1
    at = goal + over if over < goal - below else below
    while at:  # each sum's piece was added to a sum of earlier pieces
        k, some = pieces[first[at]]
        used[k] += some
        at -= some * int(size[k])
    return used


def plan(counted: DataFrame, goals: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(src, size, n, source_size, target, whole, once_more) for every source and size of counted (src, size, n)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        own, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(target // own) if own else 0
        some = size > 0
        more = np.zeros(len(rows), np.int64)
        more[some] = fit(size[some], n[some], round(target - whole * own), window, seed)
        return rows.assign(whole=np.int64(whole), once_more=more)

    joined = counted.join(goals.select("src", "source_size", "target"), "src")
    return joined.groupBy("src").applyInPandas(one, "src string, size long, n long, source_size long, target double, whole long, once_more long")


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, window: int = WINDOW, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies) for every row of docs: how often the mix takes it."""
    rows = sizes(docs, seed)
    counted = cut(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "counts")
    sources = counted.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    how = cut(plan(counted, targets(sources, weights, share, most), window, seed), "plan")
    met = rows.join(how, ["src", "size"]).withColumn("cell", F.floor(F.col("draw") * F.ceil(F.col("n") / cell)).cast("long"))
    cells = met.groupBy("src", "size", "cell").agg(F.count("*").alias("here"))
    before = cells.withColumn("before", F.sum("here").over(Window.partitionBy("src", "size").orderBy("cell")) - F.col("here")).drop("here")
    place = F.row_number().over(Window.partitionBy("src", "size", "cell").orderBy("draw", "doc_id", "text_key"))
    due = (F.col("before") + F.col("place") <= F.col("once_more")).cast("long")
    ranked_ = met.join(before, ["src", "size", "cell"]).withColumn("place", place)
    return ranked_.select("doc_id", "text_key", _source(F.col("src")).alias("source"), "size", "source_size", "target", (F.col("whole") + due).alias("copies"))


def mixture(docs: DataFrame, copy: str = "copy", **how) -> DataFrame:
    """The mix itself: the documents, all columns as they are, each as often as it is taken, numbered from 0 in `copy` (in place of a column so named).

    Rows that agree in doc_id, source and text share their copies evenly, the first ones one more.
    """
    keys = ["id", "src", "text_key"]
    named = lambda d: F.coalesce(d.cast("string"), F.lit("~"))
    taken = allocate(docs, **how).groupBy(named(F.col("doc_id")).alias("id"), _source_key(F.col("source")).alias("src"), "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    rows = docs.drop(copy)
    held = rows.select(named(rows["doc_id"].cast("long")).alias("id"), _source_key(rows["source"]).alias("src"), F.xxhash64(rows["text"]).alias("text_key"), F.struct(*rows.columns).alias("row"))
    met = held.join(taken.filter("copies > 0"), keys).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    times = F.floor((F.col("copies") + F.col("rows") - F.col("nth")) / F.col("rows")).cast("int")
    again = met.select("row", times.alias("times")).filter("times > 0")
    return again.select("row.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias(copy))


def taken(allocated: DataFrame) -> DataFrame:
    """One row for each document: its size, its source's size and target, and the words that the mix takes of it."""
    return allocated.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
