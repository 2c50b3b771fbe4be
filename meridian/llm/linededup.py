"""Line dedup by overlapping windows of three lines, in DataFrame functions alone.

A window is `width` consecutive lines (split at \\n). Windows are found equal by
two 64-bit hashes of their lines' hashes. The first occurrence of a window, by
(doc_id, line number), stays; every line that a later occurrence covers is
removed, overlaps included. Windows are judged on the input.

Defined cases: null texts have no lines and stay null. Texts of fewer lines than a
window, the empty text among them, stay as they are. Windows of blank lines only
(no character but space, tab and \\r) don't count. Rows that repeat a doc_id count as one
document: an occurrence at the first one's (doc_id, line) is the first one.
Rows with a null doc_id stay as they are and are nobody's earlier copy. Extra
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, pos, h1, h2) for every window that isn't blank."""
    hashed = docs.filter("doc_id IS NOT NULL").select(
        "doc_id",
        F.transform(
            _lines(F.col("text")),
            lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(F.translate(x, "\t\r", "  ")) != "").alias("full")),
        ).alias("ls"),
    )
    starts = F.sequence(F.lit(1), F.size("ls") - (width - 1))
    line = lambda i, k: F.element_at(F.col("ls"), i + k)
    made = F.transform(
        starts,
        lambda i: F.struct(
            (i - 1).alias("pos"),
            F.xxhash64(*[line(i, k)["a"] for k in range(width)]).alias("h1"),
            F.xxhash64(*[line(i, k)["b"] for k in range(width)]).alias("h2"),
            F.array_contains(F.array(*[line(i, k)["full"] for k in range(width)]), True).alias("full"),
        ),
    )
    rows = hashed.filter(F.size("ls") >= width).select("doc_id", F.explode(F.filter(made, lambda w: w["full"])).alias("w"))
    return rows.select("doc_id", "w.pos", "w.h1", "w.h2")


def covered(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, gone): the line numbers that later occurrences of a repeated window cover."""
    found = windows(docs, width)
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(firsts, ["h1", "h2"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    return later.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + (width - 1))))).alias("gone"))


def _judged(docs: DataFrame, width: int) -> DataFrame:
    """docs with __lines, __removed and __kept, which no column of theirs may be named."""
    gone = covered(docs, width).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, docs["doc_id"] == gone["__id"], "left").withColumn("__split", _lines(F.col("text")))
    # The numbers that are left, by one set difference: a test of each line against all numbers would take lines times lines.
    left = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__gone"))
    kept = F.concat_ws("\n", F.transform(left, lambda i: F.get(F.col("__split"), i)))
    return joined.withColumns(
        {
            "__lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("__split")).cast("long"),
            "__removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
            "__kept": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept),
        }
    ).drop("__id", "__gone", "__split")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with a new text, and n_lines and n_removed (in place of columns so named; null texts: 0 lines)."""
    return _judged(docs, width).withColumns({"text": F.col("__kept"), "n_lines": F.col("__lines"), "n_removed": F.col("__removed")}).drop("__lines", "__removed", "__kept")


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with repeated lines removed; those of which no line is left go. Columns stay as they are."""
    left = _judged(docs, width).filter("__removed = 0 OR __removed < __lines")
    return left.withColumn("text", F.col("__kept")).drop("__lines", "__removed", "__kept")
