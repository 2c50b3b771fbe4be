"""Periodic runs of words, by comparing a document's word ids with every shift of them.

A run is a stretch of words with smallest period q, at least `exponent` periods
and `least` words long, that no neighbouring word extends. For each lag q, up to
a document's length by `exponent`, the ids are compared with themselves q places
on; true stretches, run-length coded, of enough places are runs. A stretch that
counts has at least (exponent - 1) q places, so it holds eight successive
multiples of 3q/8: those places are compared first, over the whole batch at once,
and the places between them only where eight in a row agree. That loses nothing
and takes n log n comparisons instead of n^2. A lag that is a multiple of a known
run's period agrees exactly inside that run, which is how a run's smallest period
is told.

Documents are scanned where they lie, a batch at a time. One over `long` bytes is
cut into (document, lag range) pieces of about `work` comparisons that Spark deals
out; each piece carries the word ids, and finds the smallest period of what it
meets by itself, by the lag's divisors.

Defined cases: null, empty and blank texts have no words, no runs and an empty
collapsed text. Rows that repeat a doc_id are each reported, a null doc_id too.
Very long texts are scanned whole. An empty table gives no rows. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches

#: A run repeats its period this often, and has this many words at least.
EXPONENT, LEAST = 4, 6
#: A text of over LONG bytes is dealt out by lag ranges of about WORK comparisons.
LONG, WORK = 1 << 20, 1 << 22
#: So many successive probes lie in any stretch that counts, but for the shortest lags.
PROBES = 8

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start:long,length:long,period:long>>"


def word_ids(words: list[bytes], base: int = 0) -> np.ndarray:
    """Equal words have equal numbers, from base on."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64) + base


def _stride(lag: int, exponent: int) -> int:
    return max(1, (exponent - 1) * lag // PROBES)


class _Known:
    """The periodic stretches of a batch by period; those of one period hardly overlap and lie in order."""

    def __init__(self) -> None:
        self.by: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        starts, ends = self.by.setdefault(period, ([], []))
        at = bisect_right(starts, start)
        starts.insert(at, start)
        ends.insert(at, end)

    def end(self, place: int, lag: int) -> int:
        """Where the stretch of equal words at this place and lag ends, if a known period that divides the lag makes it; else -1."""
        for period, (starts, ends) in self.by.items():
            if lag % period == 0:
                at = bisect_right(starts, place) - 1
                if at >= 0 and place + lag < ends[at]:
                    return ends[at] - lag
        return -1


def _root(word: np.ndarray) -> int:
    """The least d that divides the length of word such that word repeats its first d ids."""
    n = len(word)
    small = [d for d in range(1, int(n**0.5) + 1) if n % d == 0]
    for d in [*small, *(n // d for d in reversed(small))]:
        if d == n or (word.reshape(-1, d) == word[:d]).all():
            return d
    return n


def scan(seq: np.ndarray, lengths: np.ndarray, lo: int = 1, hi: int | None = None, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place, length, period) of every run with lo <= period < hi in documents laid end to end, longest first, no two of which share an id."""
    ends, falling = np.cumsum(lengths), -lengths
    last = int(lengths[0]) // exponent if len(lengths) else 0
    known, out = _Known(), []
    for lag in range(lo, min(last + 1, hi or last + 1)):
        size = max(least, exponent * lag)
        docs = int(np.searchsorted(falling, -size, "right"))
        if not docs:
            break
        m, step = int(ends[docs - 1]), _stride(lag, exponent)
        full = size - lag  # places that a run's stretch has at least
        need = full // step
        hits = np.flatnonzero(seq[: m - lag : step] == seq[lag:m:step])
        if len(hits) < need:
            continue
        edge = np.flatnonzero(np.diff(hits) > 1)
        first, end = np.r_[0, edge + 1], np.r_[edge + 1, len(hits)]
        enough = end - first >= need
        for a, z in zip((hits[first[enough]] * step).tolist(), (hits[end[enough] - 1] * step).tolist(), strict=True):
            while (past := known.end(a, lag)) >= 0:  # the first probe that this run doesn't explain
                a = -(-past // step) * step
            if (z - a) // step + 1 < need:
                continue
            at, to = max(0, a - step + 1), min(z + step, m - lag)
            same = np.r_[False, seq[at:to] == seq[at + lag : to + lag], False]
            turn = np.flatnonzero(same[1:] != same[:-1])
            for x, y in zip((turn[::2] + at).tolist(), (turn[1::2] + at).tolist(), strict=True):
                if y - x < full or known.end(x, lag) >= 0:
                    continue
                root = _root(seq[x : x + lag]) if lo > 1 else lag
                known.add(x, y + lag, root)
                if root == lag:
                    out.append((x, y + lag - x, lag))
    return out


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start and period."""
    sizes = np.array([len(ws) for ws in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(least, exponent)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(order):
        return out
    parts, base = [], 0
    for k in order:
        parts.append(word_ids(texts[k], base))
        base = int(parts[-1].max()) + 1
    seq = np.concatenate(parts)
    starts = np.cumsum(np.r_[0, sizes[order]])
    for place, length, period in scan(seq.astype(np.int32) if base < 2**31 else seq, sizes[order], exponent=exponent, least=least):
        k = int(np.searchsorted(starts, place, "right")) - 1
        out[order[k]].append((place - int(starts[k]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def lag_ranges(n: int, work: int, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Ranges [lo, hi) of all lags of a document of n words, each of about `work` comparisons or a single lag."""
    lags = np.arange(1, n // exponent + 1)
    cost = np.cumsum(n / np.maximum(1, (exponent - 1) * lags // PROBES))
    cut = np.unique(np.searchsorted(cost, np.arange(work, cost[-1], work))) if len(lags) else lags
    return [(int(a) + 1, int(b) + 1) for a, b in zip(np.r_[0, cut], np.r_[cut, len(lags)], strict=True) if b > a]


def _rows(ids: pa.Array, keys: pa.Array, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    text = pa.array([b" ".join(kept_words(ws, r)) for ws, r in zip(words, runs, strict=True)], pa.binary())
    found = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], _RUNS)
    return pa.RecordBatch.from_arrays([ids, keys, pa.array([len(ws) for ws in words], pa.int64()), found, text], ["doc_id", "text_key", "n_words", "runs", "text"])


_OUT = f"doc_id long, text_key long, n_words long, runs {_RUNS_SQL}, text binary"


def find(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, long: int = LONG, work: int = WORK) -> DataFrame:
    """(doc_id, text_key, n_words, runs, text) for every row: its runs by start and period, and its words without what repeats, joined by a space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), as_bytes())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in b.column(2).to_pylist()]
            yield _rows(b.column(0), b.column(1), words, runs_of(words, exponent, least))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = word_ids(text.split()).astype("<i4")
                for lo, hi in lag_ranges(len(ids), work, exponent):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "text_key": key, "ids": ids.tobytes(), "lo": lo, "hi": hi}], dealt)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i4")
                found = scan(ids, np.array([len(ids)]), r["lo"], r["hi"], exponent, least)
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text_key": r["text_key"], "start": s, "length": n, "period": p} for s, n, p in found], met)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in b.column(2).to_pylist()]
            runs = [[(r["start"], r["length"], r["period"]) for r in rs or []] for rs in b.column(3).to_pylist()]
            yield _rows(b.column(0), b.column(1), words, runs)

    dealt = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("ids", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])
    met = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    far = rows.filter(size > long)
    pieces = map_batches(far.dropDuplicates(["doc_id", "text_key"]), deal, "doc_id long, text_key long, ids binary, lo long, hi long").repartition("doc_id", "text_key", "lo")
    found = map_batches(pieces, ranged, "doc_id long, text_key long, start long, length long, period long")
    listed = found.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "period", "length"))), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    back = far.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text_key", "text", "runs")
    return map_batches(rows.filter(size <= long), whole, _OUT).unionByName(map_batches(back, joined, _OUT)).withColumn("text", F.col("text").cast("string"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text, made periodic from some word on where crc32 of the id's decimals ends in 0: the words a + i as a + i mod p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(text)), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """One row for each document: how many runs, the longest of them, and hashes of all runs and of what is left."""
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.n")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * -top.n div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
