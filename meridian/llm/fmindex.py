"""Benchmark decontamination with an FM-index for each training shard.

A shard is one Arrow batch of documents, its text the sequence of their words.
Words that no benchmark item has, and word pairs that no item has next to each
other, end a stretch; stretches too short for any window are left out. Over the
rest stands an FM-index: suffix order by prefix doubling, the BWT in a wavelet
matrix with popcount ranks, sampled suffix positions. All windows of the
benchmark are searched backwards at once, occurrences are located by walking to a
sampled position, and what they cover is merged into spans.

Defined cases: null, empty and wordless texts have no words and no hits; a
wordless item has no window. Repeated item rows count once an item_id, a null
item_id is no item. Rows that repeat a doc_id are each reported. Extra columns
are ignored.

The benchmark is the query set. It goes to the executors in blocks of at most
about BLOCK bytes of text, each searched against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, map_batches

WIDTH = 10
BLOCK = 16 << 20
SAMPLE = 8

#: A-Z in lower case; ASCII that is no digit and no letter to space.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Queries:
    """The windows of one block of the benchmark, as word ids from 1 on."""

    def __init__(self, items: list[tuple[int, bytes | None]], width: int = WIDTH) -> None:
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + width]), set()).add(item)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), width), np.int64)
        for row, w in zip(self.windows, owners, strict=True):
            row[: len(w)] = w
        self.items = np.array([i for own in owners.values() for i in sorted(own)], np.int64)
        self.ends = np.cumsum([0, *(len(own) for own in owners.values())])
        self.sigma = len(self.vocab) + 1
        self.singles = self.windows[self.lengths == 1, 0]
        self.least = int(self.lengths[self.lengths > 1].min(initial=width))
        pairs = [row[:n] for row, n in zip(self.windows, self.lengths, strict=True) if n > 1]
        self.pairs = np.unique(np.concatenate([p[:-1] * self.sigma + p[1:] for p in pairs])) if pairs else np.zeros(0, np.int64)

    def kept(self, seq: np.ndarray) -> np.ndarray:
        """Positions of seq (0: no benchmark word) that an occurrence can cover."""
        keep = np.isin(seq, self.singles) & (seq > 0) if len(self.singles) else np.zeros(len(seq), bool)
        if len(self.pairs) and len(seq) > 1:
            code = seq[:-1] * self.sigma + seq[1:]
            at = np.searchsorted(self.pairs, code)
            linked = (seq[:-1] > 0) & (seq[1:] > 0) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == code)
            edge = np.flatnonzero(np.diff(np.r_[False, linked, False].astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            long = ends - starts + 1 >= self.least
            cover = np.zeros(len(seq) + 1, np.int64)
            np.add.at(cover, starts[long], 1)
            np.add.at(cover, ends[long] + 1, -1)
            keep |= np.cumsum(cover[:-1]) > 0
        return np.flatnonzero(keep)


class FMIndex:
    """FM-index over a sequence of non-negative ids."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        n = len(seq) + 1  # with an end that is less than all
        text = np.r_[seq + 1, 0]
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.n, self.bits = n, max(1, int(sigma + 1).bit_length())
        self.sampled = order % sample == 0
        self.at = order[self.sampled]
        self.sampled_rank = np.r_[0, np.cumsum(self.sampled)]
        last = text[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(last, minlength=sigma + 1))]
        self.last, self.levels = last, []
        for b in reversed(range(self.bits)):  # wavelet matrix: zeros of each level first
            bit = (last >> b & 1).astype(bool)
            pad = np.zeros(-(-(n + 1) // 64) * 64, bool)
            pad[:n] = bit
            packed = np.packbits(pad, bitorder="little").view("<u8")
            ones = np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))]
            self.levels.append((b, packed, ones, int(n - bit.sum())))
            last = np.r_[last[~bit], last[bit]]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `upto` places of the BWT."""
        lo, hi = np.zeros_like(upto), upto
        for b, packed, ones, zeros in self.levels:
            one = lambda i: ones[i >> 6] + np.bitwise_count(packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))  # noqa: B023, E731
            a, z = one(lo).astype(np.int64), one(hi).astype(np.int64)
            up = (symbol >> b & 1).astype(bool)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return hi - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns, by backward search of all at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            on = np.flatnonzero((lengths > k) & (hi > lo))
            s = patterns[on, k] + 1
            lo[on], hi[on] = self.before[s] + self.rank(s, lo[on]), self.before[s] + self.rank(s, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back until a sampled one."""
        found, rows, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        while (open_ := np.flatnonzero(found < 0)).size:
            here = rows[open_]
            hit = self.sampled[here]
            found[open_[hit]] = self.at[self.sampled_rank[here[hit]]] + steps
            on = open_[~hit]
            s = self.last[rows[on]]
            rows[on] = self.before[s] + self.rank(s, rows[on])
            steps += 1
        return found


def occurrences(seq: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of a window in seq."""
    keep = q.kept(seq)
    none = np.zeros(0, np.int64)
    if not len(keep):
        return none, none
    apart = np.r_[0, np.cumsum(np.diff(keep) > 1)]  # a separator between stretches
    place = np.arange(len(keep)) + apart
    stretch, origin = np.zeros(place[-1] + 1, np.int64), np.zeros(place[-1] + 1, np.int64)
    stretch[place], origin[place] = seq[keep], keep
    index = FMIndex(stretch, q.sigma)
    lo, hi = index.search(q.windows, q.lengths)
    got = np.flatnonzero(hi > lo)
    count = hi[got] - lo[got]
    which = np.repeat(got, count)
    rows = np.repeat(lo[got] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    return origin[index.locate(rows)], which


def search_batch(texts: list[bytes | None], q: Queries) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: its number of words, the merged word spans [from, to) that are hit, the items found."""
    get, ids, ends = q.vocab.get, [], [0]
    for t in texts:
        ws = words(t)
        ids.extend([get(w, 0) for w in ws])
        ids.append(0)
        ends.append(len(ids))
    seq, ends = np.array(ids, np.int64), np.array(ends)
    at, which = occurrences(seq, q) if len(q.lengths) else (np.zeros(0, np.int64),) * 2
    out: list[tuple[int, list[tuple[int, int]], list[int]]] = [(int(n), [], []) for n in np.diff(ends) - 1]
    if not len(at):
        return out
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + q.lengths[which], -1)
    edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(cover[:-1]) > 0, False].astype(np.int8)))
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        d = int(np.searchsorted(ends, a, "right")) - 1
        out[d][1].append((int(a - ends[d]), int(z - ends[d])))
    doc = np.searchsorted(ends, at, "right") - 1
    for d, w in np.unique(np.stack([doc, which], 1), axis=0):
        out[d][2].extend(q.items[q.ends[w] : q.ends[w + 1]].tolist())
    return [(n, spans, sorted(set(items))) for n, spans, items in out]


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    return [(at[a][0], at[z - 1][1]) for a, z in spans]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the spans, which may overlap."""
    out, at = [], 0
    for a, z in sorted(spans):
        out.append(text[at : max(a, at)])
        at = max(at, z)
    return b"".join([*out, text[at:]])


def blocks(benchmark: DataFrame, block: int = BLOCK, width: int = WIDTH) -> Iterator[Queries]:
    """The query set in blocks of about `block` bytes."""
    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), as_bytes())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block) or 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Queries([(r.item_id, bytes(r.text) if r.text is not None else None) for r in part.collect()], width)


_FOUND = "doc_id long, text_key long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>"


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items) for every row; spans are of words, [start, stop), merged."""
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), as_bytes())
    for q in blocks(benchmark, block, width):
        sent = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = search_batch(b.column(2).to_pylist(), sent.value)
                spans = pa.array([[{"start": a, "stop": z} for a, z in s] for _, s, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _, _ in found], pa.int64()), spans, pa.array([i for _, _, i in found], pa.list_(pa.int64()))], ["doc_id", "text_key", "n_words", "spans", "items"])

        parts.append(map_batches(rows, run, _FOUND))
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # Spans of different blocks may meet: merge them again.
    joined = both.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.expr("CAST(array() AS array<struct<start:int,stop:int>>)")
    merged = F.aggregate(
        "s",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    times = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return times.join(joined.select("doc_id", "text_key", "n_words", merged.alias("spans"), "items").withColumnRenamed("doc_id", "__d").withColumnRenamed("text_key", "__t"), (F.col("doc_id").eqNullSafe(F.col("__d"))) & (F.col("text_key") == F.col("__t"))).drop("__d", "__t")


def digest(found: DataFrame) -> DataFrame:
    """One row for each document: counts of words, hits and items, and the items' SHA-256."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cut_spans: bool = False) -> DataFrame:
    """The documents in which no window occurs; with cut_spans all documents, less the spans that are hit."""
    sent = [docs.sparkSession.sparkContext.broadcast(q) for q in blocks(benchmark, BLOCK, width)]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() if t is not None else None for t in b.column(at).to_pylist()]
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            for q in sent:
                for s, (_, more, _) in zip(spans, search_batch(texts, q.value), strict=True):
                    s.extend(more)
            if not cut_spans:
                yield b.filter(pa.array([not s for s in spans]))
                continue
            new = [None if t is None else without(t, byte_spans(t, s)).decode(errors="replace") for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(new, pa.string()), *b.columns[at + 1 :]], schema=b.schema)

    return map_batches(docs, run, docs.schema)
