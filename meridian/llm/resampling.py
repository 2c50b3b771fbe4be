"""Importance resampling towards a target distribution, over a persisted sparse count matrix.

A document's features are all runs of one to three of its words; each is hashed
(CRC-32 of its bytes) to one of `BUCKETS` columns. The matrix of counts, documents
by buckets, is written once as blocks of compressed sparse rows: row pointers,
column gaps and counts. Column sums of the blocks and of the target's texts give
the two distributions and so a gain for each bucket; a sparse matrix-vector
product of the blocks with the gains gives each document's weight. Documents are
drawn without replacement by weight plus seeded Gumbel noise.

The checksum of a run of words isn't taken over its bytes: CRC-32 is linear, so
that of a + b is that of a, moved by the length of b, xor that of b. Tables for
each word length move whole arrays at once.

What the driver holds: column sums (`BUCKETS` numbers) and one row count for each
part of the ranking. The gains, as many numbers, are all that is broadcast.

Defined cases: null, empty and wordless texts have no features and weight 0; they
are never drawn where `least` is over 0. Rows that repeat a doc_id are each
counted, weighed and ranked; among equal scores the lesser doc_id comes first,
null last. Without target texts the target is uniform. Very long texts are taken
in pieces of words, so a row of the matrix never holds more than the buckets. An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_batches, ranked, scratch
from .fmindex import _TABLE

BUCKETS, WIDTH, SEED = 10_000, 3, 42
#: A block of the matrix is of texts of about BLOCK bytes; a row group of its files has GROUP bytes.
BLOCK, GROUP = 1 << 20, 4 << 20
#: Bytes of a text that are split into words at a time.
SLICE = 4 << 20

_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of one byte, without start and end values


def _moved(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each checksum moved by one table of four times 256."""
    return table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]


@lru_cache(maxsize=None)
def _doubling(j: int) -> np.ndarray:
    """The table that moves a checksum by 2^j zero bytes."""
    if j == 0:
        x = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return (x >> 8) ^ _CRC[x & 255]
    half = _doubling(j - 1)
    return _moved(half, half)


@lru_cache(maxsize=4096)
def move_table(n: int) -> np.ndarray:
    """The table that moves a checksum by n zero bytes."""
    table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for j in range(n.bit_length()):
        if n >> j & 1:
            table = _moved(table, _doubling(j))
    return table


def run_checksums(words: list[bytes], docs: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to width: (checksum, document) of all runs of so many words of one document, joined by a space."""
    alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size, of = np.unique(np.fromiter(map(len, words), np.int64, len(words)), return_inverse=True)
    tables = np.stack([move_table(int(n)) for n in size]) if len(size) else np.zeros((1, 4, 256), np.uint32)
    flat = tables.reshape(-1)
    space, one = np.uint32(zlib.crc32(b" ")), move_table(1)
    out, head = [(alone, docs)], alone
    for k in range(1, width):
        head = (_moved(head, one) ^ space)[:-1] if len(head) else head
        at = of[k:] << 10
        head = flat[at + (head & 255)] ^ flat[at + 256 + (head >> 8 & 255)] ^ flat[at + 512 + (head >> 16 & 255)] ^ flat[at + 768 + (head >> 24)] ^ alone[k:]
        whole = docs[k:] == docs[: len(docs) - k]
        out.append((head[whole], docs[k:][whole]))
    return out


def _slices(text: bytes) -> Iterator[list[bytes]]:
    plain, at = text.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if len(plain) - at > SLICE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def bucket_counts(text: bytes, buckets: int = BUCKETS, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """(words, count for each bucket) of one text, taken slice by slice."""
    n, counts, carry = 0, np.zeros(buckets, np.int64), []
    for words in _slices(text):
        if not words:
            continue
        n += len(words)
        for k, (crc, _) in enumerate(run_checksums(carry + words, np.zeros(len(carry) + len(words), np.int64), width)):
            new = crc[max(0, len(carry) - k) :]  # runs that end in the carried words were counted before
            counts += np.bincount(new % buckets, minlength=buckets)
        carry = (carry + words)[-(width - 1) :] if width > 1 else []
    return n, counts


def csr(texts: list[bytes | None], buckets: int = BUCKETS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words by text, row pointers, columns, counts) of the texts' counts."""
    words: list[bytes] = []
    n_words = np.zeros(len(texts), np.int64)
    dense: list[tuple[int, np.ndarray]] = []
    for i, text in enumerate(texts):
        if text and len(text) > SLICE:
            n_words[i], row = bucket_counts(text, buckets, width)
            dense.append((i, row))
        elif text:
            ws = text.translate(_TABLE).split()
            n_words[i] = len(ws)
            words += ws
    inside = n_words.copy()
    inside[[i for i, _ in dense]] = 0
    docs = np.repeat(np.arange(len(texts)), inside)
    keys = np.concatenate([d * buckets + crc % buckets for crc, d in run_checksums(words, docs, width)])
    keys, counts = np.unique(keys, return_counts=True)
    if dense:
        keys = np.concatenate([keys, *(i * buckets + np.flatnonzero(row) for i, row in dense)])
        counts = np.concatenate([counts, *(row[row > 0] for _, row in dense)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    return n_words, np.searchsorted(keys, np.arange(len(texts) + 1) * buckets), keys % buckets, counts


#: Blocks hold their arrays as little-endian bytes: words of 64 bits, ends, gaps and counts of 32.
_BLOCK = "doc_ids array<long>, text_keys array<long>, n_words binary, ends binary, gaps binary, counts binary"


def count_matrix(docs: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """The documents' count matrix as written blocks: their rows' ids, words and ends, and for each entry the gap to the column before it and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names, keys = b.column(2), b.column(0), b.column(1)
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
                n_words, ends, columns, counts = csr(texts[at:to].to_pylist(), buckets, width)
                gaps = np.diff(columns, prepend=0)
                heads = ends[:-1][np.diff(ends) > 0]
                gaps[heads] = columns[heads]
                ids, own = (pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), c[at:to]) for c in (names, keys))
                rest = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((n_words, "<i8"), (ends[1:], "<i4"), (gaps, "<i4"), (counts, "<i4"))]
                yield pa.RecordBatch.from_arrays([ids, own, *rest], ["doc_ids", "text_keys", "n_words", "ends", "gaps", "counts"])
                at = to

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), as_bytes())
    path = scratch(spark, "matrix")
    # Small row groups, looked after from the first row on: a block is a long row, and a reader holds a row group at a time.
    map_batches(rows, run, _BLOCK).write.option("compression", "zstd").option("parquet.block.size", GROUP).option("parquet.page.size.row.check.min", 1).parquet(path)
    return spark.read.schema(_BLOCK).parquet(path)


def _block(b: pa.RecordBatch, row: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, words, row pointers, columns, counts) of one block."""
    ids, keys = b.column(0)[row].values, b.column(1)[row].values
    words, ends, gaps, counts = (np.frombuffer(b.column(k)[row].as_py(), kind).astype(np.int64) for k, kind in ((2, "<i8"), (3, "<i4"), (4, "<i4"), (5, "<i4")))
    ends, run = np.r_[0, ends], np.cumsum(gaps)
    heads = ends[:-1][np.diff(ends) > 0]
    before = np.zeros(len(ends) - 1, np.int64)
    before[np.diff(ends) > 0] = run[heads] - gaps[heads]
    return ids, keys, words, ends, run - np.repeat(before, np.diff(ends)), counts


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is met in all; each task sums its blocks before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                *_, columns, counts = _block(b, row)
                total += np.bincount(columns, counts, buckets).astype(np.int64)  # below 2^53 in one block
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(matrix, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's share of a bucket over the source's, each count raised by one."""
    own, other, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (own + n) / ((float(s) + 1) * (other + n)))) for s, t in zip(source, target, strict=True)], np.int64)


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight) for every row of docs, as a written table."""
    matrix = count_matrix(docs, buckets, width)
    goal = count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, width)
    gain = docs.sparkSession.sparkContext.broadcast(gains(column_sums(matrix, buckets), column_sums(goal, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, keys, words, ends, columns, counts = _block(b, row)
                features, product = (np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (counts, counts * gain.value[columns]))
                yield pa.RecordBatch.from_arrays([ids, keys, *(pa.array(x, pa.int64()) for x in (words, features, product))], ["doc_id", "text_key", "n_words", "n_features", "weight"])

    return cut(map_batches(matrix, run, "doc_id long, text_key long, n_words long, n_features long, weight long"), "weights")


def noise(doc_id, seed: int = SEED):
    """floor(1000 times Gumbel noise) of the row key, from the first 32 bits of SHA-256(seed:doc_id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score, rank) for every row of docs.

    Of those with `least` words or more, `percent` of a hundred are drawn, highest
    scores first; the others' rank is null.
    """
    scored = weights(docs, target, buckets, width).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    can = scored.filter(F.col("n_words") >= least)
    n = can.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    return ranked(can, order, n, percent * n // 100).unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, all columns as they are, with their rank (in place of a column so named); equal rows count as one."""
    drawn = draw(docs, target, **how).filter("rank IS NOT NULL").groupBy("doc_id", "text_key").agg(F.min("rank").alias("rank"))
    rows = docs.drop("rank")
    met = rows.join(drawn, rows["doc_id"].cast("long").eqNullSafe(drawn["doc_id"]) & (F.xxhash64(rows["text"]) == drawn["text_key"]))
    return met.select(*[rows[c] for c in rows.columns], drawn["rank"])
