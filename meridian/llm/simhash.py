"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64 bits, one for each document. Two documents link if their
fingerprints differ in at most `radius` bits. Of five blocks of bits at least
two agree in any such pair (radius 3), so each distinct fingerprint goes to one
bucket for each pair of blocks; a bucket's fingerprints are stored as vertical bit
planes, and carry-save counters update the distances of 64 fingerprints at a
time. A tile whose every distance has passed the radius is left early.

similar_groups links by similarity: wider fingerprints of the sets of shingles
are compared in the same way, in buckets of sets that share minima, and what is
within a generous radius is compared exactly.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any
others. A text of fewer words than a shingle is one shingle. Rows that repeat a
doc_id are each fingerprinted and returned. A null doc_id is never a component's
name. Columns other than id and text are ignored. In similar_groups texts without
a word are all alike, rows with a null doc_id aren't listed, and rows that repeat
a doc_id are each listed, with their own text's component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, components, cut, map_batches, merge

SEED = 42
TILE = 256
#: A bucket with more fingerprints than this is dealt again by a further block of equal bits, and what stays larger by tiles of two parts.
HOT = 20_000
#: Fingerprints in their buckets that one task compares.
ROWS_A_TASK = 400_000
#: Sets that one task compares exactly, shingles in one part of a crowded bucket, and bytes of rows that a worker gathers at least.
SETS_A_TASK, SHINGLES, HELD = 20_000, 4_000_000, 16 << 20
#: Words of 64 bits in the fingerprints of similar_groups, and the minima by which their sets meet: BANDS keys of ROWS minima each.
WORDS, BANDS, ROWS = 4, 12, 3
#: The radius of similar_groups is that many deviations above the distance expected at the similarity asked for.
DEVIATIONS = 4


def _shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of `width` words, in order; of fewer words, of them all."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)], "<u8")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned SimHash over shingles of `width` words; a bit is set if it is in over half the shingles."""
    hashes = _shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes of fingerprints (n, words): (64 x words, n / 64), lane j of word w is fingerprint 64 w + j."""
    fps = fps.reshape(len(fps), -1)
    n = -(-len(fps) // 64) * 64
    padded = np.zeros((n, fps.shape[1]), "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, vertical: np.ndarray, radius: int, skip: np.ndarray | None = None) -> np.ndarray | None:
    """Lanes within the radius of each query, as words of bits; None once every lane has passed it. Lanes in skip count as passed."""
    queries = queries.reshape(len(queries), -1)
    shape = (len(queries), vertical.shape[1])
    digits = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint64) if skip is None else skip.copy()
    flips = np.uint64(0) - np.unpackbits(np.ascontiguousarray(queries, "<u8").view(np.uint8), axis=1, bitorder="little").T.astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)

    def passed() -> np.ndarray:
        """Counts over the radius, which need not be 2^k - 1."""
        above, equal = np.zeros(shape, np.uint64), np.full(shape, full)
        for k in reversed(range(len(digits))):
            if radius >> k & 1:
                equal &= digits[k]
            else:
                above |= equal & digits[k]
                equal &= ~digits[k]
        return over | above

    for b in range(len(vertical)):
        carry = vertical[b][None, :] ^ flips[b][:, None]
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        over |= carry
        if b % 8 == 7 and b >= radius and (passed() == full).all():
            return None
    return ~passed()


def near_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of fingerprints within the radius inside each bucket (bucket is sorted), tile by tile."""
    for at in range(0, len(fps), TILE):
        last = np.searchsorted(bucket, bucket[min(at + TILE, len(fps)) - 1], "right")
        for to in range(at, last, 4096):
            vertical = planes(fps[to : min(to + 4096, last)])
            # Only later fingerprints of the same bucket are asked for; the rest counts as passed.
            mine, theirs = np.arange(at, min(at + TILE, len(fps))), np.arange(to, to + 64 * vertical.shape[1])
            other = bucket[np.minimum(theirs, len(fps) - 1)]
            wanted = (theirs[None, :] > mine[:, None]) & (theirs < last) & (other[None, :] == bucket[mine][:, None])
            near = within(fps[mine], vertical, radius, np.packbits(~wanted, axis=1, bitorder="little").view("<u8"))
            if near is None:
                continue
            i, w = np.nonzero(near)
            bits = np.unpackbits(near[i, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, j = np.nonzero(bits)
            yield i[k] + at, w[k] * 64 + j + to


def link_buckets(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least index it is joined with inside its bucket (bucket is sorted)."""
    root = np.arange(len(fps))
    for i, j in near_pairs(fps, bucket, radius):
        merge(root, i, j)
    return root


def link_sets(fps: np.ndarray, bucket: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> np.ndarray:
    """link_buckets() of sets: a pair within the radius is joined if the exact similarity of its sets (sorted arrays) is enough. Pairs that are joined already aren't looked at."""
    root, size = np.arange(len(fps)), np.array([len(s) for s in sets], np.int64)
    held, postings = -1, (np.zeros(0, np.int64),) * 3
    for i, j in near_pairs(fps, bucket, radius):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(i)], strict=False):
            one, many = int(i[a]), j[a:z]
            n = np.minimum(size[many], size[one])
            many = many[(root[many] != root[one]) & (n >= similarity * np.maximum(size[many], size[one]) - 1e-9)]
            if not len(many):
                continue
            if len(many) <= 8:
                both = np.array([len(np.intersect1d(sets[one], sets[m], assume_unique=True)) for m in many.tolist()])
            else:  # by lists of the bucket's rows that have a shingle
                if held != bucket[one]:
                    held, postings = int(bucket[one]), _postings(sets, *np.searchsorted(bucket, [bucket[one], bucket[one] + 1]).tolist())
                known, starts, rows = postings
                at = np.searchsorted(known, sets[one])
                spans = starts[at + 1] - starts[at]
                ends = np.cumsum(spans)
                counts = np.bincount(rows[np.repeat(starts[at] - np.r_[0, ends[:-1]], spans) + np.arange(ends[-1])])
                low = int(np.searchsorted(bucket, bucket[one]))
                both = np.pad(counts, (0, max(0, int(many.max()) - low + 1 - len(counts))))[many - low]
            alike = many[both >= similarity * (size[many] + size[one] - both) - 1e-9]
            if len(alike):
                merge(root, np.full(len(alike), one), alike)
    return root


def _postings(sets: list[np.ndarray], a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, where each one's rows start, rows from 0) of the sets a to z."""
    flat = np.concatenate(sets[a:z])
    rows = np.repeat(np.arange(z - a), [len(s) for s in sets[a:z]])
    order = np.argsort(flat, kind="stable")
    known, starts = np.unique(flat[order], return_index=True)
    return known, np.r_[starts, len(flat)], rows[order]


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints (n, words) of a column of longs or of bytes."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1) if len(column) else np.zeros((0, 1), "<u8")


def _by_bucket(done: Callable[[pa.Table], pa.RecordBatch], rows: int = 20_000):
    """A worker over rows in order of their bucket: `done` gets whole buckets, about `rows` rows at a time, those alone in their bucket left out."""

    def met(table: pa.Table) -> pa.Table:
        group = table.column("bucket").to_numpy()
        same = group[1:] == group[:-1]
        return table.filter(pa.array(np.r_[False, same] | np.r_[same, False]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < HELD:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = table.column("bucket").to_numpy()
            whole = int(np.searchsorted(group == group[-1], True))  # the last bucket may go on
            if whole:
                yield done(met(table.slice(0, whole)))
                held = table.slice(whole).to_batches()
            else:
                held = table.to_batches()
        if held and sum(x.num_rows for x in held):
            yield done(met(pa.Table.from_batches(held).combine_chunks()))

    return run


def _numbered(table: pa.Table) -> np.ndarray:
    """Buckets of a table in order, from 0."""
    group = table.column("bucket").to_numpy()
    return np.cumsum(np.r_[False, group[1:] != group[:-1]][: len(group)])


def _moved(table: pa.Table, root: np.ndarray) -> pa.RecordBatch:
    rep, moved = table.column("rep").to_numpy(), np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(rep[moved], pa.int64()), pa.array(rep[root[moved]], pa.int64())], ["a", "b"])


def _link(radius: int):
    return _by_bucket(lambda table: _moved(table, link_buckets(_unsigned(table.column("fp")), _numbered(table), radius)))


def _mark(radius: int):
    """(bucket, rep) of every fingerprint that has another within the radius in its bucket.

    What hangs together over such pairs is a bucket of its own here, named by its
    members, so one that several buckets hold has the same rows from each.
    """

    def done(table: pa.Table) -> pa.RecordBatch:
        root, rep = np.arange(table.num_rows), table.column("rep").to_numpy()
        for i, j in near_pairs(_unsigned(table.column("fp")), _numbered(table), radius):
            merge(root, i, j)
        size = np.bincount(root, minlength=len(root))[root]
        mixed = (rep.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        name = np.zeros(len(root), np.uint64)
        np.add.at(name, root, mixed ^ (mixed >> np.uint64(32)))
        near = np.flatnonzero(size > 1)
        return pa.RecordBatch.from_arrays([pa.array(name[root[near]].view(np.int64)), pa.array(rep[near])], ["bucket", "rep"])

    return _by_bucket(done)


def _link_alike(radius: int, similarity: float):
    """Edges that span what is within the radius and exactly alike in each bucket of (bucket, rep, fp, shingles)."""

    def done(table: pa.Table) -> pa.RecordBatch:
        listed = table.column("shingles").combine_chunks()
        flat, ends = listed.values.to_numpy(), listed.offsets.to_numpy()
        sets = [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return _moved(table, link_sets(_unsigned(table.column("fp")), _numbered(table), sets, radius, similarity))

    return _by_bucket(done)


def masks(radius: int) -> list[int]:
    """Masks of all choices of 2 among radius + 2 even blocks of 64 bits: a pair within the radius agrees under one."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [one[i] | one[j] for i, j in combinations(range(blocks), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(mask: int, radius: int) -> list[int]:
    """The bits outside mask in radius + 1 parts, each with mask: a pair within the radius agrees under one."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(radius + 1)]


def _dealt(rows: DataFrame, hot: int, number: int) -> DataFrame:
    """Rows (fp, rep, n, bucket) in order of their buckets.

    The rows of a crowded bucket fall into parts of about `hot` rows and of
    SHINGLES in all (n says how many a row has), and each two parts meet in a
    bucket of their own, so every pair is compared and no task holds more than
    two parts. `number` says how many rows there are about.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number // ROWS_A_TASK))
    parts = F.least(F.ceil(F.greatest(F.count("*") / hot, F.sum("n") / SHINGLES)), F.count("*")).cast("int")
    crowded = rows.groupBy("bucket").agg(parts.alias("parts")).filter("parts > 1")
    dealt = rows.join(crowded, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
    tiled = dealt.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
    tile = F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    return tiled.select(tile.alias("bucket"), "fp", "rep").repartition(tasks, "bucket").sortWithinPartitions("bucket", "rep")


def links(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between representatives (fp, rep) that span every set of fingerprints within the radius.

    All links are compared, but a bucket hands on only a spanning set of them.
    """
    wide = masks(radius)
    keyed = fps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(wide)])).alias("s")).select("fp", "rep", "s.t", "s.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key", (F.col("n") > hot).alias("hot"))
    fine = [_parts(m, radius) for m in wide]
    shared = keyed.join(sizes, ["t", "key"])
    again = F.array(*[
        F.struct(F.lit(p + 1).alias("p"), F.element_at(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(f[p]))) for f in fine]), F.col("t") + 1).alias("k"))
        for p in range(radius + 1)
    ])
    dealt = shared.select("fp", "rep", "t", F.explode(F.when(F.col("hot"), again).otherwise(F.array(F.struct(F.lit(0).alias("p"), F.col("key").alias("k"))))).alias("s"))
    rows = dealt.select("fp", "rep", F.xxhash64("t", "s.p", "s.k").alias("bucket"))
    ready = _dealt(rows.withColumn("n", F.lit(1)), hot, fps.count() * len(wide))
    return map_batches(ready, _link(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least doc_id reachable over links."""
    marked = cut(fingerprints(docs, width, id_col, text_col), "simhash")
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    found = components(links(groups.filter("rep IS NOT NULL"), radius))
    named = groups.join(found, groups.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


@cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of 64 x words bits of a set of shingle hashes."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None].view(np.uint64) * _odd(words, 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def minima(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of a set of shingle hashes: each of `rows` minima under orders of their own; two sets share one with the chance similarity^rows."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None].view(np.uint64) * _odd(bands * rows, 2)).min(axis=0), out=least)
    keys = np.zeros(bands, np.uint64)
    for k in range(rows):
        keys = (keys ^ least.reshape(bands, rows)[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def similar_radius(similarity: float, bits: int) -> int:
    """The distance that fingerprints of sets with this Jaccard similarity have on average, and DEVIATIONS more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p))))


def _sets(docs: DataFrame, width: int, sketch: bool) -> DataFrame:
    """(doc_id, key, n, fp, keys) or (doc_id, key, n, shingles): key is a 128-bit hash of all distinct shingle hashes of a text, n their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_shingle_hashes(t, width).view(np.int64)) for t in b.column(1).to_pylist()]
            known = [b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            listed = [minima(s) for s in sets] if sketch else sets
            flat = pa.array(np.concatenate(listed) if listed else np.zeros(0, np.int64), pa.int64())
            longs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in listed])], pa.int32()), flat)
            if sketch:
                yield pa.RecordBatch.from_arrays([*known, pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary()), longs], ["doc_id", "key", "n", "fp", "keys"])
            else:
                yield pa.RecordBatch.from_arrays([*known, longs], ["doc_id", "key", "n", "shingles"])

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes())
    return map_batches(rows, run, "doc_id long, key binary, n int, " + ("fp binary, keys array<long>" if sketch else "shingles array<long>"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, hot: int = HOT) -> DataFrame:
    """(doc_id, component_id) of documents linked by a Jaccard similarity of at least `similarity` of their shingles.

    Equal sets are one. Sets meet by minima of their shingles and are compared
    there as bit planes of SimHash fingerprints. Those that have another one
    within the radius meet once more, now with their shingles: a pair within the
    radius is linked if its exact similarity is enough, and each bucket hands on
    a spanning set of its links, not all pairs. A pair at 0.8 meets with a chance
    over 0.999 and is within the radius with one as high (0.98 for sets of four
    and five shingles, the least that can be so alike). Buckets grow with what
    is alike, not with the corpus.
    """
    radius = similar_radius(similarity, 64 * WORDS)
    marked = cut(_sets(docs, width, True), "sets")
    groups = cut(marked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets-groups")
    keyed = groups.filter("n > 0").select("fp", "rep", "n", F.posexplode("keys").alias("t", "key"))
    ready = _dealt(keyed.select("fp", "rep", "n", F.xxhash64("t", "key").alias("bucket")), hot, groups.count() * BANDS)
    marks = cut(map_batches(ready, _mark(radius), "bucket long, rep long").distinct(), "sets-marks")
    near = cut(groups.join(marks.select("rep").distinct(), "rep", "left_semi").select("key", "rep", "fp"), "sets-near")
    texts = docs.select("doc_id", "text").join(near.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = cut(_sets(texts, width, False).select("key", F.col("doc_id").alias("rep"), "shingles").dropDuplicates(["key", "rep"]).join(near, ["key", "rep"]), "sets-own")
    sized = own.select("rep", "fp", "shingles")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marks.count() // SETS_A_TASK))
    met = marks.join(sized, "rep").repartition(tasks, "bucket").sortWithinPartitions("bucket", "rep").select("bucket", "rep", "fp", "shingles")
    found = cut(components(map_batches(met, _link_alike(radius, similarity), "a long, b long")), "sets-found")
    named = groups.join(found, groups.rep == found.node, "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    return marked.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The documents without near duplicates: of each group of similar ones the row with the least doc_id stays.

    Rows that repeat this doc_id all carry the same id; of them one stays. Rows
    with a null doc_id stay, since they can't be told apart.
    """
    ids = similar_groups(docs, similarity, width)
    stay = cut(ids.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "simhash-stay")
    once, more = stay.filter("n = 1").select("doc_id"), stay.filter("n > 1").select("doc_id")
    repeated = docs.join(more, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return docs.join(once, "doc_id", "left_semi").unionByName(repeated).unionByName(docs.filter("doc_id IS NULL"))
