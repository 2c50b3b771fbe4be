"""Token-ID files in Simple-8b: whole 64-bit words, each with a selector and as many ids as fit.

The top 4 bits of a word select how its other 60 hold ids: 120 zeros, or 60 of 1
bit down to one of 60. Ids of over 60 bits are escapes: a word with selector 0
holds the place of the full id in the block's list at its end. Ids are packed in
blocks of BLOCK, each packed by itself, so that all blocks of a buffer are coded
in step and any can be decoded alone from its offset.

A file: magic, blocks, then a footer (block offsets, ids and words of each
block; document ids, nulls and lengths), its length, magic. Files are written in
ascending doc_id order, one a range partition; a manifest gives each its first
id's place in the whole corpus.

Defined cases: a null text is the empty one, whose document is the end id alone.
Null doc_ids come first. Rows that repeat a doc_id are ordered by text, and each
is a document. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, map_batches, scratch

BLOCK = 1024
#: Bytes of text that one task encodes, into one file.
TASK = 32 << 20
MAGIC = b"MRDNS8B1"
#: Fixed values of the format: ids in a word and bits of each, by selector from 1 on. Selector 0 is the escape.
COUNTS = (120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Parts of texts, and units of parts, that an encoder remembers before it starts anew.
PARTS, UNITS = 800_000, 1_000_000
#: Signs behind a word, and small Latin letters in UTF-8: the tokenizer always splits between them.
_SIGNS = b".,;:!?#*$%&"
#: Bytes as the byte-level alphabet of the tokenizer writes them: printable Latin-1 as itself, others from 256 on.
_ALPHABET = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 324), strict=True))
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _widths(ids: np.ndarray) -> np.ndarray:
    """The least width of the format that holds each id."""
    small = _small_widths()
    if not ids.size or ids.max() < len(small):
        return small[ids]
    out = np.zeros(ids.shape, np.uint8)
    for less, b in zip(BITS, BITS[1:], strict=False):
        out[ids >> np.uint64(less) > 0] = b
    return out


@cache
def _small_widths() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for less, b in zip(BITS, BITS[1:], strict=False):
        out[1 << less :] = b
    return out


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escapes of each block); a block's escapes follow its words."""
    ids = np.asarray(ids, np.uint64)
    n = -(-len(ids) // block)
    grid = np.zeros((n, block), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    sizes = np.full(n, block)
    if n:
        sizes[-1] = len(ids) - block * (n - 1)
    big = grid >> np.uint64(60) > 0 if len(ids) and int(ids.max()) >> 60 else np.zeros((n, 1), bool)
    escapes = [grid[i, big[i]] for i in np.flatnonzero(big.any(axis=1))]
    n_escapes = big.sum(axis=1)
    least = _widths(np.where(big, np.uint64(0), grid) if n_escapes.any() else grid)
    if n_escapes.any():
        least[big] = 61
    # The widest id among the next 1, 2, 4, ... ids, and from that the best selector at each place.
    reach = {1: least}
    while (w := max(reach)) < 64:
        a = reach[w]
        reach[2 * w] = np.maximum(a, np.pad(a[:, w:], ((0, 0), (0, w)))) if w < block else a
    pick = np.zeros((n, block), np.uint8)
    low = int(least.min(initial=0))
    for s in reversed(range(len(COUNTS))):
        if BITS[s] < low:
            break
        c, w = COUNTS[s], 1 << (COUNTS[s].bit_length() - 1)
        a = reach[w]
        rest = c - w
        widest = np.maximum(a, np.pad(a[:, rest:], ((0, 0), (0, rest)))) if 0 < rest < block else a
        fit = widest <= BITS[s]
        pick[fit] = s + 1
    at, live = np.zeros(n, np.int64), np.arange(n)
    rows, places, chosen, steps = [], [], [], []
    count = np.array([1, *COUNTS])
    step = 0
    while len(live):
        s = pick[live, at[live]]
        rows.append(live)
        places.append(at[live])
        chosen.append(s)
        steps.append(np.full(len(live), step))
        at[live] = at[live] + count[s]
        live = live[at[live] < sizes[live]]
        step += 1
    if not rows:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, place, s, step_of = (np.concatenate(x) for x in (rows, places, chosen, steps))
    n_words = np.bincount(row, minlength=n)
    wide = np.pad(grid, ((0, 0), (0, max(COUNTS))))
    words = np.zeros(len(row), np.uint64)
    for k in np.unique(s):
        on = np.flatnonzero(s == k)
        if k == 0:
            order = np.cumsum(big, axis=1) - 1
            words[on] = order[row[on], place[on]].astype(np.uint64)
            continue
        c, b = COUNTS[k - 1], BITS[k - 1]
        value = np.full(len(on), np.uint64(k) << np.uint64(60))
        for j in range(c if b else 0):
            value |= wide[row[on], place[on] + j] << np.uint64(j * b)
        words[on] = value
    starts = _starts(n_words + n_escapes)
    out = np.zeros(int((n_words + n_escapes).sum()), "<u8")
    out[starts[row] + step_of] = words
    for i, extra in zip(np.flatnonzero(n_escapes), escapes, strict=True):
        a = starts[i] + n_words[i]
        out[a : a + len(extra)] = extra
    return out, n_words, n_escapes


def unpack(words: np.ndarray, n_words: np.ndarray, n_escapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks with `sizes` ids."""
    starts = _starts(n_words + n_escapes)
    block = np.repeat(np.arange(len(n_words)), n_words)
    at = np.repeat(starts - _starts(n_words), n_words) + np.arange(n_words.sum())
    w = words[at]
    s = (w >> np.uint64(60)).astype(np.int64)
    count = np.array([1, *COUNTS])[s]
    done = np.cumsum(count) - count
    first = _starts(n_words)
    place = done - done[first][block]  # of the word's first id in its block
    begin = _starts(sizes)
    out = np.zeros(int(sizes.sum()), np.uint64)
    body = w & np.uint64((1 << 60) - 1)
    for k in np.unique(s):
        on = np.flatnonzero(s == k)
        if k == 0:
            out[begin[block[on]] + place[on]] = words[starts[block[on]] + n_words[block[on]] + body[on].astype(np.int64)]
            continue
        c, b = COUNTS[k - 1], BITS[k - 1]
        if not b:
            continue
        mask = np.uint64((1 << b) - 1)
        for j in range(c):
            here = place[on] + j
            ok = here < sizes[block[on]]
            out[begin[block[on][ok]] + here[ok]] = body[on][ok] >> np.uint64(j * b) & mask
    return out


def _open(text: bytes) -> bytes:
    """The text with ASCII capitals small, which the tokenizer takes alike; not where a special token may stand."""
    return text if b"<|" in text else text.translate(LOWER)


class WordEncoder:
    """Encodes whole texts with a tokenizer of the tokenizers library whose pieces never span white space.

    The tokenizer splits at white space, and letters from signs, before it
    merges, so a text's ids are those of its parts between ASCII white space,
    and a part of small Latin letters with signs behind is those letters and those
    signs. Parts are remembered as one or two units, and each distinct unit is
    encoded once; ASCII capitals count as small, as the tokenizer takes them.
    Other parts go through the whole tokenizer.
    """

    def __init__(self, path: str, parts: int = PARTS, units: int = UNITS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limits = parts, units
        self.tokenizer.model._resize_cache(0)  # each unit is asked for once
        self._forget()

    def _forget(self) -> None:
        self.units: dict[bytes, int] = {b"": 0}
        self.ids, self.ends = array("I"), array("Q", [0, 0])  # unit 0 is the empty one
        self._forget_parts()

    def _forget_parts(self) -> None:
        self.parts: dict[bytes, int] = {}
        self.heads, self.tails = array("I"), array("I")

    def _learn(self, parts: list[bytes]) -> None:
        heads = [p.rstrip(_SIGNS) for p in parts]
        tails = [p[len(h) :] for p, h in zip(parts, heads, strict=True)]
        odd = [i for i, h in enumerate(heads) if not (h.isalpha() and h.islower()) and not _LATIN.fullmatch(h)]
        for i in odd:
            heads[i], tails[i] = parts[i], b""
        units = self.units
        whole = [u for u in dict.fromkeys([parts[i] for i in odd]) if u not in units]
        self._encode_parts(whole)
        self._encode_words([u for u in dict.fromkeys([*heads, *tails]) if u not in units])
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts)), strict=True))
        self.heads.extend(map(units.__getitem__, heads))
        self.tails.extend(map(units.__getitem__, tails))

    def _encode_words(self, units: list[bytes]) -> None:
        """Encode units that are one word to the tokenizer, in small letters: there is nothing to normalise or split, so they go to its model as bytes written in its alphabet."""
        merge, ids, ends = self.tokenizer.model.tokenize, self.ids, self.ends
        for u in units:
            ids.extend([t.id for t in merge(u.decode("latin-1").translate(_ALPHABET))])
            ends.append(len(ids))
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))

    def _encode_parts(self, units: list[bytes]) -> None:
        """Encode any parts side by side, told apart by their offsets."""
        for at in range(0, len(units), 1000):
            some = [u.decode(errors="replace") for u in units[at : at + 1000]]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0, *(len(p) + 1 for p in some)])[:-1]
            offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0]
            stop = np.cumsum(np.bincount(np.searchsorted(begins, offsets, "right") - 1, minlength=len(some)))
            self.ends.frombytes((self.ends[-1] + stop).astype(np.uint64).tobytes())
            self.ids.extend(encoded.ids)
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))

    def encode(self, texts: list[bytes | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text), each text followed by `end`."""
        split = [_open(t).split() if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.units) > self.limits[1]:
            self._forget()
        if len(self.parts) > self.limits[0]:
            self._forget_parts()
        part = np.fromiter(map(self.parts.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(part < 0)
        new = [words[i] for i in missing.tolist()]
        self._learn(list(dict.fromkeys(new)))
        part[missing] = list(map(self.parts.__getitem__, new))
        unit = np.stack([np.frombuffer(self.heads, np.uint32)[part], np.frombuffer(self.tails, np.uint32)[part]], axis=1) if words else np.zeros((0, 2), np.uint32)
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.uint64).astype(np.int64)
        flat_unit = unit[:, 0]
        tailed = np.flatnonzero(unit[:, 1])
        n = np.array([len(s) for s in split])
        edge = np.cumsum(n)
        begins = np.insert(ends[flat_unit], tailed + 1, ends[unit[tailed, 1]])
        lengths = np.insert(ends[flat_unit + 1] - ends[flat_unit], tailed + 1, ends[unit[tailed, 1] + 1] - ends[unit[tailed, 1]])
        total = np.r_[0, np.cumsum(lengths)]
        stop = edge + np.searchsorted(tailed, edge)  # units up to a text's end
        own = np.diff(np.r_[0, total[stop]])
        flat = ids[np.repeat(begins - total[:-1], lengths) + np.arange(total[-1])]
        del ids, ends
        if end is None:
            return flat, own
        at = np.cumsum(own + 1) - 1
        out = np.empty(len(flat) + len(own), np.uint32)
        keep = np.ones(len(out), bool)
        keep[at] = False
        out[keep], out[at] = flat, end
        return out, own + 1


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Writer:
    """One token file."""

    def __init__(self, folder: str, name: str) -> None:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.out = store.open_output_stream(f"{root}/{name}")
        self.out.write(MAGIC)
        self.rest = np.zeros(0, np.uint64)
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[list[int | None], np.ndarray]] = []

    def add(self, docs: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append((docs, lengths))
        self.rest = np.concatenate([self.rest, ids.astype(np.uint64)])
        self._flush(len(self.rest) // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        for at in range(0, n, BLOCK * 256):
            part = self.rest[at : min(n, at + BLOCK * 256)]
            words, n_words, n_escapes = pack(part)
            self.out.write(words.tobytes())
            sizes = np.full(len(n_words), BLOCK)
            if len(sizes):
                sizes[-1] = len(part) - BLOCK * (len(sizes) - 1)
            self.blocks.append((n_words, n_escapes, sizes))
        self.rest = self.rest[n:]

    def close(self) -> None:
        self._flush(len(self.rest))
        join = lambda k, kind: np.concatenate([b[k] for b in self.blocks] or [np.zeros(0)]).astype(kind).tobytes()
        ids = [d for docs, _ in self.docs for d in docs]
        parts = [join(0, "<u4"), join(1, "<u4"), join(2, "<u4"), np.array([d or 0 for d in ids], "<i8").tobytes(), np.array([d is None for d in ids], "u1").tobytes(), np.concatenate([n for _, n in self.docs] or [np.zeros(0)]).astype("<u8").tobytes()]
        head = json.dumps({"block": BLOCK, "parts": [len(p) for p in parts]}).encode()
        footer = len(head).to_bytes(8, "little") + head + b"".join(parts)
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


def read_file(uri: str, span: int = 256) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of whole documents, some blocks at a time."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        n = int.from_bytes(tail[:8], "little")
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        footer = f.read_at(n, size - 16 - n)
        k = int.from_bytes(footer[:8], "little")
        head, at, parts = json.loads(footer[8 : 8 + k]), 8 + k, []
        for x in head["parts"]:
            parts.append(footer[at : at + x])
            at += x
        n_words, n_escapes, sizes = (np.frombuffer(p, "<u4").astype(np.int64) for p in parts[:3])
        docs, nulls, lengths = np.frombuffer(parts[3], "<i8"), np.frombuffer(parts[4], "u1"), np.frombuffer(parts[5], "<u8").astype(np.int64)
        ends = np.cumsum(lengths)
        offsets = len(MAGIC) + 8 * np.r_[0, np.cumsum(n_words + n_escapes)]
        held, have, doc = np.zeros(0, np.uint64), 0, 0
        for a in range(0, len(sizes), span):
            z = min(a + span, len(sizes))
            words = np.frombuffer(f.read_at(int(offsets[z] - offsets[a]), int(offsets[a])), "<u8")
            held = np.concatenate([held, unpack(words, n_words[a:z], n_escapes[a:z], sizes[a:z])])
            upto = int(np.searchsorted(ends, have + len(held), "right"))
            if upto > doc:
                m = int(ends[upto - 1] - have)
                yield [None if x else int(d) for d, x in zip(docs[doc:upto], nulls[doc:upto], strict=True)], lengths[doc:upto], held[:m]
                held, have, doc = held[m:], have + m, upto
        if doc < len(docs):  # only empty documents are left
            yield [None if x else int(d) for d, x in zip(docs[doc:], nulls[doc:], strict=True)], lengths[doc:], held


_MANIFEST = "file string, part int, docs long, ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending id order; the manifest (file, part, docs, ids, start).

    Rows with one id, nulls among them, are dealt out by a hash of their text too.
    Each writing gives other file names, so a task that runs twice leaves an
    unnamed file, never a torn one.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:05d}-{uuid.uuid4().hex}.s8b"
        out, n_docs, n_ids = None, 0, 0
        encoder = _encoder(tokenizer)
        for b in batches:
            out = out or Writer(folder, name)
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            at = 0
            while at < len(texts):  # about 1 MB at a time
                to, size = at, 0
                while to < len(texts) and size < 1 << 20:
                    size += len(texts[to] or b"")
                    to += 1
                flat, lengths = encoder.encode(texts[at:to], end)
                out.add(ids[at:to], flat, lengths)
                n_docs, n_ids, at = n_docs + to - at, n_ids + len(flat), to
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file", "part", "docs", "ids"])

    written = cut(map_batches(dealt, run, _MANIFEST), "tokens-manifest")
    # One row for each file, so one partition holds the running sum.
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return written.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files."""
    files = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, lengths, flat in read_file(file):
                    raw = flat.astype("<u4")
                    ends = np.cumsum(lengths)
                    crc = [zlib.crc32(raw[z - n : z].tobytes()) for z, n in zip(ends, lengths, strict=True)]
                    many = pa.LargeListArray.from_arrays(np.r_[0, ends], pa.array(flat.astype(np.int64))).cast(pa.list_(pa.int64())) if ids else pa.nulls(len(docs), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), many], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    start += int(ends[-1]) if len(ends) else 0

    return map_batches(manifest.select("file", "start").repartition(files, "file"), run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """Write token files under the shared folder; their manifest."""
    return write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer, end)
