"""Exact substring dedup by longest-previous-factor arrays.

A byte goes if a string of `width` bytes that covers it also starts in a document
with a smaller doc_id. Equal strings meet in one group: each string of `width`
bytes has a least hashed 16-gram, consecutive strings with the same one form a
stretch, and stretches are dealt out by it. Every group puts its suffixes in order
(by 8 bytes at a time, each time only what is equal so far) with their longest common prefixes, finds for each the nearest
place before and after it, in suffix order, that stands in a smaller document, and
takes the greater of the two common prefixes: the longest previous factor. Orders
and prefixes are looked at up to `width` bytes, which is all that decides.

Steps, over batches of documents that are dealt out by a hash of doc_id:
 1. each batch lists the hashes of its stretches;
 2. hashes that several documents have are found, by ranges of hash, and among
    them the hot ones that over `fan` batches have in stretches of over `crowd`
    bytes in all;
 3. each batch sends its stretches with such hashes, equal ones of later
    documents in the batch being resolved there and then;
 4. groups of stretches find what earlier documents have; those of a hot hash meet
    `fan` batches at a time, and what is left goes on string by string, dealt out by
    the whole string, to groups of `fan` such groups and so on, of which only the
    earliest of equal ones go on;
 5. batches merge what is covered and cut it out.

Defined cases: null is the empty text. Shorter texts than `width` keep all. Rows
that repeat a doc_id aren't earlier than each other; each is reported. Rows with a null
doc_id lose nothing and are nobody's earlier copy. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH, GRAM = 50, 16
#: Bytes of text in a batch of documents, and in a group of hashes or of stretches.
BATCH, HASHES, STRETCHES = 4 << 20, 32 << 20, 4 << 20
#: Bytes of text that are dealt to one task of a shuffle.
TASK = 16 << 20
#: A hash is hot if more batches than this have it and its stretches have more bytes than CROWD; they meet so many batches at a time.
FAN, CROWD = 1024, 4 << 20
#: Bytes that are hashed at a time.
PIECE = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as little-endian integers."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def least_grams(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each place the least hash of the 16-grams of its `width` bytes, mixed again."""
    eight = _eights(data)
    low = _mix(eight[:-8] * _U(0xD6E8FEB86659FD93) ^ (eight[8:] + _U(0x632BE59BD9B4E019)))
    grams, have = width - GRAM + 1, 1
    while have * 2 <= grams:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < grams:
        low = np.minimum(low[: len(low) - (grams - have)], low[grams - have :])
    return _mix(low)


def stretches(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first place, number of places, hash) of each stretch of places with one least gram."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[int] = []
    size = 0

    def work() -> None:
        data = np.frombuffer(b"".join([texts[i] for i in held]), np.uint8)
        lengths = np.array([len(texts[i]) for i in held])
        ends = np.cumsum(lengths)
        value = least_grams(data, width)
        text = np.repeat(np.arange(len(held)), lengths)[: len(value)]
        valid = np.arange(len(value)) + width <= ends[text]
        first = np.flatnonzero(valid & np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]])
        # A stretch ends where the next one begins or where its text has no more places.
        stop = np.minimum(np.r_[first[1:], len(value)], ends[text[first]] - width + 1)
        out.append((np.array(held)[text[first]], first - (ends - lengths)[text[first]], stop - first, value[first]))

    for i, t in enumerate(texts):
        if len(t) < width:
            continue
        held.append(i)
        size += len(t)
        if size >= PIECE:
            work()
            held, size = [], 0
    if held:
        work()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def suffix_order(data: np.ndarray, places: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes at `places` by their first `width` bytes, ties by document: lcp[k] is what the k-th shares with the one before, width at most."""
    padded = np.r_[data, np.zeros(width + 7, np.uint8)]
    eight = _eights(padded)
    order = np.argsort(head := eight[places].byteswap())
    apart = np.r_[True, head[order][1:] != head[order][:-1]][: len(order)]
    # Most suffixes differ in their first 8 bytes; only what is equal so far is sorted by the next ones.
    for k in range(8, width, 8):
        at = np.flatnonzero(~(apart & np.r_[apart, True][1:]))
        word = eight[places[order[at]] + k].byteswap() >> _U(8 * max(0, k + 8 - width))
        by = np.lexsort((word, np.cumsum(apart)[at]))
        order[at], word = order[at][by], word[by]
        apart[at[1:]] |= word[1:] != word[:-1]
    tied = np.flatnonzero(~(apart & np.r_[apart, True][1:]))
    order[tied] = order[tied][np.lexsort((doc[order[tied]], np.cumsum(apart)[tied]))]
    lcp = np.where(apart, 0, width)
    open_ = np.flatnonzero(apart[1:]) + 1
    a, b = places[order[open_ - 1]], places[order[open_]]
    for k in range(0, width, 8):
        differ = eight[a + k] ^ eight[b + k]
        low = differ & (_U(0) - differ)  # its lowest bit, whose byte is the first that differs
        lcp[open_] = np.minimum(k + np.bitwise_count(low - _U(1)) // 8, width)
        a, b, open_ = a[differ == 0], b[differ == 0], open_[differ == 0]
    return order, lcp


def smaller_before(doc: np.ndarray, lcp: np.ndarray, enough: int = 1) -> np.ndarray:
    """For each place in suffix order what it shares with the nearest place before it of a smaller document; 0 where that is less than `enough`."""
    to, low = np.arange(len(doc)) - 1, lcp.copy()
    open_ = np.flatnonzero(low >= enough)
    while True:  # a place that is no smaller hands on where it looks itself
        open_ = open_[(to[open_] >= 0) & (low[open_] >= enough)]
        open_ = open_[doc[to[open_]] >= doc[open_]]
        if not len(open_):
            break
        at = to[open_]
        low[open_], to[open_] = np.minimum(low[open_], low[at]), to[at]
    return np.where((to >= 0) & (low >= enough), low, 0)


def previous_factors(data: np.ndarray, places: np.ndarray, doc: np.ndarray, width: int = WIDTH, enough: int = 1) -> np.ndarray:
    """The longest previous factor at each place: the most bytes, width at most, that it shares with a place of a smaller document; 0 for less than `enough`."""
    order, lcp = suffix_order(data, places, doc, width)
    own = doc[order]
    before = smaller_before(own, lcp, enough)
    after = smaller_before(own[::-1], np.r_[0, lcp[1:][::-1]], enough)[::-1]
    out = np.zeros(len(places), np.int64)
    out[order] = np.maximum(before, after)
    return out


def earlier(data: np.ndarray, places: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether the longest previous factor at each place has `width` bytes."""
    return previous_factors(data, places, doc, width, width) >= width if len(places) else np.zeros(0, bool)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] places each."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - np.r_[0, ends[:-1]], lengths) + np.arange(ends[-1] if len(ends) else 0)


def _rows(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """A batch in its own order, by doc_id and text."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), (t or b"" for t in table.column("text").to_pylist()), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _hashes(docs: list[int | None], texts: list[bytes], n: int, width: int):
    """Stretches of documents with an id, their distinct hashes by group, and each stretch's among them."""
    text, first, count, value = stretches([b"" if d is None else t for d, t in zip(docs, texts, strict=True)], width)
    known, which = np.unique(value, return_inverse=True)
    order = np.lexsort((known & _U(0xFFFFFFFF), (known >> _U(32)) % _U(n)))
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    known, which = known[order], place[which]
    return text, first, count, value, known, which


#: Bytes of a hash's stretches in a batch, as four times their binary logarithm, rounded up.
_LISTED = "grp int, batch int, hashes binary, several binary, sizes binary"
_SHARED = "batch int, grp int, bits binary, hot binary"
_SENT = "grp int, batch int, docs binary, rows binary, starts binary, lengths binary, data binary, entries binary"
#: Of a row: a group (negative: of strings of hot hashes), what it sends, or with no data the spans that are known to go.
_RESOLVED = _SENT


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _list(n: int, width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        docs, texts = _rows(table)
        text, _, count, _, known, which = _hashes(docs, texts, n, width)
        sizes = np.ceil(4 * np.log2(np.bincount(which, count + width - 1, len(known)))).astype(np.uint8)
        ids = np.array([d or 0 for d in docs], np.int64)[text]
        low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        several = low < high
        grp = ((known >> _U(32)) % _U(n)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else np.zeros(0, int)
        rows = [
            (int(grp[a]), key[0].as_py(), (known[a:z] & _U(0xFFFFFFFF)).astype("<u4").tobytes(), np.packbits(several[a:z]).tobytes(), sizes[a:z].tobytes())
            for a, z in zip(edge, np.r_[edge[1:], len(grp)], strict=False)
        ]
        return _table(_LISTED, rows)

    return run


def _share(fan: int, crowd: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table.column("hashes").to_pylist()
        sizes = np.array([len(b) // 4 for b in blobs])
        values = np.frombuffer(b"".join(blobs), "<u4")
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(table.column("several").to_pylist(), sizes, strict=True)]).astype(bool)
        known, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
        size = np.exp2(np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.uint8) / 4)
        shared, hot = several | (times > 1)[inverse], ((times > fan) & (np.bincount(inverse, size, len(known)) > crowd))[inverse]
        ends = np.cumsum(sizes)
        return _table(_SHARED, [(b, key[0].as_py(), np.packbits(shared[z - n : z]).tobytes(), np.packbits(hot[z - n : z]).tobytes()) for b, n, z in zip(table.column("batch").to_pylist(), sizes, ends, strict=True) if shared[z - n : z].any()])

    return run


def _strings(batch: int, texts: list[bytes], docs: np.ndarray, rows: np.ndarray, starts: np.ndarray, groups: int, width: int) -> list[tuple]:
    """The strings of `width` bytes of some stretches of one batch, in rows of _SENT; no smaller document of the batch has them."""
    size = np.array([len(t) for t in texts])
    count, data = size - width + 1, np.frombuffer(b"".join(texts), np.uint8)
    at = _spread(np.cumsum(size) - size, count)
    known, which = np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[at]).view(f"V{width}").reshape(-1), return_inverse=True)
    owner, place = np.repeat(np.arange(len(texts)), count), _spread(starts, count)
    # A run of one string (of blanks, say) is one entry; of a string that several rows have all are entries.
    begin = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (owner[1:] != owner[:-1])])
    which, owner, place, length = which[begin], owner[begin], place[begin], np.diff(np.r_[begin, len(which)])
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs[owner])
    order = np.argsort(which, kind="stable")
    entries = np.bincount(which, minlength=len(known))
    raw = known.view(np.uint8).reshape(len(known), width)
    hashed = np.zeros(len(known), _U)
    for k in range(0, width, 8):
        hashed = _mix(hashed ^ np.ascontiguousarray(np.pad(raw[:, k : k + 8], ((0, 0), (0, max(0, k + 8 - width))))).view("<u8").reshape(-1))
    grp = (hashed % _U(groups)).astype(np.int64)
    edge = np.r_[0, np.cumsum(entries)]
    out = []
    by = np.argsort(grp, kind="stable")
    cuts = np.flatnonzero(np.r_[True, grp[by][1:] != grp[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    for a, z in zip(cuts, np.r_[cuts[1:], len(by)], strict=False):
        some = by[a:z]
        mine = order[_spread(edge[some], entries[some])]
        out.append((-1 - int(grp[some[0]]), batch, least[some].astype("<i8").tobytes(), *(x.astype("<u4").tobytes() for x in (rows[owner[mine]], place[mine], length[mine])), raw[some].tobytes(), entries[some].astype("<u4").tobytes()))
    return out


def _send(n: int, groups: int, width: int):
    """Stretches to groups, negative ones where the hash is hot; with no data what is resolved already."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_SENT, [])
        batch = left.column("batch")[0].as_py()
        docs, texts = _rows(left)
        text, first, count, value, known, which = _hashes(docs, texts, n, width)
        shared, hot = np.zeros(len(known), bool), np.zeros(len(known), bool)
        grp = ((known >> _U(32)) % _U(n)).astype(np.int64)
        for g, *bits in zip(*(right.column(c).to_pylist() for c in ("grp", "bits", "hot")), strict=True):
            a, z = np.searchsorted(grp, [g, g + 1])
            for flags, b in zip((shared, hot), bits, strict=True):
                flags[a:z] = np.unpackbits(np.frombuffer(b, np.uint8))[: z - a]
        on = np.flatnonzero(shared[which])
        seen: dict[bytes, int] = {}
        parts: dict[int, list[int]] = {}
        done: list[tuple[int, int, int]] = []
        cuts: dict[int, bytes] = {}
        to = ((value[on] >> _U(24)) % _U(groups)).tolist()
        for i, g, h, t, p, c in zip(on.tolist(), to, hot[which[on]].tolist(), text[on].tolist(), first[on].tolist(), count[on].tolist(), strict=True):
            data = texts[t][p : p + c + width - 1]
            before = seen.setdefault(data, docs[t])
            if before < docs[t]:
                done.append((t, p, c))
            else:
                cuts[i] = data
                parts.setdefault(-1 - g if h else g, []).append(i)
        ids = np.array([d or 0 for d in docs], "<i8")
        rows = [(g, batch, ids[text[own]].tobytes(), text[own].astype("<u4").tobytes(), first[own].astype("<u4").tobytes(), count[own].astype("<u4").tobytes(), b"".join([cuts[i] for i in own]), None) for g, own in parts.items()]
        if done:  # already known to go: passed on with no text
            t, p, c = (np.array(x, "<u4") for x in zip(*done, strict=True))
            rows.append((batch % groups, batch, b"", t.tobytes(), p.tobytes(), c.tobytes(), b"", None))
        return _table(_SENT, rows)

    return run


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of flags with one owner."""
    first = np.flatnonzero(flags & np.r_[True, ~flags[:-1] | (owner[1:] != owner[:-1])])
    last = np.flatnonzero(flags & np.r_[~flags[1:] | (owner[1:] != owner[:-1]), True])
    return first, last - first + 1


def _find(columns: dict[str, list], full: list[int], width: int, groups: int | None = None) -> list[tuple]:
    """Spans that go of the stretches in rows `full`, which are one group's; with `groups` also the strings that are left, dealt out anew."""
    docs = np.frombuffer(b"".join([columns["docs"][i] for i in full]), "<i8")
    rows, starts, counts = (np.frombuffer(b"".join([columns[c][i] for i in full]), "<u4").astype(np.int64) for c in ("rows", "starts", "lengths"))
    source = np.repeat(full, [len(columns["docs"][i]) // 8 for i in full])
    data = b"".join([columns["data"][i] for i in full])
    ends = np.cumsum(counts + width - 1)
    begin = ends - (counts + width - 1)
    # Equal stretches meet here: one stands for all, with the least document; later ones go whole.
    text_of: dict[bytes, int] = {}
    same = np.array([text_of.setdefault(data[a:z], len(text_of)) for a, z in zip(begin.tolist(), ends.tolist(), strict=True)])
    least = np.full(len(text_of), np.iinfo(np.int64).max)
    np.minimum.at(least, same, docs)
    one = np.zeros(len(text_of), np.int64)
    one[same] = np.arange(len(same))
    whole = docs > least[same]
    sizes = counts[one]
    joined = np.frombuffer(b"".join(text_of), np.uint8)
    places = _spread(np.cumsum(sizes + width - 1) - (sizes + width - 1), sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    gone = earlier(joined, places, least[piece], width)
    first, length = _runs(gone, piece)
    into = first - (np.cumsum(sizes) - sizes)[piece[first]]
    # The runs of a text hold for each stretch that has it in its least document.
    owner = piece[first]
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    stays = np.flatnonzero(~whole)
    n_runs = (edges[1:] - edges[:-1])[same[stays]]
    pick = _spread(edges[same[stays]], n_runs)
    own = np.concatenate([np.repeat(stays, n_runs), np.flatnonzero(whole)])
    at = starts[own] + np.concatenate([into[pick], np.zeros(whole.sum(), np.int64)])
    length = np.concatenate([length[pick], counts[whole]])
    order = np.argsort(source[own], kind="stable")
    cuts = np.searchsorted(source[own][order], [*full, full[-1] + 1])
    out = []
    for i, a, z in zip(full, cuts, cuts[1:], strict=False):
        if z > a:
            mine = order[a:z]
            out.append((-1 - i, columns["batch"][i], b"", *(x.astype("<u4").tobytes() for x in (rows[own[mine]], at[mine], length[mine])), b"", None))
    if groups is None:
        return out
    left, size = _runs(~gone, piece)  # runs of places that no smaller document here has
    owner, into = piece[left], left - (np.cumsum(sizes) - sizes)[piece[left]]
    edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
    for i in full:
        mine = stays[source[stays] == i]
        runs = _spread(edges[same[mine]], (edges[1:] - edges[:-1])[same[mine]])
        own = np.repeat(mine, (edges[1:] - edges[:-1])[same[mine]])
        if len(runs):
            a = begin[own] + into[runs]
            texts = [data[x : x + n + width - 1] for x, n in zip(a.tolist(), size[runs].tolist(), strict=True)]
            out += _strings(columns["batch"][i], texts, docs[own], rows[own], starts[own] + into[runs], groups, width)
    return out


def _meet(columns: dict[str, list], full: list[int], width: int, last: bool) -> list[tuple]:
    """Of the strings in rows `full`: spans of those that earlier documents have, and the rest, to go on to the next level."""
    docs = [np.frombuffer(columns["docs"][i], "<i8") for i in full]
    data = np.frombuffer(b"".join([columns["data"][i] for i in full]), np.uint8)
    every = np.concatenate(docs)
    gone = earlier(data, np.arange(len(every)) * width, every, width)
    out: list[tuple] = []
    for i, own, g in zip(full, docs, np.split(gone, np.cumsum([len(d) for d in docs])[:-1]), strict=True):
        entries = np.frombuffer(columns["entries"][i], "<u4")
        goes = np.repeat(g, entries)
        grp, batch, places = columns["grp"][i], columns["batch"][i], [np.frombuffer(columns[c][i], "<u4") for c in ("rows", "starts", "lengths")]
        if goes.any():
            out.append((grp, batch, b"", *(x[goes].tobytes() for x in places), b"", None))
        if not last and not g.all():
            texts = np.frombuffer(columns["data"][i], np.uint8).reshape(-1, width)
            out.append((grp, batch, own[~g].tobytes(), *(x[~goes].tobytes() for x in places), texts[~g].tobytes(), entries[~g].tobytes()))
    return out


def _resolve(width: int, groups: int, last: bool):
    """One group's stretches and strings; spans that are known to go pass."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("grp", "batch", "docs", "rows", "starts", "lengths", "data", "entries")}
        out = [tuple(columns[c][i] for c in columns) for i, t in enumerate(columns["data"]) if not t]
        stretched = [i for i, (t, e) in enumerate(zip(columns["data"], columns["entries"], strict=True)) if t and e is None]
        strings = [i for i, (t, e) in enumerate(zip(columns["data"], columns["entries"], strict=True)) if t and e is not None]
        # What a hot hash leaves goes on string by string.
        out += _find(columns, stretched, width, None if last or columns["grp"][stretched[0]] >= 0 else groups) if stretched else []
        out += _meet(columns, strings, width, last) if strings else []
        return _table(_RESOLVED, out)

    return run


def merge_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of what the spans [start, stop) cover."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    a, z = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, a[1:] > z[:-1]]
    return list(zip(a[new].tolist(), z[np.r_[np.flatnonzero(new)[1:] - 1, len(z) - 1]].tolist(), strict=True))


_RESULT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_RESULT_SQL = "doc_id long, spans array<struct<start:long,stop:long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(width: int, texts_out: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, texts = _rows(left)
        blobs = {c: np.frombuffer(b"".join(right.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("rows", "starts", "lengths")}
        order = np.argsort(blobs["rows"], kind="stable")
        edges = np.searchsorted(blobs["rows"][order], np.arange(len(docs) + 1))
        out = []
        for i, (d, t) in enumerate(zip(docs, texts, strict=True)):
            own = order[edges[i] : edges[i + 1]]
            spans = merge_spans(blobs["starts"][own], blobs["starts"][own] + blobs["lengths"][own] + width - 1)
            kept, at = [], 0
            for a, z in spans:
                kept.append(t[at:a])
                at = z
            rest = b"".join([*kept, t[at:]])
            out.append({"doc_id": d, "spans": [{"start": a, "stop": z} for a, z in spans], "n_bytes": len(t), "n_removed": len(t) - len(rest), "n_spans": len(spans), "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest if texts_out else None})
        return pa.Table.from_pylist(out, _RESULT)

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, texts: bool = True, fan: int = FAN, batch: int = BATCH, crowd: int = CROWD) -> DataFrame:
    """For every row: doc_id, spans [start, stop) of bytes removed, counts, the SHA-256 of what is kept and (with texts) the bytes kept."""
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} at least")
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_batches, n_hash, n_groups, tasks = (max(part, -(-total // x)) for x in (batch, HASHES, STRETCHES, TASK))
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    dealt = lambda df, by: df.repartition(tasks, by).groupBy(by)
    listed = dealt(rows, "batch").applyInArrow(_list(n_hash, width), _LISTED)
    shared = dealt(listed, "grp").applyInArrow(_share(fan, crowd), _SHARED)
    sent = dealt(rows, "batch").cogroup(dealt(shared, "batch")).applyInArrow(_send(n_hash, n_groups, width), _SENT)
    over = fan
    while True:
        meet = F.when(F.col("grp") >= 0, F.col("grp")).otherwise(F.xxhash64("grp", F.floor(F.col("batch") / over)))
        sent = dealt(sent.withColumn("meet", meet), "meet").applyInArrow(_resolve(width, n_groups, over >= n_batches), _RESOLVED)
        if over >= n_batches:
            break
        over *= fan
    spans = sent.select("batch", "rows", "starts", "lengths")
    return dealt(rows, "batch").cogroup(dealt(spans, "batch")).applyInArrow(_cut(width, texts), _RESULT_SQL)
