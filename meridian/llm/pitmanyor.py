"""Language-model scores from a hierarchical Pitman-Yor model.

Each word context is a restaurant whose customers are the words that follow it
and whose tables send one customer each to the parent restaurant that all
contexts share; that one's base is even over the vocabulary and one unseen word.
Seatings are sampled by Gibbs, all customers of a dish at once: given the parent
and the tables of the other dishes, a dish of c customers has t tables with a chance
that generalised Stirling numbers give. They are tabled up to MANY customers; beyond,
the process that opens tables is run on as a pure birth process from the MANY-th
customer to the c-th, which has a closed form and differs from single steps by
about 1 / MANY. Contexts are sampled in rounds against a fixed parent, then the
parent against their tables; predictive probabilities are means over the last
sweeps of both. The dishes of one restaurant are redrawn together, each against the
others' tables of the sweep before. Discounts come from the counts of counts.

The corpus' counts are dealt out in packed arrays: batches of documents list
their words to word groups, which number them and answer; batches then list
their word pairs to pair groups, which count and seat them. Pairs of a very
frequent context are spread over several groups, which tell each other their
tables between rounds. Text is scored the same way round, so no model is sent to
all tasks. Words are numbered with 64 bits.

Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; each document ends with one end token,
which is also the first word's context. Documents whose crc32(doc_id as text) mod
10 is 0 are held out.

Defined cases: a null or empty text is the end token alone. A null doc_id is
trained on. Rows that repeat a doc_id all count. With no training tokens every
word is unseen. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import LOWER, cut, discard, free, map_batches

#: Bytes of text in a batch of documents and in a group of words or pairs.
BATCH, GROUP = 6 << 20, 12 << 20
PIECE = 1 << 20
#: A context is spread over one more group for each so many tokens.
HOT = 1 << 19
#: Stirling numbers are tabled to so many customers.
MANY = 512
CONCENTRATION = 1.0
SWEEPS, KEPT = 3, 2

_U = np.uint64
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
END = _U(0x8F1BBCDC5A827999)
_RADIX, _BACK = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.frombuffer(LOWER, np.uint8)
    return _mix(np.arange(1, 257, dtype=_U))[lower], lower, np.isin(np.arange(256), [32, *range(9, 14)])


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[_U(1), np.full(n, base, _U)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and the end of every text, tokens of each text); a word's hash is a polynomial in its bytes, mixed."""
    value, _, blank = _tables()
    out: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < PIECE):
            size += len(texts[to]) + 1
            to += 1
        data = np.frombuffer(b" ".join([*texts[at:to], b""]), np.uint8)
        n = 1 << (len(data).bit_length())
        total = np.r_[_U(0), np.cumsum(value[data] * _powers(_RADIX, n)[: len(data)])]
        edge = np.flatnonzero(np.diff(np.r_[True, blank[data], True].astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        hashed = _mix((total[stop] - total[begin]) * _powers(_BACK, n)[begin] + (stop - begin).astype(_U))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        own = np.searchsorted(begin, ends)
        out.append(np.insert(hashed, own, END))
        counts[at:to] = np.diff(np.r_[0, own]) + 1
        at = to
    return (np.concatenate(out) if out else np.zeros(0, _U)), counts


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _planes(x: np.ndarray) -> bytes:
    """An array byte by byte place, so that equal high bytes stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def _unplane(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _column(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of packed arrays, values in each row)."""
    parts = [np.frombuffer(x or b"", kind) for x in table.column(name).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def _packed(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """_column() of arrays that were laid out by _planes()."""
    parts = [_unplane(x or b"", kind) for x in table.column(name).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def _by_group(group: np.ndarray, groups: int) -> np.ndarray:
    """Stable order by group; numbers of 16 bits are sorted by radix."""
    return np.argsort(group.astype(np.uint16) if groups < 1 << 16 else group, kind="stable")


class Batch:
    """The tokens of one batch: hashes, which documents train, and the distinct words by group."""

    def __init__(self, table: pa.Table, groups: int) -> None:
        ids, known = _column(table, "ids", "<i8")[0], _column(table, "known", "?")[0]
        self.doc_ids, self.held = pa.array(ids, pa.int64(), mask=~known), _column(table, "held", "?")[0]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts: list[bytes] = []
        size, last = 0, table.num_rows - 1
        for row, (data, lengths) in enumerate(zip(table.column("data"), table.column("lengths"), strict=True)):  # some texts are open at a time
            ends = np.cumsum(np.frombuffer(lengths.as_py(), "<u4"), dtype=np.int64)
            joined = pa.decompress(data.as_buffer(), int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
            texts += [joined[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            size += len(joined)
            if size >= PIECE or row == last:
                parts.append(word_hashes(texts))
                texts, size = [], 0
        hashes, self.counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        self.train = np.repeat(~self.held, self.counts)
        known, inverse = np.unique(hashes, return_inverse=True)
        group = (known >> _U(40)) % _U(groups)
        order = np.argsort(group, kind="stable")
        self.words, self.groups = known[order], group[order].astype(np.int64)
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known), dtype=np.int32)
        self.which = place[inverse]
        del hashes, inverse
        self.times = np.bincount(self.which[self.train], minlength=len(known))
        ends = np.cumsum(self.counts)
        self.end = int(self.which[ends[0] - 1]) if len(ends) else 0
        self.context = np.r_[self.end, self.which[:-1]]
        self.context[(ends - self.counts)] = self.end
        self.starts = ends - self.counts
        pa.default_memory_pool().release_unused()

    def split(self) -> list[tuple[int, slice]]:
        """(group, its distinct words)."""
        edge = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]])
        return [(int(self.groups[a]), slice(a, z)) for a, z in zip(edge, np.r_[edge[1:], len(self.groups)], strict=False)]

    def fill(self, answers: pa.Table, names: dict[str, str]) -> dict[str, np.ndarray]:
        """What the word groups answered, in the order of the distinct words."""
        out = {k: np.zeros(len(self.words), kind) for k, kind in names.items()}
        at = dict(self.split())
        for row in answers.select(["grp", *names]).to_pylist():
            for k, kind in names.items():
                out[k][at[row["grp"]]] = _unplane(row[k], kind)
        return out

    def pairs(self, ids: np.ndarray, times: np.ndarray, groups: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of known words, by group: their contexts and words among the distinct words, training counts, groups, for each token its pair or -1, and over how many groups a pair's context is spread."""
        known = (ids[self.context] != NONE) & (ids[self.which] != NONE)
        code = self.context[known].astype(_U) << _U(32) | self.which[known].astype(_U)
        codes, inverse = np.unique(code, return_inverse=True)
        count = np.bincount(inverse[self.train[known]], minlength=len(codes))
        u, w = (codes >> _U(32)).astype(np.int64), (codes & _U(0xFFFFFFFF)).astype(np.int64)
        shares = 1 + times[u].astype(np.int64) // hot
        part = np.where(shares > 1, _mix(ids[w]) % shares.astype(_U), _U(0))
        group = (_mix(ids[u] * _U(31) + part) % _U(groups)).astype(np.int64)
        order = _by_group(group, groups)
        place = np.empty(len(codes), np.int32)
        place[order] = np.arange(len(codes), dtype=np.int32)
        token = np.full(len(self.which), -1, np.int64)
        token[known] = place[inverse]
        return u[order], w[order], count[order], group[order], token, shares[order]


_PACKED = "batch int, ids binary, known binary, held binary, lengths binary, data binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by batch, their texts joined and compressed, which halves what is dealt out."""
    for b in batches:
        batch = b.column(0).to_numpy()
        texts = [t or b"" for t in b.column(3).to_pylist()]
        ids, known, held = b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(batch, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(batch[order]) != 0])
        rows = []
        for a, z in zip(edge, np.r_[edge[1:], len(order)], strict=True):
            own = order[a:z]
            mine = [texts[i] for i in own]
            joined = b"".join(mine)
            lengths = np.array([len(t) for t in mine], "<u4").tobytes()
            rows.append((int(batch[own[0]]), ids[own].astype("<i8").tobytes(), known[own].tobytes(), held[own].tobytes(), lengths, pa.compress(joined, codec="zstd", asbytes=True) if joined else b""))
        yield from _table(_PACKED, rows).to_batches() if len(order) else ()


_LISTED = "grp int, batch int, hashes binary, times binary"
_NUMBERED = "batch int, grp int, ids binary, times binary, chance binary, tables binary"
_PAIRED = "grp int, batch int, first binary, runs binary, second binary, times binary, hot binary"
#: Messages by kind. 0: a pair group's pairs seen twice or more. 1: words to their groups, with their contexts. 2: chances of words. 3: tables of a
#: pair group's pairs. 4: tables to words, or at last to contexts. 5: a word group's chances for a pair group. 6: tables of spread contexts to their
#: groups. 7: their sums back.
_COUNTED = "kind int, grp int, source int, a binary, b binary, c binary, d binary, e binary, n long, once long, twice long"


def _list(groups: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = Batch(table, groups)
        return _table(_LISTED, [(g, key[0].as_py(), b.words[s].tobytes(), _planes(b.times[s].astype("<u4"))) for g, s in b.split()])

    return run


def _number(table: pa.Table, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and training counts of all hashes in the rows of one group, and where each row ends: often seen words have low ids."""
    grp = table.column("grp")[0].as_py()
    hashes, sizes = _column(table, "hashes", "<u8")
    times = np.concatenate([_unplane(x, "<u4") for x in table.column("times").to_pylist()]).astype(np.int64)
    known, inverse = np.unique(hashes, return_inverse=True)
    total = np.bincount(inverse, weights=times, minlength=len(known)).astype(np.int64)
    order = np.lexsort((known, -total))
    ids = np.empty(len(known), _U)
    ids[order] = np.arange(len(known), dtype=_U) * _U(groups) + _U(grp)
    ids[total == 0] = NONE
    return ids[inverse], total[inverse], np.cumsum(sizes)


def _answer(table: pa.Table, ids: np.ndarray, times: np.ndarray, ends: np.ndarray, chance: np.ndarray, tables: np.ndarray) -> pa.Table:
    rows, at = [], 0
    for batch, grp, z in zip(table.column("batch").to_pylist(), table.column("grp").to_pylist(), ends.tolist(), strict=True):
        s = slice(at, z)
        rows.append((batch, grp, *(_planes(x[s]) for x in (ids.astype("<u8"), times.astype("<u8"), chance.astype("<f4"), tables.astype("<f4")))))
        at = z
    return _table(_NUMBERED, rows)


def _number_only(groups: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, times, ends = _number(table, groups)
        none = np.zeros(len(ids))
        return _answer(table, ids, times, ends, none, none)

    return run


def _number_with_model(groups: int, unseen: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_NUMBERED, [])
        ids, times, ends = _number(left, groups)
        chance, tables = np.full(len(ids), unseen), np.zeros(len(ids))
        kinds = np.array(right.column("kind").to_pylist())
        for kind, form, out in ((2, "<f8", chance), (4, "<f4", tables)):
            part = right.filter(pa.array(kinds == kind))
            own, value = _packed(part, "a", "<u8")[0], _column(part, "b", form)[0]
            if not len(own):
                continue
            # Each pair group that seats some of a context's dishes has its part of the tables.
            known, inverse = np.unique(own, return_inverse=True)
            total = np.bincount(inverse, weights=value, minlength=len(known))
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            hit = (known[at] == ids) & (ids != NONE)
            out[hit] = total[at[hit]]
        return _answer(left, ids, times, ends, chance, tables)

    return run


def _pair(groups: int, hot: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_PAIRED, [])
        b, batch = Batch(left, groups), left.column("batch")[0].as_py()
        got = b.fill(right, {"ids": "<u8", "times": "<u8"})
        u, w, count, group, _, shares = b.pairs(got["ids"], got["times"], groups, hot)
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
        rows = []
        for a, z in zip(edge, np.r_[edge[1:], len(group)], strict=False):
            head = np.flatnonzero(np.r_[True, np.diff(u[a:z]) != 0])
            contexts = got["ids"][u[a:z][head]]
            rows.append((int(group[a]), batch, _planes(contexts), _planes(np.diff(np.r_[head, z - a]).astype("<u4")), _planes(got["ids"][w[a:z]]), _planes(count[a:z].astype("<u4")), contexts[shares[a:z][head] > 1].tobytes()))
        return _table(_PAIRED, rows)

    return run


class Pairs:
    """The distinct pairs of one pair group: contexts and words (sorted ids), codes of pairs by their places there, and for each listed pair its code's place."""

    def __init__(self, table: pa.Table) -> None:
        heads, sizes = _packed(table, "first", "<u8")
        runs = _packed(table, "runs", "<u4")[0].astype(np.int64)
        second, _ = _packed(table, "second", "<u8")
        self.contexts, u = np.unique(heads, return_inverse=True)
        self.words, w = np.unique(second, return_inverse=True)
        self.codes, self.inverse = np.unique(np.repeat(u, runs).astype(_U) << _U(32) | w.astype(_U), return_inverse=True)
        self.count = np.bincount(self.inverse, weights=_packed(table, "times", "<u4")[0], minlength=len(self.codes)).astype(np.int64)
        self.ends = np.add.reduceat(np.r_[runs, 0], np.r_[0, np.cumsum(sizes)[:-1]]).cumsum() if len(sizes) else np.zeros(0, np.int64)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of the codes of pairs that are here."""
        return np.searchsorted(self.codes, np.searchsorted(self.contexts, contexts).astype(_U) << _U(32) | np.searchsorted(self.words, words).astype(_U))


def _to_words(ids: np.ndarray, value: np.ndarray, groups: int, kind: int, source: int, dtype: str) -> list[tuple]:
    """Messages with sums by word id to the ids' groups."""
    known, inverse = np.unique(ids, return_inverse=True)
    total = np.bincount(inverse, weights=value, minlength=len(known))
    grp = (known % _U(groups)).astype(np.int64)
    order = np.argsort(grp, kind="stable")
    known, total = known[order], total[order]
    edge = np.searchsorted(grp[order], np.arange(groups + 1))
    return [(kind, g, source, _planes(known[a:z]), total[a:z].astype(dtype).tobytes(), b"", b"", b"", 0, 0, 0) for g, (a, z) in enumerate(zip(edge, edge[1:], strict=False)) if z > a]


def _count(groups: int):
    """Kind 0: pairs seen twice or more with their counts, and how many pairs seen once each context has. Kind 1: contexts of each word. Kind 6: dishes of spread contexts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = Pairs(table)
        seen, grp = np.flatnonzero(p.count), key[0].as_py()
        if not len(seen):
            return _table(_COUNTED, [])
        u, w, count = p.contexts[p.codes[seen] >> _U(32)], p.words[p.codes[seen] & _U(0xFFFFFFFF)], p.count[seen]
        many = count > 1
        single, n_single = np.unique(u[~many], return_counts=True)
        spread = np.intersect1d(_column(table, "hot", "<u8")[0], u)
        state = (0, grp, grp, _planes(u[many]), _planes(w[many]), _planes(count[many].astype("<u8")), np.concatenate([single, n_single.astype(_U)]).tobytes(), spread.tobytes(), int(count.sum()), int((~many).sum()), int((count == 2).sum()))
        hot = np.isin(u, spread)
        return _table(_COUNTED, [state, *_to_words(w, np.ones(len(w)), groups, 1, grp, "<f4"), *_to_words(u[hot], np.ones(hot.sum()), groups, 6, grp, "<f8")])

    return run


@cache
def stirling(discount: float, many: int = MANY) -> np.ndarray:
    """Logs of generalised Stirling numbers of c customers at t tables, [c, t]."""
    out = np.full((many + 1, many + 1), -np.inf)
    out[1, 1] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, many):
            t = np.arange(1, c + 2)
            out[c + 1, t] = np.logaddexp(out[c, t - 1], np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, t])
    return out


def seat(c: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, rng: np.random.Generator, concentration: float = CONCENTRATION, many: int = MANY) -> np.ndarray:
    """Table counts of dishes of c customers, given the chance the parent gives each and the tables of their restaurant's other dishes.

    The chance of t tables goes with S(c, t) times the product of base (concentration
    + discount (others + i)) over i < t. Past `many` customers each table is one of
    those that the first `many` opened, or has come since: the former are drawn as
    for `many` customers with what the latter sum to as a factor, then the latter,
    which are negative binomial.
    """
    out = np.ones(len(c), np.int64)
    table = stirling(discount, many)
    first = np.minimum(c, many)
    apart = (first / np.maximum(c, 1)) ** discount
    since = base * (1 - apart)
    log_base = np.log(base * apart / (1 - since))
    order = np.argsort(first, kind="stable")
    edge = np.searchsorted(first[order], np.arange(2, many + 2))
    for k in np.flatnonzero(np.diff(edge)) + 2:
        own = order[edge[k - 2] : edge[k - 1]]
        step = max(1, (1 << 22) // int(k))
        for a in range(0, len(own), step):
            some = own[a : a + step]
            weight = np.log(concentration + discount * (others[some][:, None] + np.arange(k))) + log_base[some][:, None]
            logs = np.cumsum(weight, axis=1) + table[k, 1 : k + 1]
            share = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (share < (rng.random(len(some)) * share[:, -1])[:, None]).sum(axis=1)
    late = np.flatnonzero(c > many)
    if len(late) and discount > 0:
        out[late] += rng.negative_binomial(out[late] + others[late] + concentration / discount, 1 - since[late])
    return np.minimum(out, np.maximum(c, 1))


def _totals(state: dict, tables: np.ndarray) -> np.ndarray:
    """Tables of each context in this group."""
    return np.bincount(state["context"], weights=tables, minlength=len(state["contexts"])) + state["single"]


def _sweep(state: dict, base: np.ndarray, tables: np.ndarray, away: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    whole = (_totals(state, tables) + away)[state["context"]]
    return seat(state["count"], base, np.maximum(whole - tables, 0), discount, rng)


def _state(row: dict) -> dict:
    u, single = _unplane(row["a"], "<u8"), np.frombuffer(row["d"], "<u8").reshape(2, -1)
    contexts = np.union1d(u, single[0])
    lone = np.zeros(len(contexts))
    lone[np.searchsorted(contexts, single[0])] = single[1]
    spread = np.searchsorted(contexts, np.frombuffer(row["e"], "<u8"))
    return {"count": _unplane(row["c"], "<u8").astype(np.int64), "contexts": contexts, "context": np.searchsorted(contexts, u), "single": lone, "spread": spread, "pair_context": u, "word": _unplane(row["b"], "<u8")}


def _rows(table: pa.Table, kind: int) -> list[dict]:
    return [r for r in table.to_pylist() if r["kind"] == kind]


def _chances(words: np.ndarray, table: pa.Table) -> np.ndarray:
    ids, value = _packed(table, "a", "<u8")[0], _column(table, "b", "<f8")[0]
    order = np.argsort(ids)
    return value[order][np.searchsorted(ids[order], words)]


def _gibbs(groups: int, discount: float, seed: int, last: bool):
    """Sweeps over one pair group. Kind 3: tables (or, last, customers less discounts, averaged). Kind 4: to the words (or, last, the contexts)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        states = _rows(left, 0)
        if not states:
            return _table(_COUNTED, [])
        state, grp = _state(states[0]), states[0]["grp"]
        rng = np.random.default_rng([seed, int(last), grp])
        kinds = np.array(right.column("kind").to_pylist())
        base = _chances(state["word"], right.filter(pa.array(kinds == 5))) if len(state["word"]) else np.zeros(0)
        before = _rows(left, 3)
        tables = np.frombuffer(before[0]["a"], "<u4").astype(np.int64) if before else np.ones(len(base), np.int64)
        away = np.zeros(len(state["contexts"]))  # tables of spread contexts in other groups
        if len(state["spread"]):
            away[state["spread"]] = _chances(state["contexts"][state["spread"]], right.filter(pa.array(kinds == 7))) - _totals(state, tables)[state["spread"]]
        kept = np.zeros(len(base))
        for sweep in range(SWEEPS if last else SWEEPS - 1):
            tables = _sweep(state, base, tables, away, discount, rng)
            if sweep >= SWEEPS - KEPT:
                kept += tables / KEPT
        if not last:
            spread = state["spread"]
            return _table(_COUNTED, [(3, grp, grp, tables.astype("<u4").tobytes(), b"", b"", b"", b"", 0, 0, 0), *_to_words(state["word"], tables - 1.0, groups, 4, grp, "<f4"), *_to_words(state["contexts"][spread], _totals(state, tables)[spread], groups, 6, grp, "<f8")])
        return _table(_COUNTED, [(3, grp, grp, (state["count"] - discount * kept).astype("<f4").tobytes(), b"", b"", b"", b"", 0, 0, 0), *_to_words(state["contexts"], _totals(state, kept), groups, 4, grp, "<f4")])

    return run


def _first_parent(key: tuple, table: pa.Table) -> pa.Table:
    """Customers of the parent restaurant in one word group, each word at one table."""
    known, customers = _customers(table)
    return _table(_PARENT, [(key[0].as_py(), b"", b"", b"", len(known), int(customers.sum()), float(len(known)), int((customers == 1).sum()), int((customers == 2).sum()))])


def _customers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, value = _packed(table, "a", "<u8")[0], _column(table, "b", "<f4")[0]
    known, inverse = np.unique(ids, return_inverse=True)
    return known, np.rint(np.bincount(inverse, weights=value, minlength=len(known))).astype(np.int64)


def _parent(discount: float, seed: int, even: float, tables: float):
    """Customers of the parent restaurant in one word group and their tables, the mean over the last sweeps.

    right: the group's row of the round before, if any; `tables` is the number in all groups then (one a word at first).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_PARENT, [])
        known, customers = _customers(left)
        grp, rng = left.column("grp")[0].as_py(), np.random.default_rng([seed, 2, left.column("grp")[0].as_py()])
        own = float(right.column("t")[0].as_py()) if right.num_rows else float(len(known))
        away, at, kept = max(tables - own, 0.0), np.ones(len(known), np.int64), np.zeros(len(known))
        for sweep in range(SWEEPS):
            at = seat(customers, np.full(len(known), even), away + own - at if sweep else np.full(len(known), max(away + own - 1, 0.0)), discount, rng)
            own = float(at.sum())
            if sweep >= SWEEPS - KEPT:
                kept += at / KEPT
        return _table(_PARENT, [(grp, _planes(known), customers.astype("<f8").tobytes(), kept.tobytes(), len(known), int(customers.sum()), float(kept.sum()), 0, 0)])

    return run


_PARENT = "grp int, a binary, customers binary, tables binary, words long, n long, t double, once long, twice long"


def _reply(discount: float, spread: float, total: float):
    """The parent's chance of each word that a pair group asked for, and the sums of the tables of spread contexts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_COUNTED, [])
        r = right.to_pylist()[0]
        known, chance = _unplane(r["a"], "<u8"), _chance(r, discount, spread, total)
        rows = []
        told = [m for m in left.select(["kind", "source", "a", "b"]).to_pylist() if m["kind"] == 6]
        if told:
            contexts, which = np.unique(np.concatenate([_unplane(m["a"], "<u8") for m in told]), return_inverse=True)
            sums = np.bincount(which, weights=np.concatenate([np.frombuffer(m["b"], "<f8") for m in told]), minlength=len(contexts))
        for m in left.select(["kind", "source", "a"]).to_pylist():
            asked = _unplane(m["a"], "<u8")
            answer = chance[np.searchsorted(known, asked)] if m["kind"] == 1 else sums[np.searchsorted(contexts, asked)]
            rows.append((5 if m["kind"] == 1 else 7, m["source"], r["grp"], m["a"], answer.tobytes(), b"", b"", b"", 0, 0, 0))
        return _table(_COUNTED, rows)

    return run


def _chance(row: dict, discount: float, spread: float, total: float) -> np.ndarray:
    return (np.frombuffer(row["customers"], "<f8") - discount * np.frombuffer(row["tables"], "<f8") + spread) / (CONCENTRATION + total)


def _chance_rows(discount: float, spread: float, total: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _table(_COUNTED, [(2, r["grp"], r["grp"], r["a"], _chance(r, discount, spread, total).tobytes(), b"", b"", b"", 0, 0, 0) for r in table.to_pylist()])

    return run


_WEIGHED = "batch int, grp int, mass binary"


def _weigh(discount: float):
    """For each listed pair its customers less their tables' discounts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_WEIGHED, [])
        p = Pairs(left)
        mass = np.where(p.count == 1, 1 - discount, 0.0)
        states = _rows(right, 0)
        if states:
            mass[p.find(_unplane(states[0]["a"], "<u8"), _unplane(states[0]["b"], "<u8"))] = np.frombuffer(_rows(right, 3)[0]["a"], "<f4")
        listed, rows, at = mass[p.inverse].astype("<f4"), [], 0
        for batch, grp, z in zip(left.column("batch").to_pylist(), left.column("grp").to_pylist(), p.ends.tolist(), strict=True):
            rows.append((batch, grp, _planes(listed[at:z])))
            at = z
        return _table(_WEIGHED, rows)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(groups: int, tokens: int, words: int, discount: float, hot: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], names=[x.split()[0] for x in _SCORED.split(", ")])
        b = Batch(left, groups)
        weighed = pa.compute.is_valid(right.column("mass"))
        got = b.fill(right.filter(pa.compute.invert(weighed)), {"ids": "<u8", "times": "<u8", "chance": "<f4", "tables": "<f4"})
        _, _, _, group, token, _ = b.pairs(got["ids"], got["times"], groups, hot)
        mass = np.zeros(len(group) + 1)  # the last place: pairs with an unknown word
        edge = np.searchsorted(group, np.arange(groups + 1))
        for g, m in zip(*(right.filter(weighed).column(c).to_pylist() for c in ("grp", "mass")), strict=True):
            mass[edge[g] : edge[g + 1]] = _unplane(m, "<f4")
        times = got["times"].astype(float)
        chance, u = got["chance"].astype(float)[b.which], b.context
        p = (mass[token] + (CONCENTRATION + discount * got["tables"].astype(float)[u]) * chance) / (CONCENTRATION + times[u])
        p = np.where(times[u] > 0, p, chance)
        base = np.log10((times[b.which] + 0.1) / (tokens + 0.1 * (words + 1)))
        add = lambda x: np.add.reduceat(x, b.starts)
        return pa.table([b.doc_ids, pa.array(b.held), pa.array(b.counts), pa.array(add((times[b.which] > 0).astype(np.int64))), pa.array(np.full(len(b.held), tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def scores(docs: DataFrame, seed: int = 0, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; logs are to base 10."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_batches, n = max(part, -(-total // BATCH)), max(part, -(-total // GROUP))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 10 == 0, F.lit(False))
    key = F.xxhash64("doc_id", F.octet_length("text"))
    rows = docs.select(F.pmod(key, F.lit(n_batches)).cast("int").alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("binary").alias("text"))
    pack = lambda some: map_batches(some, _pack, _PACKED).groupBy("batch")
    by, train = pack(rows), pack(rows.filter("NOT held"))
    listed = by.applyInArrow(_list(n), _LISTED)

    def paired(batches: GroupedData, numbered: DataFrame) -> DataFrame:
        return batches.cogroup(numbered.groupBy("batch")).applyInArrow(_pair(n, hot), _PAIRED)

    # Held-out documents add nothing to the counts, and words that only they have get no numbers.
    learned = train.applyInArrow(_list(n), _LISTED)
    counted = cut(paired(train, learned.groupBy("grp").applyInArrow(_number_only(n), _NUMBERED)).groupBy("grp").applyInArrow(_count(n), _COUNTED), "py-counts")
    sums = counted.filter("kind = 0").agg(F.sum("n"), F.sum("once"), F.sum("twice")).first()
    tokens, d2 = int(sums[0] or 0), _discount(sums[1] or 0, sums[2] or 0)
    state, asked = counted.filter("kind = 0"), counted.filter("kind = 1")
    seated = parent = None
    told, said, tables = counted.filter("kind = 6"), asked, None
    for outer in range(2):
        first = said.groupBy("grp").applyInArrow(_first_parent, _PARENT)
        found = first.agg(F.sum("words"), F.sum("n"), F.sum("once"), F.sum("twice")).first()
        words, customers = int(found[0] or 0), float(found[1] or 0)
        d1 = _discount(found[2] or 0, found[3] or 0)
        even = 1.0 / (words + 1)
        was = parent if parent is not None else first.limit(0)
        parent = cut(said.groupBy("grp").cogroup(was.groupBy("grp")).applyInArrow(_parent(d1, seed + outer, even, float(words) if tables is None else tables), _PARENT), "py-parent")
        tables = float(parent.agg(F.sum("t")).first()[0] or 0)
        spread = (CONCENTRATION + d1 * tables) * even
        replies = asked.unionByName(told).groupBy("grp").cogroup(parent.groupBy("grp")).applyInArrow(_reply(d1, spread, customers), _COUNTED)
        both = state if seated is None else state.unionByName(seated.filter("kind = 3"))
        before = seated
        seated = cut(both.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(_gibbs(n, d2, seed, outer == 1), _COUNTED), "py-seats")
        said, told = asked.unionByName(seated.filter("kind = 4")), seated.filter("kind = 6")
        if before is not None:
            discard(before)
    chances = parent.groupBy("grp").applyInArrow(_chance_rows(d1, spread, customers), _COUNTED)
    model = chances.unionByName(seated.filter("kind = 4")).select("kind", "grp", "a", "b")
    numbered = listed.groupBy("grp").cogroup(model.groupBy("grp")).applyInArrow(_number_with_model(n, spread / (CONCENTRATION + customers)), _NUMBERED)
    free(spark)
    masses = paired(by, numbered.select("batch", "grp", "ids", "times")).groupBy("grp").cogroup(state.unionByName(seated.filter("kind = 3")).select("kind", "grp", "a", "b").groupBy("grp")).applyInArrow(_weigh(d2), _WEIGHED)
    answers = numbered.withColumn("mass", F.lit(None).cast("binary")).unionByName(masses, allowMissingColumns=True)
    return by.cogroup(answers.groupBy("batch")).applyInArrow(_score(n, tokens, words, d2, hot), _SCORED)
