"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding.

The lattice of a text has an edge for each vocabulary piece at each place, and
byte pieces for characters that no piece covers. The model holds merge ranks,
not probabilities, so piece r weighs (r + 1)^-alpha. Filtering forward sums the
weight of all ways to each place; sampling backward from the end draws each last
piece by its share. No piece spans the boundary before a space mark or around a line
feed (checked when the model is read), so the lattice falls apart into units
there; a unit's filtered lattice is kept, and all units of a batch are sampled
in step. Draws come from a counter hashed with the row's key, so a row's
segmentation depends on its key, its text and the seed alone.

Decoding joins the pieces' bytes, with spaces for space marks, and drops the
leading space. A space mark that stands in the text itself is written as byte
pieces, so nothing is lost.

Defined cases: null and empty texts have no pieces and decode to the empty text. A null key counts as
key 0. Rows that repeat key and text get the same pieces. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Edges of filtered lattices that a worker remembers before it starts anew.
REMEMBER = 6_000_000
SPACE = "▁"
#: Stands for a space mark of the text itself: a noncharacter, and so no piece has it.
_LITERAL = "﷐"

_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_NO_PIECES = np.zeros(1, _U), np.zeros(1), np.zeros(1, np.int32)


def read_model(path: str) -> list[tuple[str, int]]:
    """(piece, kind) of each id; kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 6 if model.is_byte(i) else 3 if model.is_control(i) else 2 if model.is_unknown(i) else 1
    return [(model.id_to_piece(i), kind(i)) for i in range(model.get_piece_size())]


class Lattice:
    """Samples segmentations; one for each worker, since it remembers units."""

    def __init__(self, path: str, alpha: float = 1.0, remember: int = REMEMBER) -> None:
        pieces = read_model(path)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(pieces) if k == 6}
        self.ids = {p: i for i, (p, k) in enumerate(pieces) if k == 1}
        first = min(self.ids.values())
        self.weight = {p: (i - first + 1.0) ** -alpha for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        crossing = [p for p in self.ids if "\n" in p or re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing or len(self.byte) != 256:
            raise ValueError(f"the model isn't of the form expected: byte pieces {len(self.byte)}, crossing {crossing[:3]}")
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({len(p) for p in self.ids}):
            some = [p for p in self.ids if len(p) == k]
            keys = np.zeros(len(some), _U)
            for column in np.array(some, f"U{k}").view(np.uint32).reshape(-1, k).astype(_U).T:
                keys = keys * _FACTOR + column + _U(1)
            order = np.argsort(keys)
            self.by_length[k] = keys[order], np.array([self.weight[p] for p in some])[order], np.array([self.ids[p] for p in some], np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[np.concatenate([keys for keys, _, _ in self.by_length.values()]) >> _U(44)] = True
        self.bytes = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(SPACE, " ").encode() for p, k in pieces]
        self.remember = remember
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.cum = np.zeros(1 << 16)
        self.prev, self.piece = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 14, np.int32)  # the first edge into each node
        self.edges = self.nodes = self.noded = 0

    def _filter(self, unit: str) -> tuple[list[float], list[int], list[int], int]:
        """Edges into each node of a unit's lattice: share up to it, node it comes from (-1: the start), piece; and the number of nodes."""
        n = len(unit)
        into: list[list[tuple[float, int, int, int]]] = [[] for _ in range(n + 1)]
        # A sum is total x 2^power, so a long unit doesn't underflow.
        total, power, node = [1.0] + [0.0] * n, [0] * (n + 1), [-1] + [0] * n
        weight, ids = self.weight, self.ids
        starts: dict[int, list[tuple[int, str]]] = {}
        covered = set()
        for a in range(n):
            for z in range(a + 1, min(a + self.longest, n) + 1):
                if (p := unit[a:z]) in ids:
                    starts.setdefault(a, []).append((z, p))
                    covered.update(range(a, z))
        share: list[float] = []
        prev: list[int] = []
        piece: list[int] = []
        made = 0
        for z in range(n + 1):
            if z:
                if into[z]:
                    top = max(e[1] for e in into[z])
                    ways = [math.ldexp(e[0], e[1] - top) for e in into[z]]
                    s = sum(ways)
                    total[z], more = math.frexp(s)
                    power[z], node[z] = top + more, made
                    run = 0.0
                    for w, (_, _, a, i) in zip(ways, into[z], strict=True):
                        run += w / s
                        share.append(made + min(run, 1.0))
                        prev.append(a)
                        piece.append(i)
                    share[-1] = made + 1.0
                    made += 1
            if z < n and (z == 0 or into[z]):
                for end, p in starts.get(z, ()):
                    into[end].append((total[z] * weight[p], power[z], node[z], ids[p]))
                if z not in covered:
                    raw = (SPACE if unit[z] == _LITERAL else unit[z]).encode()
                    at = node[z]
                    for b in raw[:-1]:
                        share.append(made + 1.0)
                        prev.append(at)
                        piece.append(self.byte[b])
                        at = made
                        made += 1
                    into[z + 1].append((total[z], power[z], at, self.byte[raw[-1]]))
        return share, prev, piece, made

    def _filter_alike(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """_filter for units of one length at once: cum, prev, piece of all edges, last nodes, and which units have a place without a piece."""
        n, m = len(units[0]), len(units)
        codes = np.array(units, f"U{n}").view(np.uint32).reshape(m, n).astype(_U)
        total, far = np.zeros((m, n + 1)), min(n, self.longest)
        total[:, 0] = 1
        ways, ids = np.zeros((m, n + 1, far)), np.zeros((m, n + 1, far), np.int32)
        hashed, covered = np.zeros((m, n), _U), np.zeros((m, n), bool)
        for k in range(1, far + 1):  # pieces of k characters, put down at their end
            hashed = hashed[:, : n - k + 1] * _FACTOR + codes[:, k - 1 :] + _U(1)
            keys, weights, numbers = self.by_length.get(k, _NO_PIECES)
            u, a = np.nonzero(self.maybe[hashed >> _U(44)])  # few others pass
            own = hashed[u, a]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            true = keys[at] == own
            u, a, at = u[true], a[true], at[true]
            ways[u, a + k, far - k], ids[u, a + k, far - k] = weights[at], numbers[at]  # the longest first
            hit = np.zeros(hashed.shape, bool)
            hit[u, a] = True
            for j in range(k):
                covered[:, j : j + n - k + 1] |= hit
        for z in range(1, n + 1):
            for k in range(1, min(z, far) + 1):
                ways[:, z, far - k] *= total[:, z - k]
            total[:, z] = ways[:, z].sum(axis=1)
        bare = ~covered.all(axis=1)
        ways[bare] = 0
        reached = total > 0
        reached[:, 0] = reached[bare] = False
        node = np.where(reached, self.nodes + np.cumsum(reached).reshape(reached.shape) - 1, -1)
        u, z, k = np.nonzero(ways)
        back = far - k
        share = np.cumsum(ways, axis=2)[u, z, k] / total[u, z]
        last = np.r_[(u[1:] != u[:-1]) | (z[1:] != z[:-1]), True] if len(u) else np.zeros(0, bool)
        share[last] = 1
        self.nodes += int(reached.sum())
        return node[u, z] + np.minimum(share, 1), node[u, z - back], ids[u, z, k], node[:, n], bare

    def _learn(self, units: list[str]) -> None:
        groups: dict[int, list[str]] = {}
        odd: list[str] = []
        for u in units:
            if len(u) <= 40 and "\0" not in u:
                groups.setdefault(len(u), []).append(u)
            else:
                odd.append(u)
        for n, alike in groups.items():
            step = max(1, 400_000 // (n * n))
            for a in range(0, len(alike), step):
                some = alike[a : a + step]
                cum, prev, piece, last, bare = self._filter_alike(some)
                self._store(cum, prev, piece)
                self.known.update(zip(some, last.tolist(), strict=True))
                odd += [u for u, x in zip(some, bare.tolist(), strict=True) if x]
        for u in odd:
            s, p, i, made = self._filter(u)
            base = self.nodes
            self._store(np.array(s) + base, np.array([x + base if x >= 0 else -1 for x in p]), np.array(i))
            self.nodes += made
            self.known[u] = self.nodes - 1

    def _store(self, share: np.ndarray, prev: np.ndarray, piece: np.ndarray) -> None:
        need = self.edges + len(share)
        while need > len(self.cum):
            self.cum, self.prev, self.piece = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cum, self.prev, self.piece))
        at = slice(self.edges, need)
        self.cum[at], self.prev[at], self.piece[at] = share, prev, piece
        # A node's shares run from above its number to the next one: they change the number's whole part.
        whole = np.ceil(share).astype(np.int64)
        begins = self.edges + np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(share) else np.zeros(0, np.int64)
        while self.noded + len(begins) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.first[self.noded : self.noded + len(begins)] = begins
        self.noded += len(begins)
        self.edges = need

    def sample(self, texts: list[bytes | None], keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text)."""
        split = [_units(t) if t else [] for t in texts]
        units = [u for s in split for u in s]
        if self.edges > self.remember:
            self._clear()
        self._learn([u for u in dict.fromkeys(units) if u not in self.known])
        node = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        n = np.array([len(s) for s in split], np.int64)
        order = np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n)
        stream = _mix(np.repeat(keys.astype(np.int64).view(_U) ^ _mix(np.array([seed], _U)), n) + order.astype(_U) * _U(0x9E3779B97F4A7C15))
        cum, live = self.cum[: self.edges], np.arange(len(units))
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        length = np.zeros(len(units), np.int64)
        step = 0
        while len(live):
            u = (_mix(stream[live] + _U(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(float) * 2.0**-53
            mark, edge = node[live] + u, self.first[node[live]]
            on = np.flatnonzero(cum[edge] < mark)
            while len(on):
                edge[on] += 1
                on = on[cum[edge[on]] < mark[on]]
            drawn.append((live, self.piece[edge]))
            length[live] += 1
            node[live] = self.prev[edge]
            live = live[node[live] >= 0]
            step += 1
        ends = np.cumsum(length)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, piece) in enumerate(drawn):
            out[ends[who] - 1 - k] = piece
        total = np.r_[0, ends]
        edge = np.cumsum(n)
        return out, total[edge] - total[edge - n]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:]


_SPLIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


def _units(text: bytes) -> list[str]:
    marked = text.decode(errors="replace").replace(SPACE, _LITERAL)
    return _SPLIT.findall(SPACE + marked.replace(" ", SPACE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


_ENCODED = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean, ids array<int>"


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), decoded_sha256, lossless and (with ids) the sampled ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, alpha)
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            keys = np.array([k or 0 for k in b.column(0).to_pylist()], np.int64)
            while at < len(texts):  # about 1 MB at a time
                to, size = at, 0
                while to < len(texts) and size < 1 << 20:
                    size += len(texts[to] or b"")
                    to += 1
                flat, n = lattice.sample(texts[at:to], keys[at:to], seed)
                ends = np.cumsum(n)
                own = [flat[z - k : z] for z, k in zip(ends, n, strict=True)]
                decoded = [lattice.decode(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, to - at),
                        pa.array(n, pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                        pa.array([d == (t or b"") for d, t in zip(decoded, texts[at:to], strict=True)]),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32())) if ids else pa.nulls(to - at, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless", "ids"],
                )
                at = to

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, _ENCODED)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of the ids as bytes in a column `into` (in place of one so named); null ids have a null text, ids outside the model raise."""
    names = [c for c in rows.columns if c != into]
    kept = rows.select(*names, F.col(ids_col).alias("__ids"))
    schema = rows.select(*names, F.lit(None).cast("binary").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, 1.0)
        for b in batches:
            texts = [None if ids is None else lattice.decode(np.array(ids, np.int64)) for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], [*names, into])

    return map_batches(kept, run, schema)
