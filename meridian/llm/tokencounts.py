"""Token counts by section, from one encoding of the whole document.

A byte-level encoding loses nothing, so a token's span is where its bytes stand:
the running sum of token lengths. Token spans are interval-joined to section
spans (sorted both, so by binary search); sections partition the text.

The rule for a token that crosses a boundary: it belongs to the section that has
most of its bytes, of equals to the first ("largest"). Others: "first" and
"last", the section of its first or last byte.

Defined cases: null and empty texts have no section and no row. A section is a
line with its line end; an empty line has its line end alone. Rows that repeat a
doc_id are each counted. Bytes that aren't UTF-8 count as the replacement
character that stands for them. A run of white space of any length is one piece of
the pattern (without its last character, if more text follows). Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


@cache
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for piece, i in table.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths


#: Runs of white space that the tokenizer's pattern would have to backtrack over too deeply.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode(encoding, text: str) -> list[int]:
    """Token ids of a text. A long run of white space is encoded as the one piece that the pattern makes of it."""
    out: list[int] = []
    at = 0
    for run in _BLANKS.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def line_ends(text: bytes) -> np.ndarray:
    """Byte ends of the lines of a text, each with its line end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.r_[ends, len(text)]


def allocate(stops: np.ndarray, ends: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses) of each token; tokens and sections partition the text, given by their ends."""
    starts = np.r_[0, stops[:-1]]
    first, last = np.searchsorted(ends, starts, "right"), np.searchsorted(ends, stops - 1, "right")
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.r_[starts[i], ends[first[i] : last[i]], stops[i]]
        out[i] = first[i] + int(np.diff(edges).argmax())
    return out, first != last


def count_sections(docs: DataFrame, ranks: str, pattern: str, rule: str = "largest", section_ends: Callable[[bytes], np.ndarray] = line_ends, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing) of every section of every text.

    section_ends gives the byte ends of a text's sections, the last being the text's.

    n_crossing: tokens of the section that also have bytes of another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(ranks, pattern)
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            ids: list[int | None] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                whole = text.decode(errors="replace")
                text = whole.encode()
                stops = np.cumsum(lengths[np.array(encode(encoding, whole), np.int64)])
                ends = section_ends(text)
                section, crosses = allocate(stops, ends, rule)
                chars = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)][np.r_[0, ends]]
                ids += [doc] * len(ends)
                for o, x in zip(out, (np.arange(len(ends)), chars[:-1], chars[1:], np.bincount(section, minlength=len(ends)), np.bincount(section[crosses], minlength=len(ends))), strict=True):
                    o.append(x)
            columns = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long")
