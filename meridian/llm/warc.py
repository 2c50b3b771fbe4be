"""WARC archives with a globally ordered capture index.

Writers put records into gzip members of .warc.gz files in a shared folder and
keep one index run for each file, sorted by (URL key, capture time, page). The
runs are dealt out by ranges of that key; in each range a loser tree merges its
slices of all runs into one ordered history. Readers take the merged index and
fetch records by offset.

Of records with equal payloads of at least `least` bytes the one with the
smallest page_id is a response, the others are revisits that refer to it;
records with smaller payloads are all responses.

Defined cases: a null html is an empty payload. A null url is the key "-". Rows
that repeat the smallest page_id of their payload are all responses. A page_id
that comes with several payloads has a record for each row, response or revisit
by that row's payload alone. A null page_id is a revisit if any page has its
payload, else a response. A payload is compressed and read whole, however long;
a file holds at least one record. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, scratch

#: A file is closed once it has this many bytes: also the bound of a run that a writer holds.
FILE_BYTES = 64 << 20
#: Entries of the index in one range, which one task merges.
ENTRIES = 200_000
_EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "urlkey string, ts long, page_id long, file string, offset long, length long, record_type string, run string, seq long"
_INDEX_ARROW = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("run", pa.string()), ("seq", pa.int64())])


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> int:
    """Seconds since the epoch; the pages bear no time of their own, so it follows from the id."""
    return int(_EPOCH.timestamp()) + (page_id or 0) % 10**9


def _date(ts: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _page_uri(page_id: int | None) -> str:
    return f"<urn:meridian:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_uri(page_id)}", f"WARC-Date: {_date(capture_time(page_id))}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_page_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of a record; ValueError if it isn't whole."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    n = int(named["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC record of a wrong length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return named, http, payload


def _page(uri: str) -> int | None:
    tail = uri.rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload an earlier one has; digests only are dealt out."""
    html = F.coalesce("html", F.lit(""))
    sums = pages.filter(F.octet_length(html) >= least).select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))
    first = sums.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    return sums.join(first, "sha").filter("page_id IS NULL OR page_id > refers_to").select("page_id", "refers_to", "sha")


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as records under `folder` (a URI); the index runs, one a file.

    Each writing gives other file names, so that a task run twice leaves a file
    that no index names, never a torn one. Materialise the result once.
    """
    named = cut(revisits(pages, least), "warc-revisits")  # its size is known now: where it is small, payloads needn't be dealt out to meet it
    again = named.select(F.col("page_id").alias("__p"), F.col("sha").alias("__s"), "refers_to").distinct()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    # By id and payload: an id may come with several payloads, of which each is a record of its own.
    met = rows.join(again, F.col("page_id").eqNullSafe(F.col("__p")) & (F.unhex(F.sha1("html")) == F.col("__s")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, at, entries = None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            entries.sort(key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2], e[4]))
            columns = list(zip(*entries, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _INDEX_ARROW, strict=False)), pa.array([name] * len(entries)), pa.array(range(len(entries)), pa.int64())], schema=_INDEX_ARROW)

        part = TaskContext.get().partitionId()
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"captures-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out, at, entries = store.open_output_stream(f"{root}/{name}", compression=None), 0, []
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = gz.compress(record(page_id, url, html, refers_to, refers_to is not None)) + gz.flush()
                out.write(data)
                entries.append((url_key(url), capture_time(page_id), page_id, f"{folder}/{name}", at, len(data), "response" if refers_to is None else "revisit"))
                at += len(data)
                if at >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return map_batches(met, run, _INDEX)


class LoserTree:
    """Merge sorted sequences: each inner node keeps the loser of its match, so a step costs one path to the root."""

    def __init__(self, runs: Sequence[Sequence[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merge_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The runs as one index in global order of (urlkey, ts, page_id): partitions are ranges, each in order.

    The range takes page and file in, so that a URL with many captures is split. A
    range holds about ENTRIES entries of the index, never a payload.
    """
    n = partitions or max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // ENTRIES))
    dealt = runs.repartitionByRange(n, "urlkey", "ts", "page_id", "file", "offset").sortWithinPartitions("run", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), _INDEX_ARROW)
        if not rows.num_rows:
            return
        keys = rows.select(["urlkey", "ts", "page_id"]).to_pydict()
        names = rows.column("run").to_pylist()
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        entry = lambda i: (keys["urlkey"][i], keys["ts"][i], -1 if keys["page_id"][i] is None else keys["page_id"][i], i)
        slices = [[entry(i) for i in range(a, z)] for a, z in zip(starts, starts[1:], strict=False)]
        yield from rows.take(pa.array([e[3] for e in LoserTree(slices)], pa.int64())).combine_chunks().to_batches()

    return map_batches(dealt, run, _INDEX)


_RECORD = "page_id long, url string, urlkey string, ts long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index names, in its order; a response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            got: list[tuple | None] = [None] * b.num_rows
            last, source = None, None
            for i in sorted(range(b.num_rows), key=lambda i: (cols["file"][i], cols["offset"][i])):
                if cols["file"][i] != last:
                    last = cols["file"][i]
                    store, path = pyarrow.fs.FileSystem.from_uri(last)
                    source = store.open_input_file(path)
                data = zlib.decompress(source.read_at(cols["length"][i], cols["offset"][i]), 31)
                named, http, payload = parse(data)
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                mark = named["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = named["WARC-Type"]
                if kind == "response" and (digest(payload) != mark or len(payload) != size):
                    raise ValueError(f"payload of {named['WARC-Record-ID']} does not match its digest")
                refers = _page(named["WARC-Refers-To"]) if kind == "revisit" else None
                got[i] = (_page(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), cols["urlkey"][i], cols["ts"][i], size, mark, kind, refers, payload if payloads and kind == "response" else None)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in _RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 9, types, strict=True)], names)

    return map_batches(index, run, _RECORD)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages into archives in the shared folder; the merged index, itself a table there."""
    spark = pages.sparkSession
    runs = cut(write_archives(pages, scratch(spark, "warc"), least), "warc-runs")
    return merge_index(runs)
