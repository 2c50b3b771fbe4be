"""Sinks that stand a stop at any time: pages under a commit protocol, ledgers with a torn tail, day partitions of a table."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COMMIT = "page int, file string, rows long"


@dataclass
class Pages(WriterCommitMessage):
    """What a task has written: (page, file, rows)."""

    written: list[tuple[int, str, int]]


class PageSink(DataSource):
    """Option path, a URI. Rows (page, pos, item) must come with all of a page in one partition, in order."""

    @classmethod
    def name(cls) -> str:
        return "page_sink"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a page sink is only appended to")
        return PageWriter(self.options["path"])


class PageWriter(DataSourceWriter):
    """Tasks write each page to a file of its own; the pages count once the driver has named them in a commit, by one move."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator[Row]) -> Pages:
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/pages", recursive=True)
        out = []
        for page, own in itertools.groupby(rows, key=lambda r: r["page"]):
            name, n = f"page-{page:08d}-{uuid.uuid4().hex}.jsonl", 0
            with store.open_output_stream(f"{root}/pages/{name}", compression=None) as f:
                for r in own:
                    f.write(r["item"].encode() + b"\n")
                    n += 1
            out.append((page, name, n))
        return Pages(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/.{name}", compression=None) as f:
            for m in messages:
                for page, file, n in m.written if m else []:
                    f.write(json.dumps({"page": page, "file": file, "rows": n}).encode() + b"\n")
        store.move(f"{root}/.{name}", f"{root}/commits/{name}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of tasks that ended; those of torn ones have no name in a commit, and sweep() takes them."""
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            for _, file, _ in m.written if m else []:
                store.delete_file(f"{root}/pages/{file}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(page, file, rows) of the pages that count; of a page that two runs have written, the file first by name."""
    store, root = pyarrow.fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/commits").type == pyarrow.fs.FileType.NotFound:
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{path}/commits").groupBy("page").agg(F.min_by(F.struct("file", "rows"), "file").alias("f")).select("page", "f.*")


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """(page, item) of the committed pages."""
    rows = spark.read.text(f"{path}/pages").select(F.col("value").alias("item"), F.col("_metadata.file_name").alias("file"))
    return rows.join(committed(spark, path), "file").select("page", "item")


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the page files that no commit names: what a stopped run left torn. For use while nothing else writes; how many there were."""
    store, root = pyarrow.fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/pages").type == pyarrow.fs.FileType.NotFound:
        return 0
    there = spark.read.format("binaryFile").load(f"{path}/pages").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    torn = [r.file for r in there.join(committed(spark, path), "file", "left_anti").collect()]  # as many as one batch of pages had
    for file in torn:
        store.delete_file(f"{root}/pages/{file}")
    return len(torn)


def resume(rows: DataFrame, path: str, batch: int = 1000) -> int:
    """Write the pages of rows (page, pos, item) that the sink doesn't have, `batch` pages a commit; how many were new. A stopped run goes on with the first batch that has no commit."""
    spark = rows.sparkSession
    spark.dataSource.register(PageSink)
    sweep(spark, path)
    left = sorted(r.page for r in rows.select("page").distinct().join(committed(spark, path), "page", "left_anti").collect())
    for at in range(0, len(left), batch):
        low, high = left[at], left[at : at + batch][-1]
        some = rows.filter(F.col("page").between(low, high)).join(committed(spark, path).select("page"), "page", "left_anti")
        some.repartition("page").sortWithinPartitions("page", "pos").select("page", "pos", "item").write.format("page_sink").mode("append").option("path", path).save()
    return len(left)


def ledger(spark: SparkSession, path: str, schema: str, key: str, order: str = "seq") -> DataFrame:
    """The last state of each key of an append-only ledger of JSON lines; a line that was cut off doesn't count, so its key's work is done again."""
    value = F.from_json("value", f"{schema}, __torn string", {"columnNameOfCorruptRecord": "__torn"})
    whole = spark.read.text(path).select(value.alias("r")).filter(f"r.__torn IS NULL AND r.{key} IS NOT NULL").select("r.*").drop("__torn")
    rest = [c for c in whole.columns if c != key]
    return whole.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def record(rows: DataFrame, path: str) -> None:
    """Append rows to a ledger, one JSON line each."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def compact(spark: SparkSession, path: str, schema: str, key: str, to: str, order: str = "seq") -> None:
    """Write the last states of a ledger as a new one; readers move over to it once it is whole."""
    record(ledger(spark, path, schema, key, order), to)


def _days(spark: SparkSession, table: str) -> list[str]:
    return [r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def ensure_days(spark: SparkSession, table: str, as_of_day: str, back: int = 1, ahead: int = 7) -> list[str]:
    """Make the day partitions (dt) from `back` days before to `ahead` days after a day, where they aren't there; those that were made."""
    start = F.lit(as_of_day).cast("date")
    days = [str(r[0]) for r in spark.range(1).select(F.explode(F.sequence(F.date_sub(start, back), F.date_add(start, ahead)))).collect()]
    new = sorted(set(days) - set(_days(spark, table)))
    if new:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (dt = DATE'{d}')" for d in new))
    return new


def drop_days(spark: SparkSession, table: str, as_of_day: str, keep: int) -> list[str]:
    """Drop the day partitions that are older than `keep` days on a day; those that were dropped."""
    first = str(spark.range(1).select(F.date_sub(F.lit(as_of_day).cast("date"), keep)).first()[0])
    old = sorted(d for d in _days(spark, table) if d < first)
    if old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION (dt = DATE'{d}')" for d in old))
    return old
