"""A paginated collection as a Spark data source: one partition a page, so a harvest is spread and can be resumed.

The pages lie as <folder>/<endpoint>/page-<n>.json, each a JSON array, as a
harvest leaves them; a service's reader would ask for the page in read() instead.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """Options: path, endpoint, start_page."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = os.path.join(options["path"], options.get("endpoint", "posts"))
        self.start = int(options.get("start_page", 1))

    def partitions(self) -> list[InputPartition]:
        pages = sorted(int(m[1]) for f in os.listdir(self.folder) if (m := re.fullmatch(r"page-(\d+)\.json", f)))
        return [InputPartition(p) for p in pages if p >= self.start]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int, str]]:
        with open(os.path.join(self.folder, f"page-{partition.value}.json"), encoding="utf-8") as f:
            for pos, item in enumerate(json.load(f)):
                yield partition.value, pos, json.dumps(item)


def read_pages(spark: SparkSession, path: str, endpoint: str, start_page: int = 1) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(path=path, endpoint=endpoint, start_page=str(start_page)).load()


def harvest(spark: SparkSession, path: str, endpoint: str, sink: str) -> int:
    """Append the pages that the sink doesn't have yet, by page; how many were new. A page is there whole or not at all."""
    rows = read_pages(spark, path, endpoint)
    try:
        done = spark.read.parquet(sink).select("page").distinct()
        rows = rows.join(done, "page", "left_anti")
    except Exception as e:  # the sink's first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.select("page").distinct().count()
    if n:
        rows.write.mode("append").parquet(sink)
    rows.unpersist()
    return n
