"""What the corpus operators share: byte-level text rules, Arrow plumbing, durable cuts and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Rows and bytes in one Arrow batch: what a Python worker holds of the input at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Edges (of 16 bytes) that one task may contract.
FEW = 200_000
#: A ranking is cut into parts of about so many rows, but into no more than so many parts.
PART_ROWS, PARTS = 16_384, 4096


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since a document may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text with A-Z in lower case; null has none."""
    return text.translate(LOWER).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_meridian_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="meridian-")
            spark._meridian_shared = found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/meridian/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: a lineage cut that outlives executors.

    What was shuffled for it, and before it, is of no more use; Spark removes it
    once the driver has collected its garbage, so the driver is asked to.
    """
    path = scratch(df.sparkSession, name)
    free(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    free(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, and with it the shuffles of queries that are over."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that cut() has written, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[Column], rows: int, first: int | None = None) -> DataFrame:
    """df with rank, a row's place from 1 on in `order` over all its `rows` rows; with first, null beyond that place.

    The rows are dealt out by ranges of the order and written; a part's rows come
    after those of the parts before it, whose numbers (PARTS at most) the driver
    adds up. Parts that lie wholly beyond `first` aren't sorted.
    """
    spark, n = df.sparkSession, min(PARTS, rows // PART_ROWS + 1)
    dealt = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    upto = np.cumsum([0, *(sizes.get(k, 0) for k in range(n))]).tolist()
    before = [(k, upto[k]) for k in range(n)]
    parts = F.broadcast(spark.createDataFrame(before, "__part int, __before long"))
    met = dealt.join(parts, "__part")
    place = (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")).cast("long")
    if first is None:
        return met.withColumn("rank", place).drop("__part", "__before")
    near = met.filter(F.col("__before") < first).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= first, F.col("rank")))
    return near.unionByName(met.filter(F.col("__before") >= first).withColumn("rank", F.lit(None).cast("long"))).drop("__part", "__before")


def as_bytes(column: str = "text") -> Column:
    return F.col(column).cast("binary").alias(column)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v. Groups meet as minima and a join that Spark can split, so a hub is no one task's work."""
    seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = seen.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.filter(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs (a, b) in root, an array in which every entry names its set's least member."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (u, v) of one partition."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = rows.column("u").to_numpy(), rows.column("v").to_numpy()
    ids, at = np.unique(np.r_[u, v], return_inverse=True)
    root = np.arange(len(ids))
    merge(root, at[: len(u)], at[len(u) :])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[root[moved]], pa.int64())], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the least node it can reach.

    Up to `few` edges, which are counted, are contracted by one task. More take
    alternating large-star and small-star steps; each round is checkpointed to
    the shared folder, and a round that changes nothing ends it. A node without
    edges isn't listed; an edge with a null end is ignored.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
        .checkpoint()
    )
    if now.count() <= few:
        return map_batches(now.repartition(1), _contract, "node long, root long")
    mark = None
    for _ in range(rounds):
        now = _stars(_stars(now, True).distinct(), False).distinct().checkpoint()
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
