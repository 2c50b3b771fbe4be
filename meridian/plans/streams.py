"""Streaming queries: the event log replayed from files, run to its end, against what a batch gives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as ev


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).format("parquet").load(f"{sf_dir}/events.parquet*")
    return raw.select("event_id", F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("entity_id"), "user_id", F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts), TIMESTAMP'1970-01-01 00:00:00Z')").alias("ts"))


def _run(spark: SparkSession, out: DataFrame, keys: list[str] = (), append: bool = False, complete: bool = False) -> DataFrame:
    """A stateful stream run to its end into files, a folder for each epoch; the rows that hold then.

    In update mode the newest row of each key holds. In append mode rows are handed
    on once, when nothing changes them any more; with keys the newest of each holds, else all.
    In complete mode (session windows can't be updated) the last epoch's rows are all.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{shared or tempfile.mkdtemp(prefix='meridian-stream-')}/stream-{uuid.uuid4().hex[:12]}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    q = out.writeStream.outputMode("complete" if complete else "append" if append else "update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in out.dtypes)}, epoch int").parquet(f"{folder}/rows")
    if keys:
        rest = [c for c in out.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("__s")).select(*keys, "__s.*")
    if complete:
        rows = rows.join(rows.agg(F.max("epoch").alias("epoch")), "epoch")
    return rows.drop("epoch")


def L6_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of the log, those open at its end too: every epoch hands on all that there are, and no event is too late."""
    found = _run(spark, ev.sessions(_replay(spark, sf_dir), delay=None), complete=True)
    return found.select("user_id", (F.unix_timestamp("end") - F.unix_timestamp("start") - 1800).alias("seconds"), "events")


def L8_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, ev.daily(_replay(spark, sf_dir)), ["start", "type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "type", "n")


def L11_stream_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, ev.over_limit(_replay(spark, sf_dir), "1 day", 2), ["user_id", "start"]).select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def L4_stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest kind of event of each entity, as a hash whose change matters."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = ev.changed_by_hash(_replay(spark, sf_dir).withColumn("text_hash", F.col("type")), keep_s=3650 * 86_400)
    return _run(spark, found, ["entity_id"], append=True).select("entity_id", "text_hash", "event_id")


QUERIES = {x.__name__: x for x in (L4_stream_gate, L6_stream_sessions, L8_stream_daily, L11_stream_limit)}
ORACLE = {
    "L6_stream_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), t AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, CAST(floor(epoch_us(max(ts)) / 1e6) - floor(epoch_us(min(ts)) / 1e6) AS BIGINT) AS seconds, count(*) AS events FROM t GROUP BY user_id, n""",
    "L4_stream_gate": """WITH e AS (SELECT json_extract_string(props, '$.k') AS entity_id, event_type AS kind, ts, event_id FROM events) SELECT entity_id, arg_max(kind, struct_pack(t := epoch_ms(ts), e := event_id)) AS text_hash, arg_max(event_id, struct_pack(t := epoch_ms(ts), e := event_id)) AS event_id FROM e WHERE entity_id IS NOT NULL GROUP BY 1""",
    "L8_stream_daily": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2",
    "L11_stream_limit": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2",
}
