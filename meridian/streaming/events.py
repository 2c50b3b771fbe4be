"""Event streams: decoding, routing, late rows, sessions, windows, limits and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENT = "event_id long, type string, entity_id string, user_id long, ts timestamp, text_hash string"


def decode(stream: DataFrame, schema: str = EVENT, column: str = "value") -> DataFrame:
    """JSON messages as columns, with bad: those that don't parse are kept with their text, not lost."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    out = stream.withColumn("e", parsed).select("e.*", F.col(column).alias("raw"))
    return out.withColumn("bad", F.col("event_id").isNull() | F.col("type").isNull())


def split_late(stream: DataFrame, as_of: Column, back: str = "1 day", ahead: str = "7 days") -> tuple[DataFrame, DataFrame]:
    """(in time, refused): rows with times outside what is provisioned are refused for all to see."""
    ok = F.col("ts").between(as_of - F.expr(f"INTERVAL {back}"), as_of + F.expr(f"INTERVAL {ahead}"))
    return stream.filter(F.coalesce(ok, F.lit(False))), stream.filter(~F.coalesce(ok, F.lit(False)))


def once(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event_id once, within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str | None = "10 minutes") -> DataFrame:
    """(user_id, start, end, events) of sessions that end after `gap` of nothing; without a delay no event is too late, and every session stays in the state."""
    some = stream if delay is None else stream.withWatermark("ts", delay)
    return some.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")


def daily(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "type").agg(F.count("*").alias("n")).select("w.start", "type", "n")


def trailing(stream: DataFrame, size: str = "30 days", slide: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "entity_id").agg(F.count("*").alias("n")).select("w.end", "entity_id", "n")


def over_limit(stream: DataFrame, size: str, limit: int, delay: str = "10 minutes") -> DataFrame:
    """Keys that go over the limit in a fixed window."""
    return stream.withWatermark("ts", delay).groupBy("user_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("user_id", "w.start", "n")


def route(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, quarantine: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch to the handler of its event types; bad messages and unknown types to quarantine. A batch that fails is tried again whole, so handlers must be idempotent."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            good = batch.filter(~F.col("bad"))
            for kind, handle in handlers.items():
                handle(good.filter(F.col("type") == kind), epoch)
            quarantine(batch.filter(F.col("bad") | ~F.col("type").isin(*handlers)), epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def isolated(handle: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None], key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """A handler under which a message that makes `handle` fail keeps no other one back.

    A batch that fails is halved by key until the message stands alone; it goes to quarantine with its error. For bounded batches
    (a source's messages or files a trigger), and for a handle that does nothing with a batch that it fails on.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            handle(batch, epoch)
            return
        except Exception as e:  # noqa: BLE001 - whatever a message provokes
            error = str(e)[:500]
        n = batch.count()
        if n <= 1:
            quarantine(batch.withColumn("error", F.lit(error)), epoch)
            return
        halves = batch.withColumn("__n", F.row_number().over(Window.orderBy(key))).persist()
        try:
            each(halves.filter(F.col("__n") <= n // 2).drop("__n"), epoch)
            each(halves.filter(F.col("__n") > n // 2).drop("__n"), epoch)
        finally:
            halves.unpersist()

    return each


def at_most_once(handle: Callable[[DataFrame, int], None], begun: str) -> Callable[[DataFrame, int], None]:
    """A handler that each batch passes once at most: it is acknowledged, by a mark in the folder `begun` (a URI), before it is handled, so one that a run was stopped in isn't handled again."""

    def each(batch: DataFrame, epoch: int) -> None:
        store, root = pyarrow.fs.FileSystem.from_uri(begun)
        store.create_dir(root, recursive=True)
        mark = f"{root}/epoch-{epoch:012d}"
        if store.get_file_info(mark).type != pyarrow.fs.FileType.NotFound:
            return
        with store.open_output_stream(mark) as f:
            f.write(b"begun")
        handle(batch, epoch)

    return each


def index_changes(messages: DataFrame, articles: DataFrame, index: DataFrame) -> DataFrame:
    """(entity_id, op, text_hash) that bring a text index up to date with the articles some messages name: upsert where the text's hash has changed, delete what isn't published any more. Idempotent: done twice, nothing is left to do.

    messages: (entity_id); articles: (entity_id, text_hash) of what is published; index: (entity_id, text_hash).
    """
    named = messages.filter("entity_id IS NOT NULL").select("entity_id").distinct()
    both = named.join(articles.select("entity_id", "text_hash"), "entity_id", "left").join(index.select("entity_id", F.col("text_hash").alias("__was")), "entity_id", "left")
    op = F.when(F.col("text_hash").isNull() & F.col("__was").isNotNull(), "delete").when(F.col("text_hash").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("__was")), "upsert")
    return both.withColumn("op", op).filter("op IS NOT NULL").select("entity_id", "op", "text_hash")


def newest_by_key(stream: DataFrame, key: str = "entity_id") -> DataFrame:
    """The newest state of each key: (key, ts, text_hash, event_id), for an idempotent upsert in update mode."""
    return stream.groupBy(key).agg(F.max(F.struct("ts", "event_id", "text_hash")).alias("s")).select(key, "s.ts", "s.text_hash", "s.event_id")


def upsert_epoch(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps a keyed table: each epoch writes its own folder, and readers take the newest row of a key.

    Folders are named by epoch and overwritten when it is tried again, so nothing counts twice.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "ts").alias("s"))
        newest.select(key, "s.*").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


class _Gate(StatefulProcessor):
    """Per key the hash and time of its newest state; a timer forgets a key that has long been still."""

    def __init__(self, keep_s: int) -> None:
        self.keep_s = keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "text_hash string, ms long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(rows), ignore_index=True)
        ms = now["ts"].astype("datetime64[us]").astype("int64") // 1000
        at = int(now.assign(ms=ms).sort_values(["ms", "event_id"]).index[-1])
        new = (str(now["text_hash"][at]), int(ms[at]), int(now["event_id"][at]))
        old = tuple(self.seen.get()) if self.seen.exists() else None
        if old is not None and (old[1], old[2]) >= (new[1], new[2]):
            return  # an older message, or the same one again
        self.seen.update(new)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(new[1], timerValues.getCurrentWatermarkInMs()) + self.keep_s * 1000)
        if old is None or old[0] != new[0]:
            yield pd.DataFrame({"entity_id": [key[0]], "text_hash": [new[0]], "ts": [pd.Timestamp(new[1], unit="ms")], "event_id": [new[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def changed_by_hash(stream: DataFrame, keep_s: int = 30 * 86_400, delay: str = "10 minutes") -> DataFrame:
    """(entity_id, text_hash, ts, event_id) of messages (entity_id, text_hash, ts, event_id) after which a key has another hash than before.

    Of a key's messages in one batch the newest counts, by (ts, event_id); one that is no newer than what the
    key has, a replayed one among them, does nothing. State is a row a key, and a key
    that was still for keep_s of event time is forgotten, so it's bounded by the keys of that time.
    The session needs the RocksDB state store. Rows without a key are left out.
    """
    some = stream.filter("entity_id IS NOT NULL").select("entity_id", "text_hash", "ts", "event_id").withWatermark("ts", delay)
    return some.groupBy("entity_id").transformWithStateInPandas(_Gate(keep_s), "entity_id string, text_hash string, ts timestamp, event_id long", "Append", "EventTime")


def closed_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "0 seconds") -> DataFrame:
    """(user_id, start, end, events) of sessions that are over, each handed on once: append mode, so a closed session leaves the state."""
    return stream.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("user_id", "s.start", "s.end", "events")
