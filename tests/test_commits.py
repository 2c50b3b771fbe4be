"""Sinks and ledgers that are stopped half way, partitions, loaders, verdicts, keyed stream state, the bootstrap's draws."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import evaluation, loading
from meridian.sources import commits
from meridian.streaming import events

PAGES = "page int, pos int, item string"


def pages(spark, numbers, boom=None):
    rows = spark.createDataFrame([(p, k, json.dumps({"p": p, "k": k})) for p in numbers for k in range(p % 4)], PAGES)
    if boom is None:
        return rows
    stop = F.udf(lambda p, item: item if p != boom else 1 // 0, "string")
    return rows.withColumn("item", stop("page", "item"))


def test_a_stopped_harvest_goes_on(spark, tmp_path):
    sink = f"file://{tmp_path}/sink"
    assert commits.resume(pages(spark, range(1, 6)), sink, batch=2) == 4  # page 4 has no rows, so isn't one
    with pytest.raises(Exception, match="ZeroDivision"):
        commits.resume(pages(spark, range(1, 16), boom=11), sink, batch=3)
    done = {r.page for r in commits.committed(spark, sink).collect()}
    assert done == {1, 2, 3, 5, 6, 7, 9}  # the batch with page 11 left nothing that counts
    torn = tmp_path / "sink/pages/page-00000013-torn.jsonl"
    torn.write_text('{"p": 13, "k": 0}\n{"p": 13, ')
    assert commits.read_sink(spark, sink).filter("page = 13").count() == 0
    assert commits.resume(pages(spark, range(1, 16)), sink, batch=3) == 5
    assert not torn.exists() and commits.resume(pages(spark, range(1, 16)), sink) == 0
    got = sorted((r.page, r.item) for r in commits.read_sink(spark, sink).collect())
    assert got == sorted((p, json.dumps({"p": p, "k": k})) for p in range(1, 16) for k in range(p % 4))
    assert {r.page: r.rows for r in commits.committed(spark, sink).collect()} == {p: p % 4 for p in range(1, 16) if p % 4}
    files = {os.path.basename(f) for f in glob.glob(f"{tmp_path}/sink/pages/*.jsonl")}
    assert files == {r.file for r in commits.committed(spark, sink).collect()}


def test_ledger_drops_a_torn_tail(spark, tmp_path):
    path, schema = f"file://{tmp_path}/ledger", "key long, state string, seq long"
    commits.record(spark.createDataFrame([(1, "started", 1), (2, "started", 2), (1, "done", 3)], schema), path)
    (tmp_path / "ledger/part-torn.txt").write_text('{"key": 2, "state": "done", "seq": 4}\n{"key": 3, "state": "do')
    want = {(1, "done", 3), (2, "done", 4)}
    assert {tuple(r) for r in commits.ledger(spark, path, schema, "key").collect()} == want
    commits.compact(spark, path, schema, "key", f"file://{tmp_path}/new")
    assert spark.read.text(f"file://{tmp_path}/new").count() == 2
    assert {tuple(r) for r in commits.ledger(spark, f"file://{tmp_path}/new", schema, "key").collect()} == want


def test_days_ahead_and_retention(spark):
    spark.sql("DROP TABLE IF EXISTS day_log")
    spark.sql("CREATE TABLE day_log (id BIGINT, dt DATE) USING parquet PARTITIONED BY (dt)")
    assert len(commits.ensure_days(spark, "day_log", "2024-03-01", back=1, ahead=2)) == 4
    assert commits.ensure_days(spark, "day_log", "2024-03-01", back=1, ahead=2) == []
    assert commits.ensure_days(spark, "day_log", "2024-03-02", back=1, ahead=2) == ["2024-03-04"]
    spark.sql("INSERT INTO day_log VALUES (1, DATE'2024-02-29'), (2, DATE'2024-03-01')")
    assert commits.drop_days(spark, "day_log", "2024-03-02", keep=1) == ["2024-02-29"] and commits.drop_days(spark, "day_log", "2024-03-02", keep=1) == []
    assert [r.id for r in spark.table("day_log").collect()] == [2]
    assert sorted(commits._days(spark, "day_log")) == ["2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"]


def test_numbers_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(loading, "PART_ROWS", 40)
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    assert {r.k: r.id for r in loading.numbered(rows, ["k"], 10).collect()} == {k: k + 11 for k in range(500)}


def test_loads_keep_their_numbers(spark):
    authors, none = spark.createDataFrame([("ann", "A"), ("bob", "B"), (None, "N")], "slug string, label string"), "id long, label string"
    table, ids, lost = loading.load(spark.createDataFrame([], none), spark.createDataFrame([], "slug string, id long"), authors, ["slug"])
    first = {r.slug: r.id for r in ids.collect()}
    assert sorted(first.values()) == [1, 2, 3] and lost.count() == 0
    again, same, _ = loading.load(table, ids, authors, ["slug"])
    assert {r.slug: r.id for r in same.collect()} == first and sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    more = spark.createDataFrame([("aaa", "C"), ("bob", "B2")], "slug string, label string")
    table, ids, _ = loading.load(table, ids, more, ["slug"])
    assert {r.slug: r.id for r in ids.collect()} == first | {"aaa": 4}
    assert {r.id: r.label for r in table.collect()} == {first["ann"]: "A", first["bob"]: "B2", first[None]: "N", 4: "C"}
    posts = spark.createDataFrame([(10, "bob", "x"), (11, "aaa", "y"), (12, "who", "z")], "source_id long, author string, title string")
    made, post_ids, lost = loading.load(spark.createDataFrame([], "id long, author_id long, title string"), spark.createDataFrame([], "source_id long, id long"), posts, ["source_id"], {"author_id": (ids, ["author"])})
    assert sorted((r.id, r.author_id, r.title) for r in made.collect()) == [(1, first["bob"], "x"), (2, 4, "y")] and [r.source_id for r in lost.collect()] == [12]


def test_verdicts_are_asked_by_content(spark):
    pairs = spark.createDataFrame([("a", "b", 0.7), ("b", "a", 0.7), ("c", "d", 0.6), ("e", "f", 0.6), ("g", "h", 0.9), ("i", "j", 0.2)], "a_name string, b_name string, similarity double")
    h = {(r.a_name, r.b_name): r.h for r in pairs.select("a_name", "b_name", loading.content_hash(F.col("a_name"), F.col("b_name")).alias("h")).collect()}
    assert h["a", "b"] == h["b", "a"]
    verdicts = spark.createDataFrame([(h["a", "b"], True, 2), (h["c", "d"], False, 2), (h["e", "f"], True, 1)], "hash string, same boolean, version int")
    got = {(r.a_name, r.b_name): r.action for r in loading.adjudicated(pairs, verdicts, 2, 0.85, 0.55).collect()}
    assert got == {("a", "b"): "merge", ("b", "a"): "merge", ("c", "d"): "apart", ("e", "f"): "review", ("g", "h"): "merge", ("i", "j"): "apart"}
    open_ = pairs.filter("similarity BETWEEN 0.55 AND 0.85")
    assert {(r.a_name, r.b_name) for r in loading.undecided(open_, verdicts, 2).collect()} == {("e", "f")}
    changed = spark.createDataFrame([("a", "b2")], "a_name string, b_name string")
    assert loading.undecided(changed, verdicts, 2).count() == 1


def replay(spark, folder, out, name):
    q = out.writeStream.outputMode("append").foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={e}")).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


def test_state_by_hash(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "entity_id string, text_hash string, ts timestamp, event_id long"
    steps = [
        [("a", "h1", "2024-01-01 00:00:00", 1), ("b", "h1", "2024-01-01 00:00:00", 2), (None, "x", "2024-01-01 00:00:00", 3)],
        [("a", "h1", "2024-01-01 01:00:00", 4), ("b", "h2", "2024-01-01 01:00:00", 5), ("b", "h3", "2024-01-01 01:10:00", 6)],
        [("a", "h1", "2024-01-01 00:00:00", 1), ("b", "h2", "2024-01-01 01:00:00", 5)],  # replayed
        [("a", "h9", "2024-01-01 03:00:00", 7)],
    ]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, "entity_id string, text_hash string, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = events.changed_by_hash(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), delay="5 hours")
        got = replay(spark, tmp_path, out, "out")
    assert sorted((r.entity_id, r.text_hash, r.event_id) for r in got.collect()) == [("a", "h1", 1), ("a", "h9", 7), ("b", "h1", 2), ("b", "h3", 6)]


def test_messages_pass_once_at_most(spark, tmp_path):
    class Stopped(BaseException):
        pass

    done, lost, stop = [], [], []

    def handle(batch, epoch):
        own = [(epoch, r.event_id) for r in batch.collect()]
        if any(i % 10 == 7 for _, i in own):
            raise ValueError("poison")
        if stop and epoch == 1:
            raise Stopped
        done.extend(own)

    each = events.at_most_once(events.isolated(handle, lambda b, e: lost.extend((e, r.event_id, r.error) for r in b.collect())), f"file://{tmp_path}/begun")
    batch = lambda k: spark.range(k * 20, k * 20 + 20).withColumnRenamed("id", "event_id")
    each(batch(0), 0)
    assert sorted(done) == [(0, i) for i in range(20) if i % 10 != 7] and sorted(x[:2] for x in lost) == [(0, 7), (0, 17)] and {x[2] for x in lost} == {"poison"}
    stop.append(1)
    with pytest.raises(Stopped):
        each(batch(1).filter("event_id % 10 <> 7"), 1)
    stop.clear()
    each(batch(1), 1)  # tried again after the stop: it was acknowledged
    each(batch(2), 2)
    assert len(done) == len(set(done)) == 36 and not any(e == 1 for e, _ in done)


def test_a_stream_with_bounded_batches(spark, tmp_path):
    for k in range(6):
        spark.createDataFrame([(k * 2, "a"), (k * 2 + 1, "b")], "event_id long, type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done, lost = [], []

    def handle(batch, epoch):
        ids = [r.event_id for r in batch.collect()]
        if 5 in ids:
            raise ValueError("poison")
        done.extend(ids)

    each = events.at_most_once(events.isolated(handle, lambda b, e: lost.extend(r.event_id for r in b.collect())), f"file://{tmp_path}/begun")
    for _ in range(2):
        stream = spark.readStream.schema("event_id long, type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(done) == [i for i in range(12) if i != 5] and lost == [5]


@pytest.mark.parametrize("sizes", [[5], [3, 0, 9, 1], list(range(1, 40))])
def test_block_draws_are_one_multinomial(sizes):
    sizes, rounds = np.array(sizes), 4000
    draws = np.array([evaluation.block_draws(sizes, k, rounds, 7) for k in range(len(sizes))])
    n = sizes.sum()
    assert (draws.sum(axis=0) == n).all() and (draws >= 0).all()
    share = sizes / n
    assert draws.mean(axis=1) == pytest.approx(sizes, abs=4 * np.sqrt(n * 0.25 / rounds) + 1e-9)
    assert draws.var(axis=1) == pytest.approx(n * share * (1 - share), rel=0.15, abs=1e-9)


def test_bootstrap_equals_one_machine(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(0.05, 0.3, 300)
    pairs = spark.createDataFrame([(i, 0.0, float(x)) for i, x in enumerate(d)], "query_id long, a double, b double")
    r = evaluation.paired_bootstrap(pairs, 3000, block_rows=40).first()
    means = np.array([d[rng.integers(0, 300, 300)].mean() for _ in range(3000)])
    assert (r.low, r.high) == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=0.006) and r.mean_diff == pytest.approx(d.mean())
    assert r.p_b_better == pytest.approx((means > 0).mean(), abs=0.02)
