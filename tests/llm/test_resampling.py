"""Importance resampling against brute force over every run of words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meridian.llm import resampling, queries

SCHEMA = "doc_id long, text string, rank string, weight int, __d string, bucket int"


def features(text, width=3):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, width + 1) for i in range(len(ws) - k + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    rows = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        rows.append((i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(can[: percent * len(can) // 100]):
        rank.setdefault(r[0], []).append(k + 1)
    return sorted(((r[0], r[2], r[3], r[4]) for r in rows), key=str), rank


def texts(n=90):
    rng = random.Random(1)
    kinds = ["Alpha", "beta", "GAMMA", "délta", "日本", "x" * 300, "a1", "b", "né-e"]
    make = lambda k: "".join(rng.choice(kinds) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(k))
    out = [(i, make(rng.randrange(1, 120))) for i in range(n)]
    return out + [(500, None), (501, ""), (502, " ,.- "), (3, out[4][1]), (3, out[4][1]), (None, out[5][1]), (None, None), (-4, make(3000))]


def test_checksums_of_runs():
    rng = random.Random(2)
    words = [bytes(rng.randrange(33, 127) for _ in range(rng.choice([1, 2, 7, 40, 1000]))) for _ in range(200)]
    docs = np.sort(np.array([rng.randrange(20) for _ in words]))
    for k, (crc, of) in enumerate(resampling.run_checksums(words, docs, 4)):
        runs = [(b" ".join(words[i : i + k + 1]), docs[i]) for i in range(len(words) - k) if docs[i] == docs[i + k]]
        assert crc.tolist() == [zlib.crc32(r) for r, _ in runs] and of.tolist() == [d for _, d in runs]
    assert [len(crc) for crc, _ in resampling.run_checksums([], np.zeros(0, np.int64))] == [0, 0, 0]


@pytest.mark.parametrize("block,piece", [(1 << 20, 4 << 20), (700, 64)])
def test_whole_table(spark, monkeypatch, block, piece):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "SLICE", piece)
    docs, target = texts(), ["alpha beta gamma", None, "", "Délta alpha ALPHA 日本 b"]
    df = spark.createDataFrame([(i, t, "r", 1, "d", 2) for i, t in docs], SCHEMA).repartition(3)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = resampling.draw(df, goal, percent=20).collect()
    rows, rank = brute(docs, target, percent=20)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == rows
    mine = {}
    for r in sorted((r for r in got if r.rank is not None), key=lambda r: r.rank):
        mine.setdefault(r.doc_id, []).append(r.rank)
    assert mine == rank and rank
    chosen = resampling.resample(df, goal, percent=20)
    assert chosen.columns == [c for c in df.columns if c != "rank"] + ["rank"]
    assert sorted({r.doc_id for r in chosen.collect()}, key=str) == sorted(rank, key=str)
    assert resampling.draw(df.limit(0), goal).count() == 0
    assert resampling.draw(df, goal.limit(0)).count() == len(docs)


def test_ranks_of_many_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meridian.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 50)
    rows = spark.range(1000).select("id", (F.col("id") % 37).alias("score"))
    order = [F.col("score").desc(), F.col("id").asc()]
    want = {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 37), i)))}
    assert {r.id: r.rank for r in common.ranked(rows, order, 1000).collect()} == want
    assert {r.id: r.rank for r in common.ranked(rows, order, 1000, 130).collect()} == {i: k if k <= 130 else None for i, k in want.items()}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = queries.op12_importance_resampling(spark, sf_dir).collect()
    rows, rank = brute(docs, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == rows
    assert {r.doc_id: [r.rank] for r in got if r.rank is not None} == rank
