"""Periodic runs against brute force: every lag, every stretch, whole tables and dealt lag ranges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meridian.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, start int, d string, k string, text_key string"


def brute_runs(ws, exponent=4, least=6):
    """(start, length, period) of maximal stretches whose smallest period is the lag."""
    n, out = len(ws), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            part = ws[i : j + q]
            if len(part) >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, ws):
    if doc_id is None or not ws:
        return ws
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return ws
    n, g = len(ws), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    ws = brute_planted(doc_id, [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])
    runs = brute_runs(ws)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(((-n, s, q) for s, n, q in runs), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))


def wordy(rng, kinds=3):
    """Words of a small vocabulary with runs of runs: squares, powers, a period inside a period."""
    out = []
    for _ in range(rng.randrange(1, 7)):
        unit = [rng.choice("abcdef"[:kinds]) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            unit = unit[:2] * rng.randrange(2, 6) + [rng.choice("xyz")]
        out += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
    return out


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 10)])
def test_runs_of_a_batch(exponent, least):
    rng = random.Random(3)
    texts = [[w.encode() for w in wordy(rng, rng.randrange(1, 5))] for _ in range(300)] + [[], [b"a"], [b"a"] * 6, [b"a"] * 5]
    assert periodic.runs_of(texts, exponent, least) == [brute_runs(ws, exponent, least) for ws in texts]


def test_lag_ranges_find_what_one_scan_finds():
    rng = random.Random(4)
    for k in range(60):
        ws = [w.encode() for w in wordy(rng, 2) * rng.randrange(1, 4)] if k else [b"a"] * 900
        ids = periodic.word_ids(ws)
        for work in (1, 50, 3000):
            ranges = periodic.lag_ranges(len(ids), work)
            assert [lag for lo, hi in ranges for lag in range(lo, hi)] == list(range(1, len(ids) // 4 + 1))
            found = [r for lo, hi in ranges for r in periodic.scan(ids, np.array([len(ids)]), lo, hi)]
            assert sorted(found, key=lambda r: (r[0], r[2])) == brute_runs(ws)


def rows():
    rng = random.Random(5)
    texts = [" ".join(wordy(rng)) for _ in range(60)] + ["\n".join(wordy(rng, 5)) + "\t日本 é" for _ in range(20)]
    texts += ["a " * 3000, "x y " * 2000 + "z", " ".join(str(i) for i in range(800))]
    out = list(enumerate(texts))
    return out + [(900, None), (901, ""), (902, " \n "), (3, texts[4]), (3, texts[4]), (None, texts[5]), (None, None), (-7, texts[6])]


@pytest.mark.parametrize("long,work", [(1 << 20, 1 << 22), (40, 30), (0, 500)])
def test_whole_table(spark, long, work):
    docs = rows()
    df = spark.createDataFrame([(i, t, "r", 1, "d", "k", "t") for i, t in docs], SCHEMA).repartition(3)
    held = df.withColumn("text", periodic.planted(df.text, df.doc_id))
    got = [tuple(r) for r in periodic.digest(periodic.find(held, long=long, work=work)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(i, t) for i, t in docs), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in docs if i is not None and t)
    assert periodic.find(df.limit(0), long=long).count() == 0


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "so  a b a b a b a b a\nend"), (2, "a b a b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic.find(df).collect()}
    assert got == {1: (11, [(1, 9, 2)], "so a b end"), 2: (4, [], "a b a b")}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    small = {i for i, t in docs if len(t or "") < 1500}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert {i: got[i] for i in small} == {i: brute_row(i, t) for i, t in docs if i in small}
