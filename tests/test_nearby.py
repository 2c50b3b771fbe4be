"""Rails and joins that meet few rows a subject, against every pair."""

import math
import random

from pyspark.sql import functions as F

from meridian.functions import columns as c
from meridian.operators import joins, nearby, retrieval


def _points(n, seed=5):
    rng = random.Random(seed)
    crowd = [(i, rng.choice(["eat", "do", "shop"]), -6.2 + rng.gauss(0, 0.002), 106.8 + rng.gauss(0, 0.002)) for i in range(n)]
    far = [(n + i, "eat", -6.9 + rng.random(), 106.1 + rng.random()) for i in range(n // 4)]
    return [*crowd, *far, (10_000, "eat", None, 1.0), (10_001, "eat", -6.2, None)]


def _meters(a, b):
    h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * c.EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _first(points, asked, k, most_m):
    near = lambda s: sorted((round(_meters(s, p), 6), p[0]) for p in points if p[2] is not None and p[3] is not None and p[0] != s[0] and p[1] != s[1] and _meters(s, p) <= most_m)
    return {(s[0], i) for s in asked for _, i in near(s)[:k]}


def test_first_around_in_crowds_and_alone(spark):
    points = _points(160)
    asked = [p for p in points if p[0] % 9 == 1 and p[2] is not None]
    places = spark.createDataFrame(points, "id long, type string, lat double, lng double")
    subjects = spark.createDataFrame(asked, "subject_id long, s_type string, s_lat double, s_lng double")
    order, where = [F.round("m", 6), F.col("id")], F.expr("id <> subject_id AND type <> s_type")
    for most_m, expected in ((60_000, 30), (60_000, 2), (900, 30), (nearby.HALF_WAY_M, 5)):
        got = nearby.first_around(subjects, places, 6, order, lambda radius: F.col("m") < radius - 1e-5, where, most_m=most_m, expected=expected)
        assert {(r.subject_id, r.id) for r in got.collect()} == _first(points, asked, 6, most_m)
    assert nearby.first_around(subjects, places.filter("id < 0"), 6, order, lambda radius: F.col("m") < radius, where).count() == 0


def test_a_rail_meets_few_places_a_subject(spark):
    """In a grid of 10,000 places 100 subjects meet some hundreds each, not all."""
    places = spark.range(10_000).select("id", (F.col("id") % 100 * 1e-3).alias("lat"), (F.floor(F.col("id") / 100) * 1e-3).alias("lng"))
    subjects = places.filter("id % 100 = 37").selectExpr("id AS subject_id", "lat AS s_lat", "lng AS s_lng")
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda a, b: seen.add(1) or a != b, "boolean").asNondeterministic()
    got = nearby.first_around(subjects, places, 6, [F.round("m", 6), F.col("id")], lambda radius: F.col("m") < radius - 1e-5, count("id", "subject_id"))
    assert got.count() == 600 and seen.value < 100 * 1000


def test_heads_hold_what_is_left_when_a_series_goes(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "x", "y", None]), rng.randrange(6)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, s string, d int")
    order = [F.desc("d"), F.col("id")]
    sort = lambda l: [r[0] for r in sorted(l, key=lambda r: (-r[3], r[0]))]
    for k in (1, 2, 3):
        few = [tuple(r) for r in retrieval.heads(df, ["g"], order, k, "s").collect()]
        one = [tuple(r) for r in retrieval.heads(df, ["g"], order, k).collect()]
        assert len(few) <= 4 * max(k, 2) and len(one) == 2 * (k + 1)
        for x in rows:
            left = lambda l, x=x: [r for r in l if r[1] == x[1] and r[0] != x[0] and not (r[2] is not None and r[2] == x[2])]
            assert sort(left(few))[:k] == sort(left(rows))[:k]
            other = lambda l, x=x: [r for r in l if r[1] == x[1] and r[0] != x[0]]
            assert sort(other(one))[:k] == sort(other(rows))[:k]


def test_close_pairs_in_one_large_block(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in rng.sample(range(-200, 900), 400)]
    got = joins.close_pairs(spark.createDataFrame(rows, "id long, block string"), "block", 50).collect()
    assert sorted((r.block, r.a, r.b) for r in got) == sorted((x, a, b) for a, x in rows for b, y in rows if x is not None and x == y and 0 < b - a < 50)


def test_nearest_holds_little_and_breaks_ties_by_key(spark, monkeypatch):
    """Tiles of a few similarities and blocks of a few queries give what all at once gives; copies of one vector come by key."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 5)).round(1)
    rows = [(i, [float(x) for x in base[i * 7 % 30]]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = v.filter("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    unit = np.array([x for _, x in rows]) / np.linalg.norm([x for _, x in rows], axis=1, keepdims=True)
    want = set()
    for q in range(0, 150, 10):
        near = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(150) if i != q)
        want |= {(q, i) for _, i in near[:7]}
    monkeypatch.setattr(retrieval, "TILE", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    assert {(r.query_id, r.vec_id) for r in retrieval.nearest(v, asked, 7).collect()} == want
    centres = retrieval.fit_cells(v, 4)
    found = retrieval.approximate(retrieval.cell_index(v, centres), asked, centres, 7, 4)
    assert {(r.query_id, r.vec_id) for r in found.collect()} == want
    best = retrieval._Best(1, 7)
    for k in range(0, 100_000, 1000):
        best.take(np.array([0]), np.arange(k, k + 1000), rng.standard_normal((1, 1000)))
    assert len(best.q) == 7


def test_pairs_near_poles_and_equator_are_merged_once_and_never_broadcast(spark):
    rng = random.Random(11)
    points = [(i, "x", lat + rng.uniform(-0.6, 0.6), rng.uniform(10, 13)) for i, lat in enumerate([-75, -0.1, 0.3, 75] * 40)]
    df = spark.createDataFrame(points, "id long, type string, lat double, lng double")
    got = joins.within_distance(df, 30_000.0, part=3)
    small = spark.range(300).selectExpr("id", "-6.2 + id * 1e-4 AS lat", "106.8D AS lng")
    assert "BroadcastHashJoin" not in joins.within_distance(small, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and _meters(a, b) <= 30_000.0)


def test_nearest_node_aggregates_one_row_a_place(spark):
    rng = random.Random(13)
    nodes = [(k, -6.3 + k % 5 * 0.05, 106.7 + k // 5 * 0.05) for k in range(25)] + [(99, -6.3, 106.7)]
    points = _points(60)
    df, vocabulary = spark.createDataFrame([*points, (20_000, "far", 50.0, 8.0), (20_001, "on", -6.3, 106.7)], "id long, type string, lat double, lng double"), spark.createDataFrame(rng.sample(nodes, 26), "node_id long, node_lat double, node_lng double")
    want = {}
    for p in [*points, (20_001, "on", -6.3, 106.7)]:
        if p[2] is not None and p[3] is not None:
            m, node = min((_meters(p, (0, "", y, x)), k) for k, y, x in nodes)
            if m <= 60_000:
                want[p[0]] = (node, round(m, 3))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = joins.nearest_node(df, vocabulary, 60_000)
        assert {r.id: (r.node_id, round(r.meters, 3)) for r in got.collect()} == want

        def most(plan):
            own = plan.metrics().get("numOutputRows")
            kids = plan.children()
            return max([own.get().value() if own.isDefined() else 0, *(most(kids.apply(i)) for i in range(kids.size()))])

        assert most(got._jdf.queryExecution().executedPlan()) <= len(points) + 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
