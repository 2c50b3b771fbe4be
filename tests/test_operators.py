"""Operators on small tables by hand."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.functions import columns as c
from meridian.operators import behaviour, cues, evaluation, filters, integrity, itinerary, joins, merge, resolution, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_covisitation_is_directed_and_distinct(spark):
    visits = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "b"), ("s3", "a"), (None, "a"), ("s4", None)], "session_id string, entity_id string")
    got = {(r.entity_a, r.entity_b): r.score for r in behaviour.covisitation(visits).collect()}
    assert got == {("a", "b"): pytest.approx(2 / 3), ("b", "a"): 1.0}
    assert behaviour.covisitation(visits, 3).count() == 0


def test_taste_takes_newest_rows_before_weights(spark):
    rows = [(i, 1, str(i % 3), "dwell", 1000 + i, 10, 0) for i in range(20)] + [(99, 1, "9", "click", 10, 0, 0)]
    log = spark.createDataFrame(rows, "event_id long, user_id long, entity_id string, kind string, sec long, dwell_ms long, scroll_pct long")
    assert behaviour.taste_inputs(log, 2000).count() == 0  # twenty weak rows push the click out
    assert behaviour.taste_inputs(log, 2000, rows=21).collect()[0].weight == 0.3


def test_excluded_types_of_all_four_subjects(spark):
    rel = spark.createDataFrame([("stay", True, ["eat"], []), ("eat", True, [], ["drink"]), ("do", False, [], [])], "type string, exclude_same boolean, complements array<string>, competes_with array<string>")
    got = {r.subject_type: r.excluded for r in filters.excluded_types(rel).collect()}
    assert got == {"stay": ["stay", "unknown"], "eat": ["drink", "eat", "unknown"], "do": [], None: ["drink", "eat", "stay", "unknown"]}


@pytest.mark.parametrize(("day", "minute", "open_"), [(2, 18 * 60, True), (3, 60, True), (3, 3 * 60, False), (2, 60, False)])
def test_hours_past_midnight(spark, day, minute, open_):
    hours = F.from_json(F.lit('[{"day":2,"opens":1080,"closes":120}]'), "array<struct<day:int,opens:int,closes:int>>")
    assert one(spark, filters.open_at(hours, day, minute)) is open_


def test_unknown_hours_are_open(spark):
    assert one(spark, filters.open_at(F.lit(None).cast("array<struct<day:int,opens:int,closes:int>>"), 1, 1))


def test_ladder_stops_at_the_first_filled_rung(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, m double")
    rungs = (filters.Rung("a", 2), filters.Rung("b", 5), filters.Rung("c"))
    holds = lambda g: F.lit(True) if g.radius_m is None else F.col("m") <= g.radius_m
    got = filters.climb(rows, holds, 4, rungs, order=[F.col("m")]).collect()
    assert [r.id for r in got] == [0, 1, 2, 3] and {r.rung for r in got} == {1}
    got = filters.climb(rows, holds, 40, rungs, order=[F.col("m")]).collect()
    assert len(got) == 10 and {r.rung for r in got} == {2}
    assert filters.climb(rows.limit(0), holds, 4, rungs, order=[F.col("m")]).count() == 0


def test_blend_leaves_out_nulls(spark):
    parts = {"semantic": F.lit(0.8), "covis": F.lit(None).cast("double"), "quality": F.lit(0.5)}
    assert one(spark, c.blend(parts)) == pytest.approx((0.35 * 0.8 + 0.2 * 0.5) / 0.55)
    assert one(spark, c.blend({"semantic": F.lit(None).cast("double")})) == 0.0


def test_freshness(spark):
    f = lambda fmt, age, conf, src: one(spark, c.freshness(F.lit(fmt).cast("string"), F.lit(age).cast("double"), F.lit(conf).cast("double"), F.lit(src).cast("string")))
    assert f("news", 21, 0.9, "ai") == pytest.approx(0.5)
    assert f("news", 365, 0.2, "ai") == pytest.approx(0.5)  # not trusted: the default curve
    assert f("guide", None, None, "editor") == 1.0
    assert f(None, 3, None, "editor") is None


def test_fusion_ties_break_on_the_string(spark):
    a = spark.createDataFrame([(1, 9, 1), (1, 10, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 9, 2)], "query_id long, id long, rank int")
    assert [r.id for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == [10, 9]


def test_mmr_respects_caps_and_stops(spark):
    rows = [(1, i, i + 1, 1.0 - i / 10, [1.0, float(i)], 7, None, None, False) for i in range(3)]
    pool = spark.createDataFrame(rows, "query_id long, id long, rank int, relevance double, embedding array<double>, org_id long, area_term string, format string, paid boolean")
    assert [r.id for r in retrieval.diversify(pool, 3).collect()] == [0]
    assert sorted(r.id for r in retrieval.diversify(pool, 3, caps={"org_id": 5}).collect()) == [0, 1, 2]


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "vec_id long, embedding array<double>").repartition(5)
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {}
    for r in retrieval.nearest(v, q, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in (0, 20, 40):
        s = u @ u[i]
        s[i] = -2
        assert [x for _, x in sorted(got[i])] == np.argsort(-s)[:4].tolist()


def test_ndcg_by_hand(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query_id string, id string, rank int")
    grades = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 2.0)], "query_id string, id string, grade double")
    got = {r.query_id: r.ndcg for r in evaluation.ndcg(ranked, grades, 3).collect()}
    dcg = 1 / math.log2(3) + 3 / math.log2(4)
    assert got["q"] == pytest.approx(dcg / (3 / math.log2(2) + 1 / math.log2(3))) and got["z"] == 0.0


def test_bootstrap_brackets_the_mean(spark):
    pairs = spark.createDataFrame([(i, 0.0, 0.1 + i % 3 / 10) for i in range(60)], "query_id long, a double, b double")
    r = evaluation.paired_bootstrap(pairs, 300).first()
    assert r.low < r.mean_diff < r.high and r.p_b_better == 1.0


def test_erf(spark):
    for x in (-2.0, 0.0, 0.5, 1.7):
        assert one(spark, c.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=2e-7)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lat1=st.floats(-80, 80), lng1=st.floats(-179, 179), lat2=st.floats(-80, 80), lng2=st.floats(-179, 179))
def test_haversine_is_a_distance(spark, lat1, lng1, lat2, lng2):
    d = lambda a, b, x, y: one(spark, c.haversine_m(F.lit(a), F.lit(b), F.lit(x), F.lit(y)))
    assert d(lat1, lng1, lat2, lng2) == pytest.approx(d(lat2, lng2, lat1, lng1), abs=1e-3)
    assert 0 <= d(lat1, lng1, lat2, lng2) <= math.pi * c.EARTH_M + 1


@pytest.mark.parametrize("part", [1000, 4])
def test_spatial_pairs_equal_all_pairs(spark, part):
    import random

    rng = random.Random(3)
    pts = [(i, rng.uniform(59.9, 60.1), rng.uniform(10.0, 10.4)) for i in range(120)]
    places = spark.createDataFrame([*pts, (500, None, 1.0)], "id long, lat double, lng double")
    got = {(r.a, r.b) for r in joins.within_distance(places, 3000.0, part=part).collect()}

    def far(p, q):
        x, y = math.radians(q[1] - p[1]) / 2, math.radians(q[2] - p[2]) / 2
        return 2 * c.EARTH_M * math.asin(math.sqrt(math.sin(x) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(y) ** 2))

    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and far(p, q) <= 3000}


def test_interval_join_equals_the_plain_one(spark):
    v = spark.createDataFrame([(i, i % 3, i * 37 % 500) for i in range(40)], "event_id long, k long, sec long")
    m = spark.createDataFrame([(i % 3, i * 53 % 500) for i in range(30)], "k long, sec long")
    got = sorted((r.event_id, r.mark_at) for r in behaviour.interval_join(v, m, "k", 5, 30).collect())
    assert got == sorted((i, s) for i, k, x in [(i, i % 3, i * 37 % 500) for i in range(40)] for kk, s in [(i % 3, i * 53 % 500) for i in range(30)] if k == kk and x - 5 <= s <= x + 30)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.range(62).unionAll(spark.range(100, 102)).toDF("node")
    got = {r.node: r.root for r in resolution.components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[61] == 61 and got[101] == 100


def test_names(spark):
    sim = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(resolution.name_similarity(F.col("a"), F.col("b")).alias("s")).first().s
    assert sim("Café Bali", "cafe  BALI") == 1.0
    assert sim("Blue Ocean Resort", "Blue Ocean Villas") >= resolution.AUTO
    assert sim("Blue Ocean", "Green Hill") < resolution.REVIEW


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, merge.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, merge.upsert(old, new, ["id"], update=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert {tuple(r) for r in merge.snapshot_diff(old, new, ["id"]).collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_cues_need_the_title(spark):
    docs = spark.createDataFrame([(1, "hotel hotel", "x"), (2, "nothing", "hotel " * 50)], "id long, title string, text string")
    got = {r.id: r.cue.value for r in cues.score(docs, "title", "text", {"stay": [("hotel", 2.0)], "eat": [("food", 2.0)]}).collect()}
    assert got == {1: "stay", 2: None}


def test_schemas(spark):
    a, b = spark.range(1), spark.range(1).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("n"))
    assert integrity.schema_hash(a) != integrity.schema_hash(b)
    assert integrity.schema_diff(a, b) == [("id", "changed", "bigint", "string"), ("n", "added", None, "int")]


def test_ids(spark):
    ok = lambda t: one(spark, integrity.valid_native_id(F.lit(t)))
    assert ok("0") and ok("2147483647") and not ok("2147483648") and not ok("007") and not ok("x")
    assert one(spark, integrity.valid_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) and not one(spark, integrity.valid_uuid(F.lit("123")))


HTML = """<head><title>t</title></head><h2>Head</h2><p>One <b>two</b></p><p> </p><ul><li>a<li>b</li></ul><blockquote>said</blockquote><img src="u.jpg" alt="x"><iframe src="https://youtube.com/e"></iframe><hr><div class="wp-block-columns"><div class="wp-block-column"><p>inner</p></div></div><script>no()</script>"""


def test_blocks(spark):
    from meridian.operators import content

    rows = content.with_blocks(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>open")], "id long, html string")).select("id", "blocks", content.text_of(F.col("blocks")).alias("t"), content.stats(F.col("blocks")).alias("s")).orderBy("id").collect()
    assert [b.type for b in rows[0].blocks] == ["heading", "paragraph", "list", "quote", "image", "embed", "separator", "paragraph"]
    assert rows[0].blocks[2]["items"] == ["a", "b"] and rows[0].blocks[0].level == 2 and rows[0].blocks[-1].path
    assert rows[0].t == "Head One two a b said inner" and (rows[0].s.headings, rows[0].s.media) == (1, 2)
    assert rows[1].blocks == [] and rows[2].t == "open"
    assert one(spark, content.provider(F.lit("https://youtube.com/e"))) == "youtube"
    assert one(spark, content.content_loss(F.lit("ab cd"), F.lit("abc"))) == 25.0


def test_sources_and_srcsets(spark):
    html = '<img src="a.jpg" srcset="b.jpg 300w, c.jpg 2x">'
    assert one(spark, c.sources(F.lit(html))) == ["a.jpg", "b.jpg", "c.jpg"]


def test_blocks_of_many_pages_in_one_batch(spark):
    """More pages in a batch than are held as objects at once, nulls among them, each with its own blocks."""
    from meridian.operators import content

    pages = [(i, None if i % 50 == 0 else f"<h2>T{i}</h2><p>a {i}</p>") for i in range(2 * content.AT_ONCE + 9)]
    got = content.with_blocks(spark.createDataFrame(pages, "id long, html string").coalesce(1)).collect()
    assert {r.id: [b.asDict() for b in r.blocks] for r in got} == {i: content.parse_blocks(h) for i, h in pages}
