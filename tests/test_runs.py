"""Resolution, pairs, searches and runs against brute force on small fixtures."""

import difflib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import evaluation, filters, itinerary, joins, resolution, retrieval, runs

NAMES = [
    "The Ritz-Carlton Jakarta Mega Kuningan", "Ritz Carlton Mega Kuningan", "Padma Resort Ubud", "Padma Resort Legian", "Grand Suite", "Grand Club", "The Grand Bali Beach",
    "Warung Made", "Warung Mades", "Blue Ocean Villas", "Blue Ocean Resort", "Café Bali", "cafe  BALI", "The Beach Club", "Beach Club", "Made's Warung", "", "!!",
]


def words(name):
    plain = re.sub("[’‘'`]", "", name.lower().replace("é", "e"))
    return re.sub("[^a-z0-9]+", " ", plain).strip().split()


def core(name):
    found = words(name)
    return [w for w in found if w not in resolution.GENERIC] or found


def alike(a, b):
    x, y = " ".join(words(a)), " ".join(words(b))
    if x and x == y:
        return 1.0
    s, t = set(core(a)), set(core(b))
    overlap = len(s & t) / len(s | t) if s | t else 0.0
    ratio = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    if len(s & t) >= 2:
        return max(0.9, ratio) if overlap == 1 else 0.7 * overlap + 0.3 * ratio
    return 0.3 * overlap + 0.7 * ratio


def pairs_of(names):
    return {(i, j): alike(names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names)) if core(names[i]) and core(names[j]) and core(names[i])[0] == core(names[j])[0]}


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n, i % 4 + 1) for i, n in enumerate(NAMES)], "id long, name string, n long").repartition(3)


def test_candidate_pairs(names):
    got = {(r.a, r.b): r.similarity for r in resolution.candidate_pairs(names).collect()}
    want = {k: s for k, s in pairs_of(NAMES).items() if s >= resolution.REVIEW}
    assert got == pytest.approx(want) and want
    review = {(r.a, r.b) for r in resolution.review_pairs(names).collect()}
    assert review == {k for k, s in want.items() if s < resolution.AUTO}


def test_clusters(names):
    root = list(range(len(NAMES)))
    for (i, j), s in pairs_of(NAMES).items():
        if s >= resolution.AUTO and root[i] != root[j]:
            lo, hi = sorted((root[i], root[j]))
            root = [lo if r == hi else r for r in root]
    want = {}
    for r in set(root):
        own = [i for i in range(len(NAMES)) if root[i] == r]
        want[r] = (NAMES[max(own, key=lambda i: (i % 4 + 1, len(NAMES[i]), NAMES[i]))], sum(i % 4 + 1 for i in own), len(own))
    assert {r.root: (r.name, r.n, r.members) for r in resolution.clusters(names).collect()} == want
    assert len(want) < len(NAMES)


def test_lookup_takes_the_best(spark, names):
    asked = ["RITZ carlton mega kuningan", "Blue Ocean Vilas", "Warung Madee", "nowhere", "padma resort"]
    m = spark.createDataFrame([(a,) for a in asked], "mention string")
    got = {r.mention: (r.place_id, round(r.similarity, 6)) for r in resolution.lookup(m, names.withColumnRenamed("id", "place_id")).collect()}
    want = {}
    for a in asked:
        same = [i for i, n in enumerate(NAMES) if words(n) == words(a)]
        if same:
            want[a] = (min(same), 1.0)
            continue
        near = [(alike(a, n), -i) for i, n in enumerate(NAMES) if core(n) and core(n)[0] == core(a)[0] and alike(a, n) >= 0.75]
        if near:
            want[a] = (-max(near)[1], round(max(near)[0], 6))
    assert got == want and len(want) >= 3


@pytest.mark.parametrize("at_least", [0.5, 0.8])
def test_token_pairs_equal_brute_force(spark, at_least):
    rng = random.Random(4)
    texts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(9))] for _ in range(120)] + [["a", "b"]] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t array<string>").repartition(3)
    sets = joins.token_sets(df, "id", F.col("t"))
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(frozenset(t), i)
    assert {r.id: r.members for r in sets.collect()} == {i: sum(frozenset(t) == s for t in texts) for s, i in first.items()}
    want = {(min(i, j), max(i, j)): len(s & t) / len(s | t) for s, i in first.items() for t, j in first.items() if i < j and len(s & t) >= at_least * len(s | t) - 1e-9}
    got = {(r.a, r.b): r.similarity for r in joins.token_pairs(sets, at_least).collect()}
    assert got == pytest.approx(want) and want


def test_large_blocks_are_split(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") < 30, "x").otherwise("y").alias("block"))
    known = [i for i in range(40) if i % 5]
    want = sorted((a, b) for a in known for b in known if a < b and (a < 30) == (b < 30))
    for part in (1000, 4):
        assert sorted((r.a_id, r.b_id) for r in joins.block_pairs(df, "block", part=part).collect()) == want


@pytest.mark.parametrize("range_rows", [100_000, 3])
def test_nearest_rank_without_a_list(spark, monkeypatch, range_rows):
    monkeypatch.setattr(evaluation, "RANGE_ROWS", range_rows)
    rng = random.Random(1)
    rows = [(k, rng.randrange(30)) for k in "aabbbcccccccc" for _ in range(rng.randrange(1, 9))] + [("d", 5), ("e", None)]
    got = {r.k: r.value for r in evaluation.nearest_rank(spark.createDataFrame(rows, "k string, v int"), "v", 0.9, ["k"]).collect()}
    by = {k: sorted(v for q, v in rows if q == k and v is not None) for k in "abcd"}
    assert got == {k: v[min(int(len(v) * 0.9), len(v) - 1)] for k, v in by.items()}
    whole = sorted(v for _, v in rows if v is not None)
    assert evaluation.nearest_rank(spark.createDataFrame(rows, "k string, v int"), "v", 0.5).first().value == whole[int(len(whole) * 0.5)]


def test_searches_agree_with_few_and_many_candidates(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "LARGE", 5)
    rows = spark.createDataFrame([(q, i, float((i * 37 + q * 11) % 101)) for q in (1, 2) for i in range(100)], "query_id long, id long, s double")
    asked = []

    def fetch(limit, some):
        asked.append(limit)
        own = rows if some is None else rows.join(some, "id", "left_semi")
        return retrieval.ranked(own, ["query_id"], [F.desc("s"), F.col("id")], limit)

    for keep in (lambda i: i % 2 == 0, lambda i: i < 4, lambda i: i >= 90):
        ids = [i for i in range(100) if keep(i)]
        got = retrieval.retrieve(fetch, 4, spark.createDataFrame([(i,) for i in ids], "id long"))
        for q in (1, 2):
            want = sorted(ids, key=lambda i: (-((i * 37 + q * 11) % 101), i))[:4]
            assert [(r.id, r.rank) for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == [(i, k + 1) for k, i in enumerate(want)]
    assert asked[0] == 16 and asked[1] == 4 and asked[2:] == [16, 4]


def test_covers_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcde") * 2 for _ in range(rng.randrange(5))), " ".join(rng.choice("abcdefg") * 2 for _ in range(rng.randrange(30)))) for i in range(40)] + [(98, None, "aa bb"), (99, "", "")]
    asked = {1: ["aa"], 2: ["aa", "bb"], 3: ["cc", "aa", "ff"]}
    df = spark.createDataFrame(docs, "id long, title string, body string")
    queries = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    got = {(r.query_id, r.id): r.score for r in retrieval.cover_density(retrieval.lexeme_hits(df, {"A": "title", "C": "body"}, queries), queries, 100).collect()}
    want = {}
    for q, ts in asked.items():
        for i, title, body in docs:
            at = [(w, 1.0) for w in (title or "").split()] + [(w, 0.2) for w in body.split()]
            full = [(b, e) for b in range(len(at)) for e in range(b, len(at)) if set(ts) <= {w for w, _ in at[b : e + 1]}]
            covers = [(b, e) for b, e in full if not any((x, y) != (b, e) and b <= x and y <= e for x, y in full)]
            own = [[w for t, w in at[b : e + 1] if t in ts] for b, e in covers]
            if covers:
                want[q, i] = sum(len(o) / sum(1 / w for w in o) / (1 + (e - b) - (len(o) - 1)) for o, (b, e) in zip(own, covers, strict=True))
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 40


def test_no_rung_lets_a_competitor_in(spark):
    rows = spark.createDataFrame([(1, "stay", "active", 1.0), (2, None, "active", 1.0), (3, "eat", "closed", 1.0), (4, "eat", "active", 3.0), (5, "do", None, 9.0), (6, "unknown", "active", 9.0)], "id long, type string, status string, m double")
    rungs = (filters.Rung("a", 2), filters.Rung("b", 5), filters.Rung("c"))
    always = filters.invariant(F.array(F.lit("stay"), F.lit("unknown")), F.col("type"), F.col("status"))
    climb = lambda n: sorted((r.id, r.rung) for r in filters.climb_fetched(lambda g: rows if g.radius_m is None else rows.filter(F.col("m") <= g.radius_m), always, n, rungs, order=[F.col("m"), F.col("id")]).collect())
    assert climb(1) == [(4, 1)] and climb(2) == [(4, 2), (5, 2)] and climb(9) == [(4, 2), (5, 2)]
    nothing = filters.invariant(F.array().cast("array<string>"), F.col("type"), F.col("status"))
    assert rows.filter(nothing).count() == 5
    assert [filters.ladder_target(k, 40) for k in (1, 6, 20)] == [3, 18, 40]


def test_a_rung_is_cut_to_what_a_ladder_can_take(spark):
    import random

    rng = random.Random(17)
    rows = [(g, i, rng.choice("ab"), "active" if rng.random() < 0.9 else "closed", None if rng.random() < 0.01 else float(rng.randrange(300))) for g in ("x", "y", None) for i in range({"x": 2000, "y": 9, None: 700}[g])]
    df = spark.createDataFrame([*rows, *rows[:300]], "g string, id long, type string, status string, m double")
    rungs = (filters.Rung("a", 2), filters.Rung("b", 40), filters.Rung("c"))
    fetch = lambda r: df if r.radius_m is None else df.filter(F.col("m") <= r.radius_m)
    always = filters.invariant(F.array(F.lit("b")), F.col("type"), F.col("status"))
    for slots in (1, 7, 60):
        got = [sorted(tuple(map(str, r)) for r in filters.climb_fetched(fetch, always, slots, rungs, ["g"], [F.col("m"), F.col("id")], near=near).collect()) for near in (F.col("m"), None)]
        assert got[0] == got[1] and len(got[0]) >= slots
    assert filters._nearest(df.filter("g = 'x'").drop("g"), 13, [], F.col("m"), "id").filter("m IS NOT NULL").count() < 100


def test_facets_as_similarity(spark):
    group = pd.DataFrame({"type": ["a", "a", "b", None], "band": ["x", "y", "x", "x"]})
    assert np.allclose(retrieval.facet_matrix("type", "band")(group), [[1, 0.5, 0.5, 1], [0.5, 1, 0, 0], [0.5, 0, 1, 1], [1, 0, 1, 1]])
    pool = spark.createDataFrame([(1, i, i + 1, 1 - i / 10, t, b) for i, (t, b) in enumerate([("a", "x"), ("a", "x"), ("b", "y"), ("a", "y")])], "query_id long, id long, rank int, relevance double, type string, band string")
    picks = retrieval.diversify(pool, 3, caps={}, similarity=retrieval.facet_matrix("type", "band"), needs=("type", "band")).orderBy("pick").collect()
    assert [r.id for r in picks] == [0, 2, 3]  # 0.7 x 0.7 - 0.3 x 0.5 is more than 0.7 x 0.9 - 0.3


def test_new_mentions_only(spark):
    docs = spark.createDataFrame([(1, "we saw Blue Ocean Villas and Blue Ocean Vilas."), (2, "at Warung Made Again we ate"), (3, None), (4, "Monday Morning, nothing"), (5, "to Warung Made.")], "id long, text string")
    places = spark.createDataFrame([(10, "Blue Ocean Villas"), (11, "Warung Made")], "place_id long, name string")
    known = spark.createDataFrame([(5, 11)], "article_id long, place_id long")
    got = {(r.article_id, r.place_id) for r in runs.mention_run(docs, places, known).collect()}
    assert (1, 10) in got and (5, 11) not in got and all(a in (1, 2) for a, _ in got)
    assert runs.mention_run(docs.limit(0), places, known).count() == 0


def test_cells_recall_nine_in_ten(spark):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(12, 32))
    v = kinds[rng.integers(0, 12, 1500)] + 0.7 * rng.normal(size=(1500, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    asked = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    centres = retrieval.fit_cells(df, 24, sample=600)
    index = retrieval.cell_index(df, centres)
    assert index.count() == 1500 and index.select("cell").distinct().count() > 8
    got = {(r.query_id, r.vec_id) for r in retrieval.approximate(index, asked, centres, 10, 6).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit[::50] @ unit.T
    sims[np.arange(30), np.arange(0, 1500, 50)] = -9
    want = {(50 * q, int(i)) for q in range(30) for i in np.argsort(-sims[q])[:10]}
    assert len(got) == 300 and len(got & want) / 300 >= 0.9
    none = df.limit(0)
    assert retrieval.approximate(retrieval.cell_index(none, centres), asked, centres, 10, 6).count() == 0


def test_words_part_where_a_reader_sees_it(spark):
    from meridian.functions import columns as c

    cases = {"<p>a<b>b</b>c</p><p>d</p>": "abc d", "x<br>y<BR/>z": "x y z", "<td>1</td><td>2</td>": "1 2", "<pre-x>q</pre-x>r": "qr", "<i>f</i>oo &amp; <a href='p'>b</a>ar": "foo & bar", "a<!-- c -->b": "ab"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.t for r in df.select("h", c.rendered_text(F.col("h")).alias("t")).collect()} == cases
