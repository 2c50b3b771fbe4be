"""Queries of ladders with invariants, constrained search, whole runs and checks of itineraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import cues
from ..operators import evaluation as e
from ..operators import filters as f
from ..operators import itinerary as it
from ..operators import resolution as res
from ..operators import retrieval as r
from ..operators import runs
from ..streaming import events as ev
from .candidates import CENTER
from .catalogue import _unescape
from .fixtures import ctes, interactions, table
from .measures import _SQL_RANKED, _ranked, _slots
from .ranking import _D, _cue_sql, _docs, _tok, _vectors, CUES

_RUNGS = (f.Rung("r2", 2000), f.Rung("r5", 5000), f.Rung("r15", 15000), f.Rung("all"))


def B14_ladder_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of subject climbs over rungs whose fetch knows nothing of competitors or closed places."""
    subjects = f.excluded_types(table(spark, sf_dir, "relations")).select(F.coalesce("subject_type", F.lit("(none)")).alias("subject_type"), "excluded")
    meters = c.haversine_m(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("lat"), F.col("lng"))
    met = table(spark, sf_dir, "places").filter("lat IS NOT NULL").withColumn("m", meters).crossJoin(F.broadcast(subjects))
    fetch = lambda g: met if g.radius_m is None else met.filter(F.col("m") <= g.radius_m)
    always = f.invariant(F.col("excluded"), F.col("type"), F.col("status"))
    return f.climb_fetched(fetch, always, f.ladder_target(6, 40), _RUNGS, ["subject_type"], [F.round("m", 6), F.col("id")], near=F.round("m", 6)).select("subject_type", "id", "type", "rung")


def F13_ladder_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type and price of places as a pool, and one to twenty slots: how many rows to ask for."""
    pools = table(spark, sf_dir, "places").groupBy("type", "price_band").agg(F.count("*").alias("pool"))
    asked = pools.select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    return asked.select("type", "price_band", "k", "pool", f.ladder_targets(F.col("k"), F.col("pool")).alias("target"))


def _closest(spark: SparkSession, sf_dir: str, candidates: DataFrame, limit: int) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return r.retrieve(lambda n, some: r.nearest(v, asked, n, candidates=some), limit, candidates, "vec_id")


def F7_few_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closest(spark, sf_dir, _vectors(spark, sf_dir).filter("label = 3").select("vec_id"), 8)


def F7_many_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closest(spark, sf_dir, _vectors(spark, sf_dir).filter("vec_id % 3 <> 0").select("vec_id"), 8)


def I3_approximate_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's ten nearest, from 40 of 64 cells: these vectors hardly cluster, and this recalls 0.92 of I2's at sf0.1 (0.96 at sf0.01)."""
    v = _vectors(spark, sf_dir)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    centres = r.fit_cells(v, 64)
    return r.approximate(r.cell_index(v, centres), asked, centres, 10, 40)


def M1_facet_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks from each area's best places, unlike by type and price band; half a point of relevance a tenth of a rank."""
    p = table(spark, sf_dir, "places").filter("status = 'active' AND area_term IS NOT NULL")
    pool = r.ranked(p, ["area_term"], [F.desc(F.col("id") % 101), F.col("id")], r.POOL).withColumn("relevance", 1 - F.col("rank") / 80.0)
    rows = pool.select(F.col("area_term").alias("query_id"), "id", "rank", "relevance", "type", "price_band", "org_id")
    return r.diversify(rows, 6, caps={"org_id": 1}, similarity=r.facet_matrix("type", "price_band"), needs=("type", "price_band")).withColumnRenamed("query_id", "area_term")


def I13_rail_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rails of every hundredth article: three others of its language and of its type, newest first; even hundreds are cached, some too long ago."""
    a = table(spark, sf_dir, "articles").filter("status = 'published' AND published_day IS NOT NULL").select("id", "lang", "primary_type", "published_day")
    subjects = a.filter("id % 100 = 2").select(F.col("id").alias("subject_id"), F.col("lang").alias("s_lang"), F.col("primary_type").alias("s_type"))
    order = [F.desc("published_day"), F.col("id")]
    rail = lambda own, theirs: r.ranked(r.heads(a.filter(F.col(theirs).isNotNull()), [theirs], order, 3).join(subjects.select("subject_id", F.col(own).alias(theirs)), theirs).filter("id <> subject_id"), ["subject_id"], order, 3)
    cached = subjects.filter("subject_id % 200 = 2").select("subject_id", F.explode(F.array(F.lit("language"), F.lit("type"))).alias("rail"), (F.col("subject_id") + 1).alias("id"), F.lit(1).alias("rank"), F.when(F.col("subject_id") % 400 == 2, 595).otherwise(500).alias("computed_at"))
    return runs.bundle(subjects, cached, {"language": rail("s_lang", "lang"), "type": rail("s_type", "primary_type")}, F.lit(600), F.lit(6))


def I27_tagging_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents by words of title, lead and body and by closeness to the centroids of terms, less what editors have tagged."""
    words = spark.createDataFrame([(201, "ther"), (202, "tion"), (203, "erth"), (204, "eaux")], "term_id long, word string")
    docs = _docs(spark, sf_dir).withColumns({"lead": F.substring("text", 1, 400), "body": F.substring("text", 401, 1200)})
    lexical = r.tag(docs, words, {"A": "title", "B": "lead", "C": "body"}).withColumnRenamed("id", "entity_id")
    tags, v = table(spark, sf_dir, "entity_terms"), _vectors(spark, sf_dir).select("vec_id", "embedding")
    tagged = tags.filter("term_id >= 200").withColumn("vec_id", F.col("entity_id") % 500).join(v, "vec_id")
    close = tagged.join(r.mean_vectors(tagged, ["term_id"]), "term_id").select("entity_id", "term_id", F.round(c.cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))
    edited = tags.filter("source = 'ai' AND entity_id % 5 = 0").select("entity_id", "term_id")
    return runs.tagging_run(lexical, close, edited)


def J7_mention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of places put into texts, found there again; every fourth mention is known already."""
    places = table(spark, sf_dir, "places").groupBy("name").agg(F.min("id").alias("place_id"))
    named = places.select(F.col("place_id").alias("p"), F.initcap("name").alias("name"))
    docs = table(spark, sf_dir, "documents").withColumn("p", F.col("doc_id") % 97 + 1).join(named, "p", "left").select(F.col("doc_id").alias("id"), F.concat(F.lit("we saw "), F.coalesce("name", F.lit("nothing")), F.lit(", then left. "), F.lower("text")).alias("text"))
    known = docs.filter("id % 4 = 0").select(F.col("id").alias("article_id"), (F.col("id") % 97 + 1).alias("place_id"))
    return runs.mention_run(docs, places.select("place_id", F.initcap("name").alias("name")), known)


def J14_geocode_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by name: a few set by hand, the rest where an earlier run or their address has put them, some outside the country."""
    p = table(spark, sf_dir, "places")
    rows = p.select("id", "name", F.when(F.col("id") % 3 != 0, F.concat(F.lit("Jalan 5, "), "area_term")).alias("address"))
    at = p.groupBy(c.slugify(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    point = lambda rows, lat, lng: rows.select("key", lat.alias("lat"), lng.alias("lng"))
    hand = point(at.filter("id % 10 = 1"), F.lit(-6.5), F.lit(106.5))
    old = point(at.filter("id % 2 = 0"), F.when(F.col("id") % 8 == 0, 50.0).otherwise(-6.4), F.lit(106.9))
    address = point(at.filter("id % 3 <> 0"), F.lit(-6.3), F.lit(107.0))
    areas = spark.createDataFrame([(i, f"area{i}", 1) for i in range(12)], "area_id long, name string, depth int")
    return runs.geocode_run(rows, [("override", hand), ("existing", old), ("address", address)], areas)


def P8_stated_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers who picked two terms each; the last one's is no term, so that no vector can have its id."""
    picks = spark.range(1, 13).select(F.col("id").alias("user_id"), F.explode(F.array(F.col("id") % 10 + 200, F.col("id") % 25 + 100)).alias("term_id")).filter("user_id < 12").unionAll(spark.createDataFrame([(12, None)], "user_id long, term_id long"))
    v = _vectors(spark, sf_dir)
    terms, articles = v.select(F.col("vec_id").alias("term_id"), "embedding"), v.select(F.col("vec_id").alias("entity_id"), "embedding")
    seeds = runs.stated_seed(picks, terms, table(spark, sf_dir, "entity_terms"), articles)
    return seeds.select("user_id", F.round(F.col("vector")[0], 6).alias("x0"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def P6_saved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases save, errors take back."""
    log = interactions(spark, sf_dir).filter("kind IN ('purchase', 'error')").select("user_id", "entity_id", F.when(F.col("kind") == "purchase", "save").otherwise("remove").alias("action"), F.col("sec").alias("at"), "event_id")
    return runs.saved_items(log, 10)


def O7_click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = interactions(spark, sf_dir).filter("kind = 'click'").select("event_id", F.col("sec").alias("at"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("0"), "entity_id")).otherwise(F.col("entity_id")).alias("place_id"), F.concat(F.lit("https://partner.example.com/"), F.col("entity_id"), F.when(F.col("event_id") % 2 == 0, "?a=1").otherwise("")).alias("href"), F.when(F.col("event_id") % 3 == 0, "paid").when(F.col("event_id") % 3 == 1, "listed").otherwise("free").alias("tier"))
    return runs.click_events(clicks, "guide")


def O4_triage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places")
    verdict = F.when(F.col("id") % 7 == 0, "junk").when(F.col("id") % 5 == 0, "suspect").otherwise("ok")
    region = F.when(F.col("id") % 11 == 0, "outside").otherwise("inside")
    found = runs.triage_scores(p, verdict, region, F.col("id") % 3, F.col("id") % 13 == 0)
    return found.groupBy("action", "score").agg(F.count("*").alias("n"))


def N6_slot_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of each customer's trip: lunch at their hour, for some a night slot, for some a shorter evening with food alone."""
    defaults = _slots(spark).filter("day = 0").select("slot", "types", "opens", "closes")
    k = F.col("c_custkey")
    null = F.lit(None).cast("int")
    row = lambda slot, types, opens, closes: F.struct(F.lit(slot).alias("slot"), F.array(*map(F.lit, types)).alias("types") if types else F.lit(None).cast("array<string>").alias("types"), opens.cast("int").alias("opens"), closes.cast("int").alias("closes"))
    some = F.array_compact(F.array(row("lunch", (), 690 + k % 30, null), F.when(k % 2 == 0, row("night", ("drink",), F.lit(1380), F.lit(1500))), F.when(k % 5 == 0, row("evening", ("eat",), null, F.lit(1300)))))
    asked = table(spark, sf_dir, "customer").select(k.alias("request_id"), F.explode(some).alias("s")).select("request_id", "s.*")
    return it.override_slots(defaults, asked).select("request_id", "slot", F.array_join("types", ",").alias("types"), "opens", "closes")


def K8_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as queries, by the last digit of their name."""
    ranked, grades = _ranked(spark, sf_dir)
    groups = ranked.select("query_id").distinct().withColumn("grp", F.substring("query_id", -1, 1))
    found = e.group_means(e.metric_bundle(ranked, grades, 10), groups, "grp")
    return found.select("grp", "queries", *[F.round(x, 6).alias(x) for x in ("ndcg", "recall", "hit", "mrr")])


def I28_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length against an order by hash, over sources as queries."""
    ranked, grades = _ranked(spark, sf_dir)
    other = r.ranked(ranked.drop("rank"), ["query_id"], [c.stable_rank("m", F.col("id"))])
    found = e.compare_systems(e.metric_bundle(ranked, grades), e.metric_bundle(other, grades))
    return found.select("metric", *[F.round(x, 6).alias(x) for x in ("mean_a", "mean_b", "diff")], "wins", "losses")


def K15_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as timings of their type."""
    return e.latencies(interactions(spark, sf_dir), "value", ["kind"])


def L2_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked documents against an index that lacks some and has others' old text; every ninth isn't published."""
    text = F.sha2("text", 256)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "doc_id", text.alias("text_hash"))
    index = docs.filter("doc_id % 4 <> 1").select("entity_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"))
    return ev.index_changes(interactions(spark, sf_dir).filter("kind = 'click'"), docs.filter("doc_id % 9 <> 0"), index).select("entity_id", "op", F.substring("text_hash", 1, 8).alias("hash"))


def H7_render_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages of which every word's first letter stands in an element of its own."""
    marked = F.regexp_replace("html", "> *([A-Za-z])([a-z]+)", "><b>$1</b>$2")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(c.rendered_text(marked), 256).alias("text_sha"), F.length(c.rendered_text(marked)).alias("chars"))


def _trips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forty itineraries over all places, and who goes."""
    i = F.col("id")
    stops = table(spark, sf_dir, "places").select(
        (i % 40).alias("itinerary_id"), i.alias("place_id"), (F.floor(i / 40) % 3).alias("day"), (i * 37 % 600 + 480).alias("starts"), (i * 37 % 600 + 540).alias("ends"), F.lit(15).alias("travel"), (i % 5 * 10).alias("price"),
        F.coalesce("type", F.lit("other")).alias("category"), F.when(i % 4 != 0, i % 6 * 60 + 480).alias("opens"), F.when(i % 4 != 0, i % 5 * 60 + 900).alias("closes"), (i % 3 != 0).alias("kids"), F.when(i % 9 != 0, i % 4 != 0).alias("accessible"), (i % 5 != 0).alias("halal"), (i % 2 == 0).alias("vegetarian"),
    )
    t = F.col("id")
    parties = spark.range(40).select(t.alias("itinerary_id"), F.when(t % 3 == 0, t * 30).alias("budget"), F.lit(2).alias("repeats"), F.when(t % 2 == 0, 0).alias("trip_start"), F.when(t % 4 == 0, 1).alias("trip_end"), (t % 2 == 0).alias("need_kids"), (t % 5 == 0).alias("need_accessible"), (t % 7 == 0).alias("need_halal"), (t % 6 == 0).alias("need_vegetarian"))
    return stops, parties


def K14_itinerary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops, parties = _trips(spark, sf_dir)
    return it.checks(stops, parties).groupBy("itinerary_id", "rule").agg(F.count("*").alias("n"), F.min("place_id").alias("first"))


def K14_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate over trips of which only the needs of children count."""
    stops, parties = _trips(spark, sf_dir)
    return it.satisfaction(it.checks(stops, parties).filter("rule = 'halal'"), parties).select("itineraries", "satisfied", F.round("rate", 6).alias("rate"), "passed")


def E7_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops, parties = _trips(spark, sf_dir)
    return it.checks(stops, parties).filter("rule = 'travel'").select("itinerary_id", "place_id")


def H40_article_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue scores, density of the first person, stamp and roundup of an article in one row."""
    docs = cues.score(_docs(spark, sf_dir), "title", "text", CUES)
    return docs.select("id", F.col("cue.value").alias("type"), F.round("cue.margin", 6).alias("margin"), F.round(cues.first_person_density(F.col("text")), 6).alias("density"), cues.period_stamp(F.col("title")).alias("stamp"), F.coalesce(cues.is_roundup(F.col("title")), F.lit(False)).alias("roundup"))


def J2_review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names for people to look at."""
    names = table(spark, sf_dir, "places").groupBy("name").agg(F.min("id").alias("id"))
    return res.review_pairs(names).select("a", "b", F.round("similarity", 6).alias("similarity"))


QUERIES = {
    x.__name__: x
    for x in (B14_ladder_invariants, F13_ladder_target, F7_few_candidates, F7_many_candidates, M1_facet_diversity, I13_rail_bundle, I27_tagging_run, J7_mention_run, J14_geocode_run, P8_stated_seed, P6_saved_items, O7_click_events, O4_triage_scores, N6_slot_overrides, K8_metric_bundle, K14_itinerary_checks, K14_satisfaction, E7_consecutive, H40_article_features, J2_review_pairs, I28_model_comparison, K15_latencies, L2_index_changes, H7_render_boundaries, I3_approximate_knn)
}

_KNN = "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND {0}"
_TOP = "WITH knn AS ({0}) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM knn QUALIFY rank <= 8"
_M = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - -6.2) / 2), 2) + cos(radians(-6.2)) * cos(radians(lat)) * pow(sin(radians(lng - 106.8) / 2), 2))))"
_EX = """rel AS (SELECT type, exclude_same, list_filter(string_split(competes_csv, ','), lambda x: x <> '') AS competes FROM relations),
ex AS (SELECT type AS subject_type, CASE WHEN exclude_same THEN list_concat([type, 'unknown'], competes) ELSE [] END AS excluded FROM rel
  UNION ALL SELECT '(none)', list(DISTINCT t) FROM (SELECT type AS t FROM rel WHERE exclude_same UNION ALL SELECT unnest(competes) FROM rel WHERE exclude_same UNION ALL SELECT 'unknown'))"""
_TRIPS = """st AS (SELECT id % 40 AS itinerary_id, id AS place_id, id // 40 % 3 AS day, id * 37 % 600 + 480 AS starts, id * 37 % 600 + 540 AS ends, 15 AS travel, id % 5 * 10 AS price, coalesce(type, 'other') AS category,
  CASE WHEN id % 4 <> 0 THEN id % 6 * 60 + 480 END AS opens, CASE WHEN id % 4 <> 0 THEN id % 5 * 60 + 900 END AS closes, id % 3 <> 0 AS kids, CASE WHEN id % 9 <> 0 THEN id % 4 <> 0 END AS accessible, id % 5 <> 0 AS halal, id % 2 = 0 AS vegetarian FROM places),
pa AS (SELECT i AS itinerary_id, CASE WHEN i % 3 = 0 THEN i * 30 END AS budget, 2 AS repeats, CASE WHEN i % 2 = 0 THEN 0 END AS trip_start, CASE WHEN i % 4 = 0 THEN 1 END AS trip_end, i % 2 = 0 AS nk, i % 5 = 0 AS na, i % 7 = 0 AS nh, i % 6 = 0 AS nv FROM range(40) t(i)),
bo AS (SELECT *, lag(ends) OVER (PARTITION BY itinerary_id, day ORDER BY starts, place_id) AS before FROM st JOIN pa USING (itinerary_id)),
vi AS (SELECT itinerary_id, 'closed' AS rule, place_id FROM bo WHERE starts < opens OR ends > closes UNION ALL SELECT itinerary_id, 'travel', place_id FROM bo WHERE starts < before + travel
  UNION ALL SELECT itinerary_id, 'outside_trip', place_id FROM bo WHERE day < trip_start OR day > trip_end UNION ALL SELECT itinerary_id, 'kids', place_id FROM bo WHERE nk AND NOT coalesce(kids, false)
  UNION ALL SELECT itinerary_id, 'accessible', place_id FROM bo WHERE na AND NOT coalesce(accessible, false) UNION ALL SELECT itinerary_id, 'halal', place_id FROM bo WHERE nh AND category = 'eat' AND NOT coalesce(halal, false)
  UNION ALL SELECT itinerary_id, 'vegetarian', place_id FROM bo WHERE nv AND category = 'eat' AND NOT coalesce(vegetarian, false)
  UNION ALL SELECT itinerary_id, 'budget', NULL FROM bo GROUP BY itinerary_id, budget HAVING sum(price) > budget UNION ALL SELECT itinerary_id, 'repeats', NULL FROM bo GROUP BY itinerary_id, day, category HAVING count(*) > any_value(repeats))"""


def _rendered(x: str) -> str:
    tags = "|".join(c.RENDERED_APART)
    for pattern, to in (("(?is)<(script|style|svg)[^>]*>.*?</(script|style|svg)>", " "), ("(?s)<!--.*?-->", ""), (f"(?is)</?(?:{tags})(?:[ \t\r\n/][^>]*)?>", " "), ("(?s)<[^>]*>", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({_unescape(x)}, '[ \t\r\n]+', ' ', 'g'))"


def _bundle_sql(name: str, order: str) -> str:
    return f"""{name}r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY {order}) AS rank FROM documents), {name}d AS (SELECT query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade > 0) AS hits, min(rank) FILTER (grade > 0) AS first FROM {name}r LEFT JOIN gr USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
{name}b AS (SELECT query_id, CASE WHEN coalesce(idcg, 0) = 0 THEN 0 ELSE dcg / idcg END AS ndcg, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE hits / least(n, 10) END AS recall, (hits > 0)::INT AS hit, coalesce(1 / first, 0) AS mrr FROM {name}d LEFT JOIN ig USING (query_id) LEFT JOIN ng USING (query_id))"""


def _compared(metric: str) -> str:
    return f"SELECT '{metric}' AS metric, round(avg(x.{metric}), 6) AS mean_a, round(avg(y.{metric}), 6) AS mean_b, round(avg(y.{metric} - x.{metric}), 6) AS diff, count(*) FILTER (y.{metric} > x.{metric} + 1e-12) AS wins, count(*) FILTER (y.{metric} < x.{metric} - 1e-12) AS losses FROM xb x JOIN yb y USING (query_id)"


ORACLE = {
    "H7_render_boundaries": f"WITH m AS (SELECT page_id, regexp_replace(html, '> *([A-Za-z])([a-z]+)', '><b>\\1</b>\\2', 'g') AS h FROM pages), t AS (SELECT page_id, {_rendered('h')} AS t FROM m) SELECT page_id, sha256(t) AS text_sha, length(t)::INT AS chars FROM t",
    "I28_model_comparison": f"""WITH {_SQL_RANKED}, ig AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM gr) WHERE r <= 10 GROUP BY 1), ng AS (SELECT query_id, count(*) FILTER (grade > 0) AS n FROM gr GROUP BY 1),
{_bundle_sql("x", "n_chars DESC, doc_id")}, {_bundle_sql("y", "sha256(concat('m:', doc_id))")} {" UNION ALL ".join(map(_compared, ("ndcg", "recall", "hit", "mrr")))}""",
    "K15_latencies": "WITH l AS (SELECT event_type AS kind, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT kind, len(l) AS n, " + ", ".join(f"l[least(floor(len(l) * {s})::BIGINT, len(l) - 1) + 1] AS {k}" for k, s in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM l",
    "L2_index_changes": f"""WITH {ctes("interactions")}, m AS (SELECT DISTINCT entity_id FROM interactions WHERE kind = 'click' AND entity_id IS NOT NULL), d AS (SELECT doc_id::VARCHAR AS entity_id, doc_id, sha256(text) AS h FROM documents), x AS (SELECT m.entity_id, CASE WHEN doc_id % 9 <> 0 THEN h END AS h, CASE WHEN doc_id % 4 <> 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE h END END AS was FROM m LEFT JOIN d USING (entity_id))
SELECT entity_id, CASE WHEN h IS NULL THEN 'delete' ELSE 'upsert' END AS op, h[1:8] AS hash FROM x WHERE (h IS NULL AND was IS NOT NULL) OR (h IS NOT NULL AND h IS DISTINCT FROM was)""",
    "B14_ladder_invariants": f"""WITH {ctes("places", "relations")}, {_EX}, g AS (SELECT subject_type, id, type, {_M} AS m FROM places, ex WHERE lat IS NOT NULL AND status = 'active' AND (len(excluded) = 0 OR (type IS NOT NULL AND NOT list_contains(excluded, type)))),
h AS (SELECT *, CASE WHEN m <= 2000 THEN 0 WHEN m <= 5000 THEN 1 WHEN m <= 15000 THEN 2 ELSE 3 END AS first FROM g), n AS (SELECT subject_type, r, count(*) FILTER (first <= r) AS have FROM h, range(4) t(r) GROUP BY 1, 2), stop AS (SELECT subject_type, coalesce(min(r) FILTER (have >= 18), 3) AS rung FROM n GROUP BY 1)
SELECT subject_type, id, type, rung FROM h JOIN stop USING (subject_type) WHERE first <= rung QUALIFY row_number() OVER (PARTITION BY subject_type ORDER BY round(m, 6), id) <= 18""",
    "F13_ladder_target": f"WITH {ctes('places')}, g AS (SELECT type, price_band, count(*) AS pool FROM places GROUP BY 1, 2) SELECT type, price_band, k, pool, least(pool, greatest(3 * k, k)) AS target FROM g, range(1, 21) t(k)",
    "F7_few_candidates": _TOP.format(_KNN.format("v.label = 3")),
    "F7_many_candidates": _TOP.format(_KNN.format("v.vec_id % 3 <> 0")),
    "I13_rail_bundle": f"""WITH {ctes("articles")}, a AS (SELECT id, lang, primary_type AS t, published_day AS d FROM articles WHERE status = 'published' AND published_day IS NOT NULL), s AS (SELECT * FROM a WHERE id % 100 = 2),
l AS (SELECT s.id AS subject_id, 'language' AS rail, a.id, row_number() OVER (PARTITION BY s.id ORDER BY a.d DESC, a.id) AS rank FROM s JOIN a ON a.lang = s.lang AND a.id <> s.id QUALIFY rank <= 3),
t AS (SELECT s.id AS subject_id, 'type' AS rail, a.id, row_number() OVER (PARTITION BY s.id ORDER BY a.d DESC, a.id) AS rank FROM s JOIN a ON a.t = s.t AND a.id <> s.id QUALIFY rank <= 3)
SELECT id AS subject_id, rail, id + 1 AS id, 1 AS rank, true AS cache_hit FROM s, (VALUES ('language'), ('type')) v(rail) WHERE id % 400 = 2
UNION ALL SELECT *, false FROM (SELECT * FROM l UNION ALL SELECT * FROM t) WHERE subject_id % 400 <> 2""",
    "I27_tagging_run": f"""WITH {ctes("entity_terms")}, {_D}, l(term_id, w) AS (VALUES (201::BIGINT, 'ther'), (202, 'tion'), (203, 'erth'), (204, 'eaux')), z AS (SELECT id, 0.9 AS s, {_tok("title")} AS t FROM d UNION ALL SELECT id, 0.7, {_tok("substring(text, 1, 400)")} FROM d UNION ALL SELECT id, 0.5, {_tok("substring(text, 401, 1200)")} FROM d),
w AS (SELECT id AS entity_id, term_id, max(s)::DOUBLE AS confidence, 'lexical' AS source FROM z, l WHERE list_contains(t, w) GROUP BY 1, 2), tg AS (SELECT entity_id, term_id, embedding FROM entity_terms JOIN embeddings ON vec_id = entity_id % 500 WHERE term_id >= 200),
mv AS (SELECT term_id, list(m ORDER BY i) AS vector FROM (SELECT term_id, i, avg(x) AS m FROM (SELECT term_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM tg) GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT entity_id, term_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS confidence, 'embedding' AS source FROM tg JOIN mv USING (term_id)), b AS (SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM n WHERE confidence >= 0.45) QUALIFY row_number() OVER (PARTITION BY entity_id, term_id ORDER BY confidence DESC, source DESC) = 1)
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM entity_terms e WHERE e.entity_id = b.entity_id AND e.term_id = b.term_id AND e.source = 'ai' AND e.entity_id % 5 = 0)""",
    "J14_geocode_run": f"""WITH {ctes("places")}, p AS (SELECT id, name, replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS key, CASE WHEN id % 3 <> 0 THEN area_term END AS area FROM places),
m AS (SELECT key, arg_min(name, id) AS name, min(id) AS id, arg_min(area, id) FILTER (area IS NOT NULL) AS area FROM p GROUP BY 1), s AS (SELECT *, CASE WHEN id % 10 = 1 THEN 'override' WHEN id % 2 = 0 AND id % 8 <> 0 THEN 'existing' WHEN id % 3 <> 0 THEN 'address' ELSE 'unresolved' END AS step FROM m)
SELECT key, name, key AS slug, CASE step WHEN 'override' THEN -6.5 WHEN 'existing' THEN -6.4 WHEN 'address' THEN -6.3 END::DOUBLE AS lat, CASE step WHEN 'override' THEN 106.5 WHEN 'existing' THEN 106.9 WHEN 'address' THEN 107 END::DOUBLE AS lng, step, substring(area, 5)::BIGINT AS area_id FROM s""",
    "P8_stated_seed": f"""WITH {ctes("entity_terms")}, pk AS (SELECT u AS user_id, t AS term_id FROM range(1, 12) r(u), LATERAL (SELECT unnest([u % 10 + 200, u % 25 + 100]) AS t)), v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
a AS (SELECT user_id, i, avg(x) AS a FROM (SELECT DISTINCT user_id, term_id FROM pk) JOIN v ON vec_id = term_id GROUP BY 1, 2), b AS (SELECT user_id, i, avg(x) AS b FROM (SELECT DISTINCT user_id, entity_id FROM pk JOIN entity_terms USING (term_id)) JOIN v ON vec_id = entity_id GROUP BY 1, 2),
m AS (SELECT user_id, i, coalesce((a + b) / 2, a) AS x FROM a LEFT JOIN b USING (user_id, i)) SELECT user_id, round(max(x) FILTER (i = 1), 6) AS x0, round(sum(x), 5) AS total FROM m GROUP BY 1""",
    "P6_saved_items": f"""WITH {ctes("interactions")}, l AS (SELECT user_id, entity_id, sec, kind FROM interactions WHERE kind IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, entity_id ORDER BY sec DESC, event_id DESC) = 1)
SELECT user_id, entity_id, sec AS saved_at, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, entity_id) AS rank FROM l WHERE kind = 'purchase' QUALIFY rank <= 10""",
    "O7_click_events": f"""WITH {ctes("interactions")}, x AS (SELECT *, 'https://partner.example.com/' || entity_id || CASE WHEN event_id % 2 = 0 THEN '?a=1' ELSE '' END AS href FROM interactions WHERE kind = 'click' AND event_id % 7 <> 0)
SELECT event_id, 'outbound' AS kind, 'place' AS entity_type, entity_id, href || CASE WHEN event_id % 3 = 2 THEN '' ELSE CASE WHEN event_id % 2 = 0 THEN '&' ELSE '?' END || 'utm_source=site&utm_campaign=guide' END AS target_url, sec AS at FROM x""",
    "O4_triage_scores": f"""WITH {ctes("places")}, t AS (SELECT CASE WHEN id % 13 = 0 THEN 'keep' WHEN id % 7 = 0 AND id % 3 = 0 THEN 'archive' WHEN id % 7 = 0 OR id % 5 = 0 OR id % 11 = 0 THEN 'review' ELSE 'keep' END AS action FROM places)
SELECT action, CASE action WHEN 'archive' THEN 0 WHEN 'review' THEN 0.5 ELSE 1 END::DOUBLE AS score, count(*) AS n FROM t GROUP BY 1""",
    "N6_slot_overrides": """WITH d(slot, types, o, c) AS (VALUES ('morning', 'do,wellness', 540, 720), ('lunch', 'eat', 720, 840), ('evening', 'drink,eat', 1140, 1380))
SELECT c_custkey AS request_id, slot, CASE WHEN slot = 'evening' AND c_custkey % 5 = 0 THEN 'eat' ELSE types END AS types, CASE WHEN slot = 'lunch' THEN 690 + c_custkey % 30 ELSE o END::INT AS opens, CASE WHEN slot = 'evening' AND c_custkey % 5 = 0 THEN 1300 ELSE c END::INT AS closes FROM customer, d
UNION ALL SELECT c_custkey, 'night', 'drink', 1380, 1500 FROM customer WHERE c_custkey % 2 = 0""",
    "K8_metric_bundle": f"""WITH {_SQL_RANKED}, q AS (SELECT DISTINCT query_id FROM rk), d AS (SELECT query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade > 0) AS hits, min(rank) FILTER (grade > 0) AS first FROM rk LEFT JOIN gr USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM gr) WHERE r <= 10 GROUP BY 1), n AS (SELECT query_id, count(*) FILTER (grade > 0) AS n FROM gr GROUP BY 1),
b AS (SELECT query_id, CASE WHEN coalesce(idcg, 0) = 0 THEN 0 ELSE dcg / idcg END AS ndcg, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE hits / least(n, 10) END AS recall, (hits > 0)::INT AS hit, coalesce(1 / first, 0) AS mrr FROM q JOIN d USING (query_id) LEFT JOIN i USING (query_id) LEFT JOIN n USING (query_id))
SELECT query_id[-1:] AS grp, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr FROM b GROUP BY 1""",
    "K14_itinerary_checks": f"WITH {ctes('places')}, {_TRIPS} SELECT itinerary_id, rule, count(*) AS n, min(place_id) AS first FROM vi GROUP BY 1, 2",
    "K14_satisfaction": f"WITH {ctes('places')}, {_TRIPS}, b AS (SELECT count(DISTINCT itinerary_id) AS n FROM vi WHERE rule = 'halal') SELECT 40::BIGINT AS itineraries, 40 - n AS satisfied, round((40 - n) / 40, 6) AS rate, n = 0 AS passed FROM b",
    "E7_consecutive": f"WITH {ctes('places')}, {_TRIPS} SELECT itinerary_id, place_id FROM vi WHERE rule = 'travel'",
    "H40_article_features": f"""WITH cu AS ({_cue_sql()}), w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS w, lower(split_part(text, '.', 1)) AS t FROM documents)
SELECT id, value AS type, margin, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x IN ('i', 'we', 'my', 'our'))) * 1000 / len(w), 6) ELSE 0 END::DOUBLE AS density,
nullif(regexp_extract(t, '((?:january|february|march|april|may|june|july|august|september|october|november|december) (?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}})', 1), '') AS stamp, coalesce(regexp_matches(t, '^(top |best |[0-9]+ )|(roundup|round-up|guide to)'), false) AS roundup FROM cu JOIN w USING (id)""",
}
