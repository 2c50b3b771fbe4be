"""Queries over article bodies, quality and rails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import content, filters, nearby
from ..operators import retrieval as r
from . import behaviour as bp
from .fixtures import AS_OF_DAY, ctes, table


def H6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = content.with_blocks(table(spark, sf_dir, "pages"))
    return pages.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.type", "b.level", F.sha2(content.block_text(F.col("b")), 256).alias("text_sha"))


def H9_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.with_blocks(table(spark, sf_dir, "pages")).withColumn("s", content.stats(F.col("blocks"))).select("page_id", "s.*")


def H8_shortcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("[gallery ids=1]<!-- wp:paragraph --><p>"), "text", F.lit("</p><!-- /wp:paragraph -->[caption id=2]x[/caption]"))
    d = table(spark, sf_dir, "documents").withColumn("raw", raw)
    return d.select("doc_id", F.sha2(content.without_shortcodes(F.col("raw")), 256).alias("clean_sha"), F.size(content.block_kinds(F.col("raw"))).alias("kinds"))


def H10_content_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the blocks lose against the visible text of the pages' bodies."""
    body = F.regexp_replace("html", "(?is)^.*<body[^>]*>", "")
    pages = content.with_blocks(table(spark, sf_dir, "pages").select("page_id", body.alias("html")))
    return pages.select("page_id", F.round(content.content_loss(c.visible_text(F.col("html")), content.text_of(F.col("blocks"))), 4).alias("loss"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "places").filter("id % 100 = 1 AND status = 'active' AND lat IS NOT NULL").select(F.col("id").alias("subject_id"), F.col("type").alias("s_type"), F.col("price_band").alias("s_band"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))


def I10_complementary_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For some subjects the places of complementary types by price and nearness, the quality a millionth on top; one an organisation, two an area."""
    places, rel = table(spark, sf_dir, "places").filter("status = 'active'"), table(spark, sf_dir, "relations")
    wanted = _subjects(spark, sf_dir).join(rel, F.col("s_type") == rel["type"]).select("subject_id", "s_band", "s_lat", "s_lng", F.explode("complements").alias("type"))
    tenth = (F.col("id") % 10) * 1e-7
    score = lambda near: F.coalesce(c.price_compat(F.col("s_band"), F.col("price_band")), F.lit(0.5)) * near + tenth
    by_score = [F.desc(score(F.coalesce(c.geo_proximity(F.col("m")), F.lit(0.1)))), F.col("id")]
    # Beyond a radius nothing scores more than the best price there at its edge, with the most of quality.
    most = F.when(c.price_rank(F.col("s_band")).isNull(), 0.5).otherwise(1.0)
    sure = lambda radius: score(c.geo_proximity(F.col("m"))) > most * F.exp(F.lit(-radius / c.GEO_SCALE_M)) + 1e-6
    near = nearby.first_around(wanted, places, r.POOL, by_score, sure, on=["type"], expected=2000)
    # Places without a point are as far as can be; none comes before one of its type and band with more quality or, of as much, the lesser id.
    nowhere = r.ranked(places.filter("lat IS NULL OR lng IS NULL"), ["type", "price_band"], [F.desc(tenth), F.col("id")], r.POOL).drop("rank").join(wanted, "type").withColumn("m", c.haversine_m(F.col("s_lat"), F.col("s_lng"), F.col("lat"), F.col("lng")))
    met = near.unionByName(nowhere).withColumn("relevance", score(F.coalesce(c.geo_proximity(F.col("m")), F.lit(0.1))))
    pool = r.ranked(met, ["subject_id"], [F.desc("relevance"), F.col("id")], r.POOL)
    rows = pool.select(F.col("subject_id").alias("query_id"), "id", "rank", "relevance", F.array(F.lit(1.0), F.col("lat"), F.col("lng")).alias("embedding"), "org_id", "area_term", F.lit(None).cast("string").alias("format"), F.lit(False).alias("paid"))
    return r.diversify(rows, 6).withColumnRenamed("query_id", "subject_id")


def I11_nearby_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For some subjects the places around, the radius widened until there are six."""
    places = table(spark, sf_dir, "places").filter("status = 'active' AND lat IS NOT NULL AND type IS NOT NULL AND type <> 'unknown'")
    order = [F.round("m", 6), F.col("id")]
    # The six nearest tell the rung: one of fewer metres holds six places if it holds these.
    meters = nearby.first_around(_subjects(spark, sf_dir), places, 6, order, lambda radius: F.col("m") < radius - 1e-5, F.expr("id <> subject_id AND type <> coalesce(s_type, '')"), most_m=60_000)
    rungs = (filters.Rung("r2", 2000), filters.Rung("r5", 5000), filters.Rung("r15", 15000), filters.Rung("all"))
    return filters.climb(meters, lambda g: F.lit(True) if g.radius_m is None else F.col("m") <= g.radius_m, 6, rungs, ["subject_id"], order).select("subject_id", "id", "rung")


def I12_similar_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that may be shown, nearest to the subject's vector, blended with quality."""
    ok = filters.articles_hard(table(spark, sf_dir, "articles"), table(spark, sf_dir, "scores"), AS_OF_DAY, ["stay", "unknown"], dedup=False)
    v = table(spark, sf_dir, "embeddings")
    vecs = ok.select("id", (F.col("id") % 500).alias("vec_id")).join(v.select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    asked = v.filter("vec_id IN (3, 4)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    near = r.nearest(vecs, asked, 40, "id", not_itself=False)
    s = table(spark, sf_dir, "scores").select(F.col("entity_id").alias("id"), "score")
    blend = c.blend({"semantic": F.greatest("similarity", F.lit(0.0)), "quality": F.col("score")})
    return r.ranked(near.drop("rank").join(s, "id", "left").withColumn("blend", F.round(blend, 6)), ["query_id"], [F.desc("blend"), F.col("id")], 6).select("query_id", "id", "blend", "rank")


def I9_covisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-visits of at least 0.02, and only where an entity has three of them."""
    pairs = bp._covisited(spark, sf_dir).filter("score >= 0.02")
    enough = pairs.groupBy("entity_a").agg(F.count("*").alias("n")).filter("n >= 3")
    return pairs.join(enough, "entity_a").select("entity_a", "entity_b", F.round("score", 6).alias("score"))


def I14_read_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundredth article others of its language and another series, newest first, two a type, six in all."""
    a = table(spark, sf_dir, "articles").filter("status = 'published' AND published_day IS NOT NULL").select("id", "lang", "series_key", "primary_type", "published_day")
    subj = a.filter("id % 100 = 2").select(F.col("id").alias("subject_id"), F.col("lang"), F.col("series_key").alias("s_key"))
    order = [F.desc("published_day"), F.col("id")]
    heads = r.heads(a.withColumn("primary_type", F.coalesce("primary_type", F.lit("(none)"))), ["lang", "primary_type"], order, 2, "series_key")
    met = heads.join(subj, "lang").filter("id <> subject_id AND (series_key IS NULL OR NOT series_key <=> s_key)")
    return r.capped(met, ["subject_id"], "primary_type", order, 2, 6).select("subject_id", "id", "rank")


def P4_for_you(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rails of twenty readers, who each like what one vector says, a type or two, and areas; articles that are published and of some quality."""
    a, v = table(spark, sf_dir, "articles"), table(spark, sf_dir, "embeddings")
    low = table(spark, sf_dir, "scores").filter("score < 0.1").select(F.col("entity_id").alias("id"))
    shown = a.filter(f"status = 'published' AND published_day <= {AS_OF_DAY}").join(low, "id", "left_anti")
    vecs = shown.select("id", "series_key", "primary_type", (F.col("id") % 500).alias("vec_id")).join(v.select("vec_id", "embedding"), "vec_id")
    readers = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    q = F.col("query_id")
    picked = F.array(F.struct(F.lit("type").alias("kind"), F.when(q % 3 == 0, "eat").when(q % 3 == 1, "stay").otherwise("do").alias("value")), F.struct(F.lit("type").alias("kind"), F.when(q % 2 == 0, "drink").otherwise("event").alias("value")), F.struct(F.lit("area").alias("kind"), (q % 10 + 100).cast("string").alias("value")), F.struct(F.lit("area").alias("kind"), (q % 7 + 110).cast("string").alias("value")))
    picks = readers.select("query_id", F.explode(picked).alias("p")).select("query_id", "p.*")
    areas = table(spark, sf_dir, "entity_terms").select(F.col("entity_id").alias("id"), F.col("term_id").cast("string").alias("term"))
    return r.for_you(vecs, readers, picks, areas)


def P5_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated preferences as a map from facet term to affinity, by reader."""
    picks = table(spark, sf_dir, "entity_terms").join(table(spark, sf_dir, "terms").select(F.col("id").alias("term_id"), "facet", "slug"), "term_id")
    maps = picks.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "facet", "slug").alias("k"), F.col("confidence").alias("v"))))).alias("m"))
    return maps.select("entity_id", F.to_json("m").alias("affinity"))


def I26_facet_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroid of each term's articles, and how close each article is to its own terms'."""
    tags = table(spark, sf_dir, "entity_terms").filter("term_id >= 200")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    tagged = tags.withColumn("vec_id", F.col("entity_id") % 500).join(v, "vec_id")
    means = r.mean_vectors(tagged, ["term_id"])
    return tagged.join(means, "term_id").select("entity_id", "term_id", F.round(c.cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))


QUERIES = {x.__name__: x for x in (H6_blocks, H9_block_stats, H8_shortcodes, H10_content_loss, I10_complementary_rail, I11_nearby_rail, I12_similar_rail, I9_covisited, I14_read_next, P4_for_you, P5_affinity, I26_facet_centroids)}

_M = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - s.lng) / 2), 2))))"
ORACLE = {
    "P4_for_you": f"""WITH {ctes("articles", "scores", "entity_terms")}, sh AS (SELECT id, series_key, primary_type, embedding FROM articles JOIN embeddings ON vec_id = id % 500 WHERE status = 'published' AND published_day <= {AS_OF_DAY} AND id NOT IN (SELECT entity_id FROM scores WHERE score < 0.1)),
nn AS (SELECT q.vec_id AS q, sh.*, round(list_cosine_similarity(q.embedding::DOUBLE[], sh.embedding::DOUBLE[]), 6) AS sim FROM embeddings q, sh WHERE q.vec_id < 20 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) <= 48),
once AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY q, coalesce('s:' || series_key, 'no:' || id) ORDER BY sim DESC, id) = 1),
sc AS (SELECT q, id, coalesce(primary_type, '') AS t, round(sim + CASE WHEN primary_type IN (CASE q % 3 WHEN 0 THEN 'eat' WHEN 1 THEN 'stay' ELSE 'do' END, CASE q % 2 WHEN 0 THEN 'drink' ELSE 'event' END) THEN 0.05 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM entity_terms e WHERE e.entity_id = once.id AND e.term_id IN (q % 10 + 100, q % 7 + 110)) THEN 0.05 ELSE 0 END, 6) AS s FROM once),
two AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY s DESC, id) <= 2) SELECT q AS query_id, id, s::DOUBLE AS s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM two QUALIFY rank <= 6""",
    "P5_affinity": f"""WITH {ctes("terms", "entity_terms")}, k AS (SELECT entity_id, facet || ':' || slug AS k, confidence AS v FROM entity_terms JOIN terms ON id = term_id) SELECT entity_id, '{{' || string_agg('"' || k || '":' || v::DOUBLE, ',' ORDER BY k) || '}}' AS affinity FROM k GROUP BY 1""",
    "I26_facet_centroids": f"""WITH {ctes("entity_terms")}, tg AS (SELECT entity_id, term_id, embedding FROM entity_terms JOIN embeddings ON vec_id = entity_id % 500 WHERE term_id >= 200),
mv AS (SELECT term_id, list(m ORDER BY i) AS vector FROM (SELECT term_id, i, avg(x) AS m FROM (SELECT term_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM tg) GROUP BY 1, 2) GROUP BY 1) SELECT entity_id, term_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS similarity FROM tg JOIN mv USING (term_id)""",
    "I9_covisited": f"""WITH {ctes("interactions")}, {bp._SQL_SESSIONS}, {bp._SQL_COVIS}, p AS (SELECT entity_a, entity_b, co_count / session_count AS score FROM covis JOIN totals ON entity_a = entity_id), q AS (SELECT * FROM p WHERE score >= 0.02)
SELECT entity_a, entity_b, round(score, 6) AS score FROM q WHERE entity_a IN (SELECT entity_a FROM q GROUP BY 1 HAVING count(*) >= 3)""",
    "I11_nearby_rail": f"""WITH {ctes("places")}, x AS (SELECT s.id AS subject_id, p.id, {_M} AS m FROM places p, places s WHERE s.id % 100 = 1 AND s.status = 'active' AND s.lat IS NOT NULL AND p.status = 'active' AND p.lat IS NOT NULL AND p.type IS NOT NULL AND p.type <> 'unknown' AND p.id <> s.id AND p.type <> coalesce(s.type, '')),
g AS (SELECT *, CASE WHEN m <= 2000 THEN 0 WHEN m <= 5000 THEN 1 WHEN m <= 15000 THEN 2 ELSE 3 END AS first FROM x WHERE m <= 60000), n AS (SELECT subject_id, r, count(*) FILTER (first <= r) AS have FROM g, range(4) t(r) GROUP BY 1, 2), stop AS (SELECT subject_id, coalesce(min(r) FILTER (have >= 6), 3) AS rung FROM n GROUP BY 1)
SELECT subject_id, id, rung FROM g JOIN stop USING (subject_id) WHERE first <= rung QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY round(m, 6), id) <= 6""",
    "I12_similar_rail": f"""WITH {ctes("articles", "scores")}, ok AS (SELECT a.id, score FROM articles a LEFT JOIN scores s ON s.entity_id = a.id WHERE status = 'published' AND published_day <= {AS_OF_DAY} AND primary_type NOT IN ('stay', 'unknown') AND coalesce(score, 1) >= 0.35),
n AS (SELECT q.vec_id AS query_id, ok.id, score, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS s FROM ok JOIN embeddings v ON v.vec_id = ok.id % 500, embeddings q WHERE q.vec_id IN (3, 4)), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 40),
b AS (SELECT query_id, id, round(CASE WHEN score IS NULL THEN greatest(s, 0) ELSE (0.35 * greatest(s, 0) + 0.20 * score) / 0.55 END, 6)::DOUBLE AS blend FROM k) SELECT query_id, id, blend, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, id) AS rank FROM b QUALIFY rank <= 6""",
    "I14_read_next": f"""WITH {ctes("articles")}, a AS (SELECT id, lang, series_key, coalesce(primary_type, '(none)') AS t, published_day AS d FROM articles WHERE status = 'published' AND published_day IS NOT NULL), x AS (SELECT s.id AS subject_id, a.* FROM a JOIN a s ON s.lang = a.lang WHERE s.id % 100 = 2 AND a.id <> s.id AND (a.series_key IS NULL OR a.series_key IS DISTINCT FROM s.series_key)),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY subject_id, t ORDER BY d DESC, id) <= 2) SELECT subject_id, id, row_number() OVER (PARTITION BY subject_id ORDER BY d DESC, id) AS rank FROM y QUALIFY rank <= 6""",
}
