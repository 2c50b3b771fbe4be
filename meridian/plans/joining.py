"""Queries of joins, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import joins as j
from ..operators import merge as m
from .fixtures import ctes, table


def C1_mention_place_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, places, articles = (table(spark, sf_dir, t) for t in ("mentions", "places", "articles"))
    found = mentions.filter("role = 'featured'").join(places.select(F.col("id").alias("place_id"), "type", "name"), "place_id").join(articles.select(F.col("id").alias("article_id"), "primary_type"), "article_id")
    return found.groupBy("type", "primary_type").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"))


def C2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.evidence(table(spark, sf_dir, "places"), table(spark, sf_dir, "mentions")).select("id", "featured", "mentions", "articles", "newest")


def C3_lead_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = j.lead_mention(table(spark, sf_dir, "mentions")).select("article_id", "place_id", "role")
    articles = table(spark, sf_dir, "articles").select(F.col("id").alias("article_id"))
    return articles.join(lead, "article_id", "left")


def C4_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that no article about stays features."""
    places, mentions = table(spark, sf_dir, "places"), table(spark, sf_dir, "mentions")
    stays = table(spark, sf_dir, "articles").filter("primary_type = 'stay'").select(F.col("id").alias("article_id"))
    featured = mentions.filter("role = 'featured'").join(stays, "article_id", "left_semi")
    return places.join(featured, places["id"] == featured["place_id"], "left_anti").select("id", "type")


def C5_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, tags = table(spark, sf_dir, "articles"), table(spark, sf_dir, "entity_terms")
    return articles.join(tags.filter("term_id = 205 AND confidence >= 0.5"), articles["id"] == tags["entity_id"], "left_semi").select("id", "lang")


def C8_spatial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "places").filter("status = 'active'")
    return j.within_distance(places, 1000.0).select("a", "b", F.round("meters", 3).alias("meters"))


def C9_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    meters = c.haversine_m(F.lit(-6.2), F.lit(106.8), F.col("lat"), F.col("lng"))
    return table(spark, sf_dir, "places").filter(F.col("lat").between(-6.24, -6.16)).filter(meters <= 4000).select("id", F.round(meters, 3).alias("meters"))


def C11_name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles against words of types: tokens meet words by an equal join, not row by row."""
    words = spark.createDataFrame([("stay", "red"), ("stay", "blue"), ("eat", "green"), ("drink", "hot"), ("shop", "misty")], "type string, word string")
    parts = table(spark, sf_dir, "places").select("id", F.explode(F.array_distinct(c.tokens(F.col("name"), (), 0))).alias("word"))
    return parts.join(words, "word").select("id", "type").distinct()


def C12_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), (-6.3 + F.col("n_nationkey") % 5 * 0.05).alias("node_lat"), (106.7 + F.floor(F.col("n_nationkey") / 5) * 0.05).alias("node_lng"))
    found = j.nearest_node(table(spark, sf_dir, "places"), nodes, 60_000)
    return found.select("id", "node_id", F.round("meters", 3).alias("meters"))


def C13_cross_source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that entities name and the vocabulary lacks."""
    terms, tags = table(spark, sf_dir, "terms").filter("id % 5 <> 0"), table(spark, sf_dir, "entity_terms")
    return tags.join(terms, tags["term_id"] == terms["id"], "left_anti").groupBy("term_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("sample"))


def C14_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each block of places has, from its size alone, and those of its pairs that stand next to each other by id."""
    places = table(spark, sf_dir, "places").select("id", F.substring("name", 7, 9).alias("block"))
    sizes = places.groupBy(F.col("block").alias("a_block")).agg(F.count("*").alias("n")).filter("n > 1").select("a_block", F.expr("n * (n - 1) div 2").alias("pairs"))
    near = j.close_pairs(places, "block", 50).groupBy(F.col("block").alias("a_block")).agg(F.count("*").alias("near"))
    return sizes.join(near, "a_block", "left").na.fill(0, ["near"])


def C15_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct sets of words of first sentences, each set under the least document that has it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), c.tokens(F.substring_index("text", ".", 1)).alias("t")).filter(F.size("t") > 2)
    return j.token_pairs(j.token_sets(docs, "id", F.col("t")), 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


def C16_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists side by side."""
    docs = table(spark, sf_dir, "documents")
    longest = docs.orderBy(F.desc("n_chars"), "doc_id").limit(60).select("doc_id", F.lit(True).alias("long"))
    scored = table(spark, sf_dir, "labels").orderBy(F.desc("quality"), "doc_id").limit(200).select("doc_id", F.lit(True).alias("good"))
    return longest.join(scored, "doc_id", "full").select("doc_id", F.coalesce("long", F.lit(False)).alias("in_long"), F.coalesce("good", F.lit(False)).alias("in_good"))


def C17_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partnership of the place, else of its organisation."""
    places = table(spark, sf_dir, "places").select("id", "org_id")
    own = places.filter("id % 7 = 0").select(F.col("id").alias("id"), F.concat(F.lit("place"), F.col("id").cast("string")).alias("deal"))
    org = spark.range(60).filter("id % 4 = 0").select(F.col("id").alias("org_id"), F.concat(F.lit("org"), F.col("id").cast("string")).alias("deal"))
    return j.fallback(places, [own, org], ["id", "org_id"], "deal").select("id", "deal")


def C18_tree_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "terms")
    up = t.select(F.col("id").alias("__p"), F.col("label").alias("parent_label"))
    return t.join(up, F.col("parent_id") == F.col("__p"), "left").select("id", "label", "parent_label")


def C18b_tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.closure(table(spark, sf_dir, "terms").select("id", "parent_id"))


def C20_collapsed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several child lists of a row, each collapsed before it joins."""
    mentions, tags = table(spark, sf_dir, "mentions"), table(spark, sf_dir, "entity_terms")
    roles = mentions.groupBy(F.col("article_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    terms = tags.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("term_id").cast("string"))), ",").alias("terms"))
    return table(spark, sf_dir, "articles").select("id").join(roles, "id", "left").join(terms, "id", "left")


def C21_format_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the fact of a format term, the surest one where there are several."""
    facts = j.best_of(table(spark, sf_dir, "entity_terms").filter("term_id IN (200, 203, 206, 209, 100, 110)"), ["entity_id"], [F.desc("confidence"), F.col("term_id")])
    return table(spark, sf_dir, "articles").join(facts.withColumnRenamed("entity_id", "id").select("id", "term_id", "confidence", F.col("source").alias("fact_source")), "id", "left").select("id", "term_id", "confidence", "fact_source")


def C22_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "terms")
    parents = terms.select(F.col("id").alias("__p"), F.col("slug").alias("parent"))
    tags = table(spark, sf_dir, "entity_terms")
    return tags.join(terms, tags["term_id"] == terms["id"]).join(parents, F.col("parent_id") == F.col("__p"), "left").select("entity_id", "facet", "slug", "parent")


def C24_tagged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "terms").filter("facet = 'vibe'").select(F.col("id").alias("term_id"))
    return table(spark, sf_dir, "entity_terms").join(terms, "term_id", "left_semi").select("entity_id").distinct()


def _edited(articles: DataFrame) -> DataFrame:
    """The articles as a later snapshot has them: some gone, some new, some changed."""
    kept = articles.filter("id % 20 <> 3").withColumn("format", F.when(F.col("id") % 9 == 0, "news").otherwise(F.col("format"))).withColumn("n_chars", F.when(F.col("id") % 14 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return kept.unionByName(articles.filter("id % 100 = 1").withColumn("id", F.col("id") + 10_000_000))


_SQL_EDITED = """old AS (SELECT id, format, n_chars FROM articles), new AS (
  SELECT id, CASE WHEN id % 9 = 0 THEN 'news' ELSE format END AS format, CASE WHEN id % 14 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM articles WHERE id % 20 <> 3
  UNION ALL SELECT id + 10000000, format, n_chars FROM articles WHERE id % 100 = 1)"""


def C25_record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "articles").select("id", "format", "n_chars")
    return j.diff(old, _edited(old), "id", ["format", "n_chars"])


def G1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "articles").select("id", "format", "n_chars")
    return m.upsert(old, _edited(old).filter("id % 2 = 0"), ["id"])


def G2_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "articles").select("id", "format", "n_chars")
    return m.snapshot_diff(old, _edited(old), ["id"]).groupBy("change").agg(F.count("*").alias("n"))


def G3_recompute_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key's rows replaced, the others as they were."""
    old = table(spark, sf_dir, "mentions").groupBy("article_id", "role").agg(F.count("*").alias("n"))
    new = table(spark, sf_dir, "mentions").filter("article_id = 7 AND role <> 'reviewed'").groupBy("article_id", "role").agg(F.count("*").alias("n"))
    return m.replace_keys(old, new, spark.range(7, 8).select(F.col("id").alias("article_id")), ["article_id"])


def G4_hash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows must be built anew because their text's hash has changed, and which are stale."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.filter("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("text_hash"))
    stored = stored.unionAll(docs.filter("doc_id % 200 = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("gone").alias("text_hash")))
    return m.hash_gate(docs, stored, "doc_id", F.sha2("text", 256)).groupBy("action").agg(F.count("*").alias("n"))


def G5_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.select(F.lit("lang").alias("facet"), F.col("lang").alias("value")).unionAll(a.select(F.lit("source").alias("facet"), F.col("source").alias("value"))).groupBy("facet", "value").agg(F.count("*").alias("n"))


def G6_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "mentions").filter("role = 'featured'").select("article_id")
    b = table(spark, sf_dir, "mentions").filter("role = 'reviewed'").select("article_id")
    sets = {"union": a.union(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b)}
    out = None
    for name, s in sets.items():
        part = s.select(F.lit(name).alias("op"), "article_id")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("op").agg(F.count("*").alias("n"), F.sum("article_id").alias("ids"))


def G7_merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges and un-merges as a log; where each place ended up."""
    places = table(spark, sf_dir, "places").select("id")
    log = places.filter("id % 10 = 3").select(F.col("id").alias("loser"), (F.col("id") - 3).alias("winner"), F.lit(1).alias("step"), F.lit("merge").alias("op"))
    log = log.unionAll(places.filter("id % 20 = 3").select(F.col("id").alias("loser"), (F.col("id") - 3).alias("winner"), F.lit(2).alias("step"), F.lit("unmerge").alias("op")))
    return m.fold_merges(places, log)


def G8_guarded_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "places").select("id", "status")
    return m.transition(places, F.col("id") % 6 == 1, "active", "archived").filter("moved").select("id", "status")


def G9_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An editor's fact stays against an inferred one for the same entity and facet."""
    tags = table(spark, sf_dir, "entity_terms").withColumn("facet", F.when(F.col("term_id") < 200, "location").otherwise("vibe"))
    new = tags.withColumn("term_id", F.col("term_id") + 1).withColumn("source", F.lit("ai"))
    return m.by_priority(tags.unionByName(new.filter("entity_id % 2 = 0")), ["entity_id", "facet"], "source", ("editor", "ai"), [F.desc("confidence"), F.desc("term_id")]).select("entity_id", "facet", "term_id", "source")


QUERIES = {
    x.__name__: x
    for x in (C1_mention_place_article, C2_evidence, C3_lead_mention, C4_anti_join, C5_semi_join, C8_spatial_pairs, C9_radius, C11_name_patterns, C12_nearest_node, C13_cross_source_drift, C14_block_pairs, C15_token_pairs, C16_full_outer, C17_fallback, C18_tree_labels, C18b_tree_closure, C20_collapsed_children, C21_format_fact, C22_term_lookup, C24_tagged_ids, C25_record_diff, G1_upsert, G2_snapshot_diff, G3_recompute_key, G4_hash_gate, G5_union_all, G6_set_algebra, G7_merge_log, G8_guarded_transition, G9_source_priority)
}


def _dist(a: str, b: str) -> str:
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2))))"


_TOK = "list_filter(regexp_extract_all(lower(translate(split_part(text, '.', 1), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'in', 'at', 'of', 'to', 'for', 'and', 'on', 'with', 'is', 'are', 'your', 'this', 'that'))"

ORACLE = {
    "C1_mention_place_article": f"""WITH {ctes("mentions", "places", "articles")} SELECT type, primary_type, count(*) AS n, count(DISTINCT article_id) AS articles FROM mentions m JOIN places p ON p.id = place_id JOIN articles a ON a.id = article_id WHERE role = 'featured' GROUP BY 1, 2""",
    "C2_evidence": f"""WITH {ctes("mentions", "places")} SELECT p.id, count(*) FILTER (role = 'featured') AS featured, count(m.id) AS mentions, count(DISTINCT article_id) AS articles, max(article_id) AS newest FROM places p LEFT JOIN mentions m ON place_id = p.id GROUP BY 1""",
    "C3_lead_mention": f"""WITH {ctes("mentions", "articles")} SELECT a.id AS article_id, place_id, role FROM articles a LEFT JOIN (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY CASE role WHEN 'featured' THEN 1 WHEN 'reviewed' THEN 2 ELSE 3 END, id, place_id) = 1) m ON m.article_id = a.id""",
    "C4_anti_join": f"WITH {ctes('mentions', 'places', 'articles')} SELECT id, type FROM places p WHERE NOT EXISTS (SELECT 1 FROM mentions m JOIN articles a ON a.id = m.article_id WHERE m.place_id = p.id AND m.role = 'featured' AND a.primary_type = 'stay')",
    "C5_semi_join": f"WITH {ctes('articles', 'entity_terms')} SELECT id, lang FROM articles WHERE id IN (SELECT entity_id FROM entity_terms WHERE term_id = 205 AND confidence >= 0.5)",
    "C8_spatial_pairs": f"""WITH {ctes("places")}, p AS (SELECT * FROM places WHERE status = 'active' AND lat IS NOT NULL), x AS (SELECT a.id AS a, b.id AS b, {_dist("a.", "b.")} AS m FROM p a JOIN p b ON a.id < b.id) SELECT a, b, round(m, 3) AS meters FROM x WHERE m <= 1000""",
    "C9_radius": f"""WITH {ctes("places")}, x AS (SELECT id, lat, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - -6.2) / 2), 2) + cos(radians(-6.2)) * cos(radians(lat)) * pow(sin(radians(lng - 106.8) / 2), 2)))) AS m FROM places) SELECT id, round(m, 3) AS meters FROM x WHERE m <= 4000""",
    "C11_name_patterns": f"""WITH {ctes("places")}, w(type, word) AS (VALUES ('stay', 'red'), ('stay', 'blue'), ('eat', 'green'), ('drink', 'hot'), ('shop', 'misty')) SELECT DISTINCT id, w.type FROM places, w WHERE list_contains(regexp_extract_all(lower(name), '[a-z0-9]+'), word)""",
    "C12_nearest_node": f"""WITH {ctes("places")}, n AS (SELECT n_nationkey::BIGINT AS node_id, -6.3e0 + n_nationkey % 5 * 0.05e0 AS lat, 106.7e0 + (n_nationkey // 5) * 0.05e0 AS lng FROM nation), x AS (SELECT p.id, node_id, {_dist("p.", "n.")} AS m FROM places p, n WHERE p.lat IS NOT NULL)
SELECT id, node_id, round(m, 3) AS meters FROM x WHERE m <= 60000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, node_id) = 1""",
    "C13_cross_source_drift": f"WITH {ctes('terms', 'entity_terms')} SELECT term_id, count(*) AS n, min(entity_id) AS sample FROM entity_terms WHERE term_id NOT IN (SELECT id FROM terms WHERE id % 5 <> 0) GROUP BY 1",
    "C14_block_pairs": f"WITH {ctes('places')}, p AS (SELECT id, substring(name, 7, 9) AS block FROM places) SELECT a.block AS a_block, count(*) AS pairs, count(*) FILTER (b.id - a.id < 50) AS near FROM p a JOIN p b ON a.block = b.block AND a.id < b.id GROUP BY 1",
    "C15_token_pairs": f"""WITH d AS (SELECT doc_id AS id, {_TOK} AS l FROM documents), s AS (SELECT min(id) AS id, s FROM (SELECT id, list_sort(list_distinct(l)) AS s FROM d WHERE len(l) > 2) GROUP BY s), e AS (SELECT id, unnest(s) AS t FROM s),
p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM e x JOIN e y ON x.t = y.t AND x.id < y.id), q AS (SELECT a, b, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) AS sim FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b)
SELECT a, b, round(sim, 6) AS similarity FROM q WHERE sim >= 0.5""",
    "C16_full_outer": """WITH a AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60), b AS (SELECT doc_id FROM labels ORDER BY quality DESC, doc_id LIMIT 200) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_long, b.doc_id IS NOT NULL AS in_good FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "C17_fallback": f"WITH {ctes('places')} SELECT id, CASE WHEN id % 7 = 0 THEN concat('place', id) WHEN org_id % 4 = 0 THEN concat('org', org_id) END AS deal FROM places",
    "C18_tree_labels": f"WITH {ctes('terms')} SELECT t.id, t.label, p.label AS parent_label FROM terms t LEFT JOIN terms p ON p.id = t.parent_id",
    "C18b_tree_closure": f"WITH RECURSIVE {ctes('terms')}, c(id, ancestor, steps) AS (SELECT id, id, 0 FROM terms UNION ALL SELECT c.id, parent_id, steps + 1 FROM c JOIN terms t ON t.id = c.ancestor WHERE parent_id IS NOT NULL) SELECT * FROM c",
    "C20_collapsed_children": f"""WITH {ctes("articles", "mentions", "entity_terms")} SELECT id, (SELECT array_to_string(list_sort(list(DISTINCT role)), ',') FROM mentions WHERE article_id = a.id) AS roles, (SELECT array_to_string(list_sort(list(DISTINCT term_id::VARCHAR)), ',') FROM entity_terms WHERE entity_id = a.id) AS terms FROM articles a""",
    "C21_format_fact": f"""WITH {ctes("articles", "entity_terms")}, f AS (SELECT * FROM entity_terms WHERE term_id IN (200, 203, 206, 209, 100, 110) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, term_id) = 1) SELECT id, term_id, confidence, f.source AS fact_source FROM articles LEFT JOIN f ON entity_id = id""",
    "C22_term_lookup": f"WITH {ctes('terms', 'entity_terms')} SELECT entity_id, t.facet, t.slug, p.slug AS parent FROM entity_terms JOIN terms t ON t.id = term_id LEFT JOIN terms p ON p.id = t.parent_id",
    "C24_tagged_ids": f"WITH {ctes('terms', 'entity_terms')} SELECT DISTINCT entity_id FROM entity_terms WHERE term_id IN (SELECT id FROM terms WHERE facet = 'vibe')",
    "C25_record_diff": f"""WITH {ctes("articles")}, {_SQL_EDITED}, j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS oid, n.id AS nid, o.format AS f, n.format AS g, o.n_chars AS c, n.n_chars AS d FROM old o FULL JOIN new n ON o.id = n.id)
SELECT id, '' AS field, CASE WHEN oid IS NOT NULL THEN 'left' END AS left_value, CASE WHEN nid IS NOT NULL THEN 'right' END AS right_value FROM j WHERE oid IS NULL OR nid IS NULL
UNION ALL SELECT id, 'format', f, g FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND f IS DISTINCT FROM g UNION ALL SELECT id, 'n_chars', c::VARCHAR, d::VARCHAR FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND c IS DISTINCT FROM d""",
    "G1_upsert": f"WITH {ctes('articles')}, {_SQL_EDITED}, u AS (SELECT * FROM new WHERE id % 2 = 0) SELECT * FROM u UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM u)",
    "G2_snapshot_diff": f"""WITH {ctes("articles")}, {_SQL_EDITED} SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.format IS NOT DISTINCT FROM n.format AND o.n_chars IS NOT DISTINCT FROM n.n_chars THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM old o FULL JOIN new n ON o.id = n.id GROUP BY 1""",
    "G3_recompute_key": f"WITH {ctes('mentions')} SELECT article_id, role, count(*) AS n FROM mentions WHERE article_id <> 7 OR role <> 'reviewed' GROUP BY 1, 2",
    "G4_hash_gate": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'build' WHEN doc_id % 8 = 1 THEN 'rebuild' ELSE 'keep' END AS action, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'prune', count(*) FROM documents WHERE doc_id % 200 = 1""",
    "G5_union_all": "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2",
    "G6_set_algebra": f"""WITH {ctes("mentions")}, a AS (SELECT DISTINCT article_id FROM mentions WHERE role = 'featured'), b AS (SELECT DISTINCT article_id FROM mentions WHERE role = 'reviewed'),
u AS (SELECT 'union' AS op, article_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', article_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', article_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
SELECT op, count(*) AS n, sum(article_id)::BIGINT AS ids FROM u GROUP BY 1""",
    "G7_merge_log": "SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 10 = 3 AND p_partkey % 20 <> 3 THEN p_partkey - 3 ELSE p_partkey END::BIGINT AS survivor FROM part",
    "G8_guarded_transition": f"WITH {ctes('places')} SELECT id, 'archived' AS status FROM places WHERE status = 'active' AND id % 6 = 1",
    "G9_source_priority": f"""WITH {ctes("entity_terms")}, t AS (SELECT *, CASE WHEN term_id < 200 THEN 'location' ELSE 'vibe' END AS facet FROM entity_terms), u AS (SELECT entity_id, facet, term_id, source, confidence FROM t UNION ALL SELECT entity_id, facet, term_id + 1, 'ai', confidence FROM t WHERE entity_id % 2 = 0)
SELECT entity_id, facet, term_id, source FROM u QUALIFY row_number() OVER (PARTITION BY entity_id, facet ORDER BY CASE WHEN source = 'editor' THEN 0 ELSE 1 END, confidence DESC, term_id DESC) = 1""",
}
