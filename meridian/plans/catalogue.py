"""Queries of catalogue rules, JSON, paging and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import catalogue as k
from ..operators import cues
from ..operators import integrity as g
from ..operators import joins as j
from ..operators import resolution as res
from ..operators import retrieval as r
from .fixtures import ctes, table


def B18_facet_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "entity_terms").withColumn("facet", F.when(F.col("term_id") >= 205, "cuisine").when(F.col("term_id") >= 200, "vibe").otherwise("location"))
    met = tags.join(table(spark, sf_dir, "articles").select(F.col("id").alias("entity_id"), "primary_type"), "entity_id")
    return met.filter(k.in_scope(F.col("facet"), F.col("primary_type"))).groupBy("facet").agg(F.count("*").alias("n"))


def B17_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, "007").when(F.col("event_id") % 4 == 1, "99999999999").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).filter(g.valid_native_id(F.col("raw"))).select("event_id")


def B21_paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "places").filter(F.col("name").ilike("%blue%"))
    return k.page(found.select("id", "name"), [F.col("name"), F.col("id")], 7, 2)


def B22_queue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places")
    return p.filter(F.lower("name").contains("blue") & (F.coalesce("area_term", F.lit("")) != "area1") & (F.col("status") == "active")).select("id")


def C23_live_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with their organisation's name, live ones first."""
    p = table(spark, sf_dir, "places")
    orgs = spark.range(60).select(F.col("id").alias("org_id"), F.concat(F.lit("org "), F.col("id").cast("string")).alias("org"))
    live = g.effective(F.col("status"), F.lit(None).cast("long"), F.when(F.col("id") % 4 == 0, F.col("id") % 300), F.lit(100))
    joined = p.join(orgs, "org_id", "left").withColumn("live", live)
    return r.ranked(joined, ["type"], [F.desc("live"), F.col("org"), F.col("id")], 4).select("type", "id", "org", "live", "rank")


def D19_title_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences as titles, with a year at their end; some carry a series already."""
    d = F.col("doc_id")
    titled = table(spark, sf_dir, "documents").select(d.alias("id"), F.concat(F.substring_index("text", ".", 1), F.lit(" "), (d % 3 + 2022).cast("string")).alias("title"), F.when(d % 7 == 0, "s1").when(d % 11 == 0, "s2").alias("series_key"))
    return k.title_clusters(titled).select("first", "members", "kind", F.sha2("series_key", 256).alias("series_sha"))


def D23_distinct_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.size(F.collect_set("primary_type")).alias("types"))


def D26_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(c.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"), F.max(F.octet_length("html")).alias("largest"))


def D36_calibration_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's outcome in a facet: its fact, else the pending review's."""
    facts = table(spark, sf_dir, "entity_terms").filter("term_id < 200 AND entity_id % 3 <> 1").select("entity_id", "term_id", F.lit(0).alias("p"))
    pending = table(spark, sf_dir, "entity_terms").filter("term_id < 200").select("entity_id", (F.col("term_id") + 1).alias("term_id"), F.lit(1).alias("p"))
    best = j.best_of(facts.unionByName(pending), ["entity_id"], [F.col("p"), F.col("term_id")])
    return best.select("entity_id", "term_id", F.when(F.col("p") == 0, "fact").otherwise("review").alias("by"))


def H27_price_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("An "), F.element_at(F.array(F.lit("affordable"), F.lit("elegant"), F.lit("cheap"), F.lit("plain")), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" place"))
    return table(spark, sf_dir, "documents").select("doc_id", k.first_match(text, k.PRICE_CUES).alias("band"))


def H28_location_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("We had Ubud "), F.when(F.col("doc_id") % 3 == 0, "duck").when(F.col("doc_id") % 3 == 1, "sun").otherwise("duck in Ubud"))
    return table(spark, sf_dir, "documents").filter(k.mentions_place(text, "ubud")).select("doc_id")


def H29_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(F.col("doc_id") % 2 == 0, "Top spots ").otherwise("Spots "), F.when(F.col("doc_id") % 3 == 0, "March 2024").when(F.col("doc_id") % 3 == 1, "2023").otherwise("now"))
    return table(spark, sf_dir, "documents").select("doc_id", cues.period_stamp(title).alias("stamp"), cues.is_roundup(title).alias("roundup"))


def H31_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values of a JSON column, absent ones null, and a map merged over another."""
    e = table(spark, sf_dir, "events").withColumn("m", F.map_concat(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("b"), F.get_json_object("props", "$.k").cast("int"))))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none.k").alias("none"), (F.col("m")["a"] + F.col("m")["b"]).alias("total"))


def H34_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("id") % 5 != 0, F.col("id") % 10 / 10.0)
    return table(spark, sf_dir, "places").groupBy(k.confidence_bucket(conf).alias("bucket")).agg(F.count("*").alias("n"), F.min(k.specificity(F.when(F.col("id") % 2 == 0, "area").otherwise("?"))).alias("best"))


def H35_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hhmm = F.format_string("%02d:%02d", (F.col("event_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", c.minutes_of_day(hhmm).alias("minutes"))


def H36_normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's length lies on a normal curve of 2000 characters and 1000 either way."""
    z = (F.col("n_chars") - 2000) / 1000
    return table(spark, sf_dir, "documents").select("doc_id", F.round(c.normal_cdf(z), 6).alias("p"))


def H37_hidden_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "places").select("id", F.col("name").alias("title"))
    return k.hidden_rivals(titles, {"stay": ["red", "blue"], "eat": ["hot", "green"]})


def H38_name_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places")
    return p.filter(k.names_agree(F.concat(F.lit("The Blue "), F.when(F.col("id") % 2 == 0, "Place").otherwise("Ring")), F.col("name"), ("the", "place"))).select("id")


def H39_unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.unique_slugs(table(spark, sf_dir, "places").select("id", F.substring("name", 7, 9).alias("n")), "n", "id").select("id", "slug")


def I21_type_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    found = k.cascade(("editor", F.when(F.col("id") % 9 == 0, "stay")), ("category", F.col("primary_type")), ("cue", F.when(F.col("id") % 4 == 1, "do")))
    return a.withColumn("c", found).groupBy("c.value", "c.by").agg(F.count("*").alias("n"))


def I22_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtypes of places by their names, which get kinds at their ends, with bands: two kinds in one name are no sure sign."""
    i = F.col("id") % 5
    name = F.concat(F.col("name"), F.when(i == 0, " Beach Club").when(i == 1, " Coffee").when(i == 2, " Resort Hotel").when(i == 3, " Kitchen").otherwise(""))
    found, sure = k.subtype(name)
    return table(spark, sf_dir, "places").groupBy(found.alias("subtype"), k.confidence_band(sure).alias("band"), sure.alias("confidence")).agg(F.count("*").alias("n"))


def I17_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, silhouette = k.k_means(table(spark, sf_dir, "embeddings"), 3)
    return found.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(round(silhouette, 6)))


def I23_offline_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", k.seeded_vector(F.col("text"), 16).alias("v"))
    return v.select("doc_id", F.round(c.norm(F.col("v")), 9).alias("norm"))


def J9_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, terms = table(spark, sf_dir, "places"), table(spark, sf_dir, "terms")
    matched = places.filter("id % 3 <> 0").select("id", (100 + F.col("id") % 25).alias("area_id"))
    return k.region_verdict(places, matched, j.closure(terms.select("id", "parent_id")), 2).groupBy("verdict").agg(F.count("*").alias("n"))


def J13_duplicates_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places most like one place by core words, five of them."""
    p = table(spark, sf_dir, "places").select("id", res.core_tokens(F.col("name")).alias("t"))
    one = p.filter("id = 11").select(F.col("t").alias("u"))
    near = p.filter("id <> 11").crossJoin(F.broadcast(one)).withColumn("s", F.round(c.jaccard(F.col("t"), F.col("u"), 1.0), 6))
    return near.filter("s > 0").orderBy(F.desc("s"), "id").limit(5).select("id", "s")


def J15_partnered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are partners, or whose organisation is, at a day."""
    p = table(spark, sf_dir, "places")
    deals = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.col("id") * 3).alias("place_id"), F.when(F.col("id") % 2 == 1, F.col("id") % 60).alias("org"), F.when(F.col("id") % 5 == 0, "ended").otherwise("active").alias("status"), (F.col("id") % 50).alias("starts"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("ends"))
    live = deals.filter(g.effective(F.col("status"), F.col("starts"), F.col("ends"), F.lit(40)))
    own = p.join(live.select(F.col("place_id").alias("__p")).filter("__p IS NOT NULL").distinct(), F.col("id") == F.col("__p"), "left_semi")
    org = p.join(live.select(F.col("org").alias("__o")).filter("__o IS NOT NULL").distinct(), F.col("org_id") == F.col("__o"), "left_semi")
    return own.select("id").union(org.select("id")).distinct()


def K12_labelled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred labelled rows by a stable hash."""
    t = table(spark, sf_dir, "labels").withColumn("h", c.stable_rank("eval", F.col("doc_id")))
    return t.orderBy("h").limit(200).select("doc_id", "quality")


def K13_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random order and one by popularity against the labels, by precision at ten."""
    from ..operators import evaluation as e

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    rel = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")).join(d.select("query_id", "id"), "id").select("query_id", "id")
    out = None
    for name, order in (("random", [c.stable_rank("r", F.col("id"))]), ("popular", [F.desc("n_chars"), F.col("id")])):
        part = e.precision(r.ranked(d, ["query_id"], order), rel, 10).agg(F.round(F.avg("precision"), 6).alias("precision")).select(F.lit(name).alias("system"), "precision")
        out = part if out is None else out.unionByName(part)
    return out


def O3_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents")
    rows = [(g.schema_hash(a)[:8] == g.schema_hash(a.select(*reversed(a.columns)))[:8], len(g.schema_diff(a, a.drop("lang"))))]
    return spark.createDataFrame(rows, "same boolean, changes int")


def O8_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    facts = a.filter("id % 8 <> 1").select("id", F.when(F.col("id") % 12 == 0, "other").otherwise(F.col("format")).alias("fact"))
    return g.reconcile(g.drift(a, facts, "id", "format"), "id", "format").groupBy("action").agg(F.count("*").alias("n"))


def P3_session_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taste and session mixed: 0.6 of the session from three events on, else 0.2."""
    v = table(spark, sf_dir, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("session"))
    beta = F.when(F.col("vec_id") % 5 >= 3, 0.6).otherwise(0.2)
    mixed = v.join(other, "vec_id").select("vec_id", c.mix(F.col("session"), F.col("embedding").cast("array<double>"), beta).alias("m"))
    return mixed.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


QUERIES = {x.__name__: x for x in (B17_event_ids, B18_facet_scope, B21_paged_search, B22_queue_filter, C23_live_first, D19_title_clusters, D23_distinct_arrays, D26_footprint, D36_calibration_frame, H27_price_cues, H28_location_mentions, H29_stamps, H31_json, H34_granularity, H35_minutes, H36_normal_cdf, H37_hidden_rivals, H38_name_agrees, H39_unique_slugs, I17_k_means, I21_type_cascade, I22_subtype, I23_offline_vectors, J9_region, J13_duplicates_of_one, J15_partnered, K12_labelled_sample, K13_baselines, O3_schema, O8_reconcile, P3_session_blend)}

_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))"

def _norm_title(x: str) -> str:
    x = f"lower({_unescape(x)})"
    for pattern, to in (("(^|[^a-z0-9])updated([^a-z0-9]|$)", "\\1 \\2"), ("(^|[^0-9a-z])(19|20)[0-9][0-9]($|[^0-9a-z])", "\\1 \\3"), ("(^|[^0-9a-z])[0-9]+(st|nd|rd|th)($|[^0-9a-z])", "\\1 \\3"), ("[^a-z0-9]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


def _unescape(x: str) -> str:
    for e, s in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{e}', '{s}')"
    return x


ORACLE = {
    "B17_event_ids": "SELECT event_id FROM events WHERE event_id % 4 >= 2",
    "B18_facet_scope": f"""WITH {ctes("entity_terms", "articles")}, t AS (SELECT CASE WHEN term_id >= 205 THEN 'cuisine' WHEN term_id >= 200 THEN 'vibe' ELSE 'location' END AS facet, primary_type AS p FROM entity_terms JOIN articles ON id = entity_id)
SELECT facet, count(*) AS n FROM t WHERE facet = 'location' OR (facet = 'cuisine' AND p IN ('eat', 'drink')) OR (facet = 'vibe' AND p IN ('stay', 'eat', 'drink', 'wellness', 'do')) GROUP BY 1""",
    "K13_baselines": """WITH d AS (SELECT source AS q, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('r:', doc_id))) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS b FROM documents), t AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1),
p AS (SELECT q, count(*) FILTER (a <= 10 AND t.id IS NOT NULL) / 10 AS a, count(*) FILTER (b <= 10 AND t.id IS NOT NULL) / 10 AS b FROM d LEFT JOIN t USING (id) GROUP BY 1) SELECT 'random' AS system, round(avg(a), 6) AS precision FROM p UNION ALL SELECT 'popular', round(avg(b), 6) FROM p""",
    "H3_normalize_title": f"""WITH t AS (SELECT doc_id AS id, split_part(text, '.', 1) || ' 2' || (doc_id % 30 + 10) || '9 &amp; 3rd ' || CASE WHEN doc_id % 2 = 0 THEN '[Updated]' ELSE '2024' END AS title FROM documents)
SELECT id, {_norm_title("title")} AS title, array_to_string(list_filter(regexp_extract_all(title, '[0-9A-Za-z]+'), lambda w: regexp_full_match(w, '(19|20)[0-9][0-9]')), ',') AS years FROM t""",
    "I22_subtype": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'beach-club' WHEN 1 THEN 'cafe' WHEN 2 THEN 'resort' WHEN 3 THEN 'restaurant' END AS subtype, CASE WHEN p_partkey % 5 IN (2, 4) THEN 'low' ELSE 'medium' END AS band, CASE WHEN p_partkey % 5 IN (2, 4) THEN 0.35 ELSE 0.7 END::DOUBLE AS confidence, count(*) AS n FROM part GROUP BY 1, 2, 3",
    "D19_title_clusters": f"""WITH t AS (SELECT doc_id, split_part(text, '.', 1) || ' ' || (doc_id % 3 + 2022) AS title, CASE WHEN doc_id % 7 = 0 THEN 's1' WHEN doc_id % 11 = 0 THEN 's2' END AS s FROM documents),
k AS (SELECT doc_id, s, {_norm_title("title")} AS key, array_to_string(list_filter(regexp_extract_all(title, '[0-9A-Za-z]+'), lambda w: regexp_full_match(w, '(19|20)[0-9][0-9]')), ',') || regexp_matches(lower(title), '(^|[^a-z0-9])updated([^a-z0-9]|$)') AS sig FROM t),
g AS (SELECT key, min(doc_id) AS first, count(*) AS members, count(DISTINCT sig) AS sigs, count(DISTINCT s) AS known, min(s) AS s FROM k WHERE key <> '' GROUP BY 1 HAVING count(*) >= 2)
SELECT first, members, CASE WHEN known > 1 THEN 'conflict' WHEN sigs > 1 THEN 'confident' ELSE 'uncertain' END AS kind, sha256(CASE known WHEN 1 THEN s WHEN 0 THEN replace(key, ' ', '-') END) AS series_sha FROM g""",
    "B21_paged_search": f"WITH {ctes('places')} SELECT id, name, count(*) OVER () AS total FROM places WHERE name ILIKE '%blue%' ORDER BY name, id LIMIT 7 OFFSET 7",
    "B22_queue_filter": f"WITH {ctes('places')} SELECT id FROM places WHERE contains(lower(name), 'blue') AND coalesce(area_term, '') <> 'area1' AND status = 'active'",
    "C23_live_first": f"""WITH {ctes("places")}, j AS (SELECT *, CASE WHEN org_id IS NOT NULL THEN concat('org ', org_id) END AS org, status = 'active' AND (id % 4 <> 0 OR id % 300 > 100) AS live FROM places) SELECT type, id, org, live, row_number() OVER (PARTITION BY type ORDER BY live DESC, org NULLS FIRST, id) AS rank FROM j QUALIFY rank <= 4""",
    "D23_distinct_arrays": f"WITH {ctes('articles')} SELECT source, array_to_string(list_sort(list(DISTINCT format) FILTER (format IS NOT NULL)), ',') AS formats, count(DISTINCT primary_type)::INT AS types FROM articles GROUP BY 1",
    "D26_footprint": "SELECT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '') AS host, count(*) AS n, sum(octet_length(encode(html)))::BIGINT AS bytes, max(octet_length(encode(html)))::INT AS largest FROM pages GROUP BY 1",
    "D36_calibration_frame": f"""WITH {ctes("entity_terms")}, u AS (SELECT entity_id, term_id, 0 AS p FROM entity_terms WHERE term_id < 200 AND entity_id % 3 <> 1 UNION ALL SELECT entity_id, term_id + 1, 1 FROM entity_terms WHERE term_id < 200) SELECT entity_id, term_id, CASE WHEN p = 0 THEN 'fact' ELSE 'review' END AS by FROM u QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY p, term_id) = 1""",
    "H27_price_cues": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'moderate' WHEN 1 THEN 'upscale' WHEN 2 THEN 'budget' END AS band FROM documents",
    "H28_location_mentions": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
    "H29_stamps": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'march 2024' WHEN 1 THEN '2023' END AS stamp, doc_id % 2 = 0 AS roundup FROM documents",
    "H31_json": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL AS none, 1 + json_extract_string(props, '$.k')::INT AS total FROM events",
    "H34_granularity": "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 10 >= 9 THEN 'high' WHEN p_partkey % 10 >= 6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, min(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 6 END)::BIGINT AS best FROM part GROUP BY 1",
    "H35_minutes": "SELECT event_id, (event_id % 24 * 60 + event_id % 60)::INT AS minutes FROM events",
    "H36_normal_cdf": f"WITH z AS (SELECT doc_id, (n_chars - 2000) / 1000 AS z FROM documents), y AS (SELECT doc_id, z, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z) SELECT doc_id, round(0.5 * (1 + sign(z) * {_ERF}), 6) AS p FROM y",
    "H37_hidden_rivals": f"""WITH {ctes("places")}, w AS (SELECT id, regexp_extract_all(lower(name), '[a-z0-9]+') AS w FROM places) SELECT id, 'stay' AS matched_type FROM w WHERE list_has_any(w, ['red', 'blue']) UNION ALL SELECT id, 'eat' FROM w WHERE list_has_any(w, ['hot', 'green'])""",
    "H38_name_agrees": f"WITH {ctes('places')}, w AS (SELECT id, regexp_extract_all(lower(name), '[a-z0-9]+') AS w FROM places) SELECT id FROM w WHERE list_contains(w, 'blue') AND (id % 2 = 0 OR list_contains(w, 'ring'))",
    "H39_unique_slugs": f"""WITH {ctes("places")}, s AS (SELECT id, replace(trim(regexp_replace(lower(substring(name, 7, 9)), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS s FROM places), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM s) SELECT id, CASE WHEN n = 1 THEN s ELSE concat(s, '-', n) END AS slug FROM n""",
    "I21_type_cascade": f"""WITH {ctes("articles")}, c AS (SELECT CASE WHEN id % 9 = 0 THEN 'editor' WHEN primary_type IS NOT NULL THEN 'category' WHEN id % 4 = 1 THEN 'cue' ELSE 'none' END AS "by", CASE WHEN id % 9 = 0 THEN 'stay' WHEN primary_type IS NOT NULL THEN primary_type WHEN id % 4 = 1 THEN 'do' END AS value FROM articles) SELECT value, "by", count(*) AS n FROM c GROUP BY 1, 2""",
    "I23_offline_vectors": "SELECT doc_id, 1::DOUBLE AS norm FROM documents",
    "J9_region": f"""WITH {ctes("places", "terms")}, m AS (SELECT p.id, parent_id FROM places p LEFT JOIN terms t ON t.id = 100 + p.id % 25 AND p.id % 3 <> 0) SELECT CASE WHEN parent_id IS NULL THEN 'unknown' WHEN parent_id = 2 THEN 'inside' ELSE 'outside' END AS verdict, count(*) AS n FROM m GROUP BY 1""",
    "J15_partnered": f"""WITH {ctes("places")}, d AS (SELECT range AS i FROM range(200) WHERE range % 5 <> 0 AND range % 50 <= 40 AND (range % 3 <> 0 OR range > 40)) SELECT id FROM places WHERE id IN (SELECT i * 3 FROM d WHERE i % 2 = 0) OR org_id IN (SELECT i % 60 FROM d WHERE i % 2 = 1)""",
    "K12_labelled_sample": "SELECT doc_id, quality FROM labels ORDER BY sha256(concat('eval:', doc_id)) LIMIT 200",
    "O3_schema": "SELECT true AS same, 1::INT AS changes",
    "O8_reconcile": f"""WITH {ctes("articles")}, f AS (SELECT id, CASE WHEN id % 12 = 0 THEN 'other' ELSE format END AS fact FROM articles WHERE id % 8 <> 1), j AS (SELECT a.id, format, fact FROM articles a LEFT JOIN f USING (id)) SELECT CASE WHEN fact IS NULL AND format IS NOT NULL THEN 'insert' ELSE 'update' END AS action, count(*) AS n FROM j WHERE format IS DISTINCT FROM fact GROUP BY 1""",
    "P3_session_blend": "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.vec_id % 5 >= 3 THEN 0.6 ELSE 0.2 END::DOUBLE * b.embedding[i]::DOUBLE + CASE WHEN a.vec_id % 5 >= 3 THEN 0.4 ELSE 0.8 END::DOUBLE * a.embedding[i]::DOUBLE)), 6) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
