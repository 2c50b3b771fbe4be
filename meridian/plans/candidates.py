"""Queries of filters, ladders and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import filters as f
from ..operators import retrieval as r
from .fixtures import AS_OF_DAY, ctes, table

_EXCLUDED_STAY = ["stay", "unknown"]
CENTER = (-6.2, 106.8)


def B4_excluded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each article's type, or its having none, excludes."""
    found = f.excluded_types(table(spark, sf_dir, "relations"))
    own = table(spark, sf_dir, "articles").join(found, F.col("primary_type").eqNullSafe(F.col("subject_type")), "left")
    return own.select("id", F.coalesce(F.array_join("excluded", ","), F.lit("")).alias("excluded"))


_SQL_EXCLUDED = """rel AS (SELECT type, exclude_same, list_filter(string_split(competes_csv, ','), lambda x: x <> '') AS competes FROM relations),
ex AS (SELECT type AS subject_type, CASE WHEN exclude_same THEN list_sort(list_distinct(list_concat([type, 'unknown'], competes))) ELSE [] END AS excluded FROM rel
  UNION ALL SELECT NULL, list_sort(list(DISTINCT t)) FROM (SELECT type AS t FROM rel WHERE exclude_same UNION ALL SELECT unnest(competes) FROM rel WHERE exclude_same UNION ALL SELECT 'unknown'))"""


def B5_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject type against every article."""
    articles = table(spark, sf_dir, "articles")
    subjects = f.excluded_types(table(spark, sf_dir, "relations"))
    met = articles.crossJoin(F.broadcast(subjects))
    flagged = met.filter(f.is_competitor(F.col("excluded"), F.col("primary_type")))
    return flagged.groupBy(F.coalesce("subject_type", F.lit("(none)")).alias("subject_type"), F.coalesce("primary_type", F.lit("(none)")).alias("candidate_type")).agg(F.count("*").alias("n"))


def B1_places_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = f.places_hard(table(spark, sf_dir, "places"), table(spark, sf_dir, "scores"), _EXCLUDED_STAY, 17, ["area1", "area2", "area3", "area7"], f.Around(*CENTER, 8000))
    return found.select("id", "type", "area_term", "price_band")


def B2_articles_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles")
    rivals = articles.filter("id % 23 = 0").select(F.col("id").alias("article_id"), F.when(F.col("id") % 2 == 0, "stay").otherwise("eat").alias("matched_type"))
    return f.articles_hard(articles, table(spark, sf_dir, "scores"), AS_OF_DAY, _EXCLUDED_STAY, 5, rivals).select("id", "primary_type", "series_key", "published_day")


_SQL_B2 = f"""SELECT a.*, s.score FROM articles a LEFT JOIN scores s ON s.entity_id = a.id
WHERE status = 'published' AND published_day <= {AS_OF_DAY}"""


def E2_series_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.series_dedup(table(spark, sf_dir, "articles"), table(spark, sf_dir, "scores")).select("id", "series_key")


def B3_events_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    days = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01', cast(o_orderdate as timestamp_ntz))")
    events = orders.select(
        F.col("o_orderkey").cast("long").alias("event_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("long")).alias("place_id"),
        days.alias("starts_at"),
        F.when(F.col("o_orderkey") % 3 == 0, days + 30).alias("ends_at"),
        F.when(F.col("o_orderkey") % 5 == 0, "draft").otherwise("published").alias("status"),
    )
    return f.events_hard(events, table(spark, sf_dir, "places"), 1500).select("event_id", "place_id")


def B6_session_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "places")
    shown = places.filter("id % 3 = 0").select("id").unionAll(places.filter("id % 10 = 1").select("id")).distinct()
    return f.without(places, shown).select("id", "type")


def _hours(places: DataFrame) -> DataFrame:
    """Opening hours by id: some unknown, some past midnight."""
    day = lambda d: F.struct(F.lit(d).alias("day"), ((F.col("id") + d) % 12 * 60 + 480).cast("int").alias("opens"), ((F.col("id") * 5 + d * 90) % 1440).cast("int").alias("closes"))
    return places.withColumn("hours", F.when(F.col("id") % 6 != 0, F.array(*[day(d) for d in range(7)])))


def B7_open_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(table(spark, sf_dir, "places")).filter(f.open_at(F.col("hours"), 4, 70)).select("id")


def B8_trip_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("id") % 4 != 0, F.col("published_day"))
    return table(spark, sf_dir, "articles").filter(f.in_trip(ends, F.lit(100), F.lit(300))).select("id")


def B9_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = ("wheelchair-accessible", "halal-certified", "vegan-options", "kids-club")
    amenities = F.filter(F.array(*[F.when(F.col("id") % (k + 2) == 0, t) for k, t in enumerate(tags)]), lambda x: x.isNotNull())
    places = table(spark, sf_dir, "places").withColumn("amenities", amenities)
    return places.filter(f.suits_party(F.col("amenities"), F.col("price_band"), ("accessibility", "halal"), "upscale")).select("id", "price_band")


def B10_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _hours(table(spark, sf_dir, "places"))
    kept = f.without(places, places.filter("id % 5 = 0").select("id")).filter(f.open_at(F.col("hours"), 2, 1200) & f.suits_party(F.array().cast("array<string>"), F.col("price_band"), (), "moderate"))
    age = F.when(F.col("id") % 3 == 0, F.col("id") % 20)
    return kept.select("id", F.round(f.read_weight(age), 6).alias("weight"))


def B11_personal_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "places")
    down = places.filter("id % 19 = 4").select("id")
    facets = F.array("type", "area_term")
    return f.without(places, down).filter(f.not_muted(facets, F.array(F.lit("eat"), F.lit("area3")))).select("id")


def B12_soft_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "places")
    affinities = F.array(F.when(F.col("id") % 2 == 0, F.col("id") % 10 / 10.0), F.when(F.col("id") % 3 == 0, F.col("id") % 7 / 7.0))
    w = f.soft_weight(F.lit(1.0), affinities, F.col("id") % 4 == 0, F.when(F.col("area_term").isNotNull(), F.col("id") % 6))
    return places.select("id", F.round(w, 6).alias("weight"))


def B13_read_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("id", F.round(f.read_weight(F.when(F.col("id") % 3 == 0, F.col("id") % 30 - 5)), 6).alias("weight"))


def B15_facet_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "terms").filter("id IN (100, 101, 102, 201, 202)").select("facet", F.col("id").alias("term_id"))
    return f.facet_candidates(table(spark, sf_dir, "articles"), chosen, table(spark, sf_dir, "entity_terms").select("entity_id", "term_id")).select("id")


def B16_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(40).select(F.concat(F.when(F.col("id") % 2 == 0, "location:nation-").otherwise("vibe:vibe-"), F.col("id").cast("string")).alias("selector"))
    return f.resolve_selectors(asked, table(spark, sf_dir, "terms"))


def B20_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "places")
    checks = {
        "status": (F.col("status") == "active", F.lit("not active")),
        "type": (~F.col("type").isin(*_EXCLUDED_STAY), F.concat(F.lit("type "), F.coalesce("type", F.lit("unknown")))),
        "area": (F.col("area_term").isNotNull(), F.lit("no area")),
    }
    t = places.withColumn("t", f.trace(checks))
    failed = F.array_join(F.transform(F.filter("t", lambda e: ~e["passed"]), lambda e: F.concat(e["filter"], F.lit("="), e["reason"])), ";")
    return t.select("id", f.survived(F.col("t")).alias("survived"), failed.alias("failed"))


def F2_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs by radius around the centre, for each type of place."""
    places = table(spark, sf_dir, "places").filter("status = 'active' AND lat IS NOT NULL AND type IS NOT NULL")
    meters = c.haversine_m(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("lat"), F.col("lng"))
    rungs = (f.Rung("r2", 2000), f.Rung("r5", 5000), f.Rung("r15", 15000), f.Rung("all"))
    found = f.climb(places.withColumn("m", meters), lambda g: F.lit(True) if g.radius_m is None else F.col("m") <= g.radius_m, 6, rungs, ["type"], [F.col("m"), F.col("id")])
    return found.select("type", "id", "rung")


def F1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").orderBy(F.desc("n_chars"), "id").limit(25).select("id", "n_chars")


def F4_section_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles").withColumn("one", F.lit(1)).withColumn("primary_type", F.coalesce("primary_type", F.lit("(none)")))
    return r.capped(articles, ["one"], "primary_type", [F.desc("n_chars"), F.col("id")], 2, 9).select("id", "primary_type", "rank")


def F5_bucketed_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles").filter("primary_type IS NOT NULL")
    return r.ranked(articles, ["primary_type"], [F.desc("published_day"), F.col("id")], 3).select("primary_type", "id", "rank")


def F6_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that complement each article, in the order of its type, three at most."""
    sections = table(spark, sf_dir, "relations").select("type", F.posexplode("complements").alias("pos", "section"))
    first = r.ranked(sections, ["type"], [F.col("pos")], 3).select(F.col("type").alias("primary_type"), "section", "rank")
    return table(spark, sf_dir, "articles").join(first, "primary_type").select("id", "section", "rank")


def E3_order_keeping_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each series by the current rank."""
    base = r.ranked(table(spark, sf_dir, "articles").withColumn("one", F.lit(1)), ["one"], [F.desc("n_chars"), F.col("id")], 200)
    key = F.coalesce("series_key", F.concat(F.lit("no:"), F.col("id").cast("string")))
    firsts = r.ranked(base.withColumnRenamed("rank", "was").withColumn("k", key), ["k"], [F.col("was")], 1).drop("rank")
    return r.ranked(firsts, ["one"], [F.col("was")]).select("id", "was", "rank")


def E6_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = r.ranked(table(spark, sf_dir, "articles"), ["lang"], [F.desc("n_chars"), F.col("id")], 30).filter("id % 3 <> 0").withColumnRenamed("rank", "was")
    return r.ranked(base, ["lang"], [F.col("was")]).select("lang", "id", "rank")


def F8_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each cell round robin over its values, by a stable hash: 12 rows a cell."""
    a = table(spark, sf_dir, "articles").withColumn("v", F.coalesce("primary_type", F.lit("(none)")))
    each = r.ranked(a.withColumn("h", c.stable_rank("s7", F.col("id"))), ["lang", "v"], [F.col("h")]).withColumnRenamed("rank", "turn")
    return r.ranked(each, ["lang"], [F.col("turn"), c.stable_rank("s7", F.col("v")), F.col("h")], 12).select("lang", "id", "rank")


def E10_stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.ranked(table(spark, sf_dir, "articles").withColumn("h", c.stable_rank("seed", F.col("id"))), ["source"], [F.col("h")], 3).select("source", "id", "rank")


def F9_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "entity_terms").withColumn("one", F.lit(1))
    order = [F.when(F.col("source") == "ai", 0).otherwise(1), F.col("confidence").asc_nulls_first(), F.col("entity_id"), F.col("term_id")]
    return r.ranked(tags, ["term_id"], order, 5).select("term_id", "entity_id", "rank")


def F10_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of all the first 100 by count hold: by a limit, with no window over all rows."""
    counts = table(spark, sf_dir, "mentions").groupBy("place_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "place_id").limit(100).agg(F.sum("n").alias("top"))
    return top.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("share", F.round(F.col("top") / F.col("total"), 6))


def F11_pins_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pinned articles, then the newest others up to ten, in each language."""
    a = table(spark, sf_dir, "articles").withColumn("band", F.when((F.col("id") % 50 == 7), 0).otherwise(1))
    pins = r.ranked(a.filter("band = 0"), ["lang"], [F.col("id")], 4).drop("rank")
    rest = a.join(pins.select(F.col("id").alias("__p")), F.col("id") == F.col("__p"), "left_anti")
    fill = r.ranked(rest.withColumn("band", F.lit(1)), ["lang"], [F.desc_nulls_last("published_day"), F.col("id")], 10).drop("rank")
    return r.ranked(pins.unionByName(fill), ["lang"], [F.col("band"), F.when(F.col("band") == 1, -F.coalesce("published_day", F.lit(-1))), F.col("id")], 10).select("lang", "id", "band", "rank")


def F12_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows spread evenly over each source's order."""
    k = 5
    rows = r.ranked(table(spark, sf_dir, "articles"), ["source"], [F.col("id")])
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    step = F.when(F.col("n") <= k, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("n") / k) == F.col("rank") - 1))
    return rows.join(n, "source").filter(step).select("source", "id")


def C10_one_row_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article against one row of corpus figures."""
    a = table(spark, sf_dir, "articles")
    one = a.agg(F.max("published_day").alias("newest"), F.min("n_chars").alias("shortest"))
    return a.crossJoin(F.broadcast(one)).select("id", (F.col("newest") - F.col("published_day")).alias("behind"), (F.col("n_chars") - F.col("shortest")).alias("over"))


QUERIES = {
    x.__name__: x
    for x in (B1_places_hard, B2_articles_hard, B3_events_hard, B4_excluded_types, B5_competitors, B6_session_exclusion, B7_open_at, B8_trip_window, B9_party, B10_contextual, B11_personal_hard, B12_soft_weight, B13_read_weight, B15_facet_selection, B16_selectors, B20_trace, E2_series_dedup, E3_order_keeping_dedup, E6_renumber, E10_stable_hash, F1_top_k, F2_ladder, F4_section_capped, F5_bucketed_fill, F6_complements, F8_stratified_sample, F9_queue_order, F10_top_share, F11_pins_then_fill, F12_spread, C10_one_row_cross)
}

_DIST = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - -6.2) / 2), 2) + cos(radians(-6.2)) * cos(radians(lat)) * pow(sin(radians(lng - 106.8) / 2), 2))))"
_HOURS = "h AS (SELECT id, d, (id + d) % 12 * 60 + 480 AS o, (id * 5 + d * 90) % 1440 AS c FROM places, range(7) t(d) WHERE id % 6 <> 0)"


def _open(day: int, minute: int) -> str:
    return f"(id % 6 = 0 OR id IN (SELECT id FROM h WHERE (d = {day} AND o <= {minute} AND (c <= o OR c > {minute})) OR (d = {(day - 1) % 7} AND c <= o AND c > {minute})))"


ORACLE = {
    "B4_excluded_types": f"WITH {ctes('relations', 'articles')}, {_SQL_EXCLUDED} SELECT id, coalesce(array_to_string(excluded, ','), '') AS excluded FROM articles LEFT JOIN ex ON subject_type IS NOT DISTINCT FROM primary_type",
    "B5_competitors": f"""WITH {ctes("relations", "articles")}, {_SQL_EXCLUDED} SELECT coalesce(subject_type, '(none)') AS subject_type, coalesce(primary_type, '(none)') AS candidate_type, count(*) AS n
FROM articles CROSS JOIN ex WHERE len(excluded) > 0 AND (primary_type IS NULL OR list_contains(excluded, primary_type)) GROUP BY 1, 2""",
    "B1_places_hard": f"""WITH {ctes("places", "scores")} SELECT id, type, area_term, price_band FROM places WHERE status = 'active' AND id <> 17 AND type NOT IN ('stay', 'unknown') AND area_term IN ('area1', 'area2', 'area3', 'area7')
AND {_DIST} <= 8000 AND id NOT IN (SELECT entity_id FROM scores WHERE score < 0.35)""",
    "B2_articles_hard": f"""WITH {ctes("articles", "scores")}, x AS ({_SQL_B2} AND id <> 5 AND primary_type NOT IN ('stay', 'unknown') AND NOT (id % 23 = 0 AND id % 2 = 0) AND coalesce(score, 1) >= 0.35)
SELECT id, primary_type, series_key, published_day FROM x QUALIFY row_number() OVER (PARTITION BY coalesce(series_key, concat('noseries:', id)) ORDER BY score DESC NULLS LAST, id) = 1""",
    "E2_series_dedup": f"""WITH {ctes("articles", "scores")} SELECT id, series_key FROM articles LEFT JOIN scores ON entity_id = id QUALIFY row_number() OVER (PARTITION BY coalesce(series_key, concat('noseries:', id)) ORDER BY score DESC NULLS LAST, id) = 1""",
    "B3_events_hard": f"""WITH {ctes("places")}, e AS (SELECT o_orderkey::BIGINT AS event_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::BIGINT END AS place_id, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS s, o_orderkey AS k FROM orders)
SELECT event_id, place_id FROM e LEFT JOIN (SELECT id FROM places WHERE status = 'active') ON id = place_id WHERE k % 5 <> 0 AND CASE WHEN k % 3 = 0 THEN s + 30 ELSE s END >= 1500 AND (place_id IS NULL OR id IS NOT NULL)""",
    "B6_session_exclusion": f"WITH {ctes('places')} SELECT id, type FROM places WHERE id % 3 <> 0 AND id % 10 <> 1",
    "B7_open_at": f"WITH {ctes('places')}, {_HOURS} SELECT id FROM places WHERE {_open(4, 70)}",
    "B8_trip_window": f"WITH {ctes('articles')} SELECT id FROM articles WHERE id % 4 = 0 OR published_day IS NULL OR published_day BETWEEN 100 AND 300",
    "B9_party": f"WITH {ctes('places')} SELECT id, price_band FROM places WHERE id % 2 = 0 AND id % 3 = 0 AND coalesce(price_band, '') <> 'luxury'",
    "B10_contextual": f"""WITH {ctes("places")}, {_HOURS} SELECT id, round(CASE WHEN id % 3 = 0 THEN least(1.0, greatest(0.0, (id % 20) / 14)) ELSE 1.0 END, 6)::DOUBLE AS weight FROM places
WHERE id % 5 <> 0 AND {_open(2, 1200)} AND (price_band IS NULL OR price_band IN ('budget', 'moderate'))""",
    "B11_personal_hard": f"WITH {ctes('places')} SELECT id FROM places WHERE id % 19 <> 4 AND coalesce(type, '') <> 'eat' AND coalesce(area_term, '') <> 'area3'",
    "B12_soft_weight": f"""WITH {ctes("places")}, a AS (SELECT *, CASE WHEN id % 2 = 0 THEN (id % 10) / 10 END AS x, CASE WHEN id % 3 = 0 THEN (id % 7) / 7 END AS y FROM places),
m AS (SELECT *, CASE WHEN x IS NULL AND y IS NULL THEN NULL ELSE (coalesce(x, 0) + coalesce(y, 0)) / ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT) END AS mean FROM a)
SELECT id, round((CASE WHEN mean < 0.3 THEN 0.7 ELSE 1 END)::DOUBLE * CASE WHEN id % 4 = 0 THEN 0.85 ELSE 1 END * CASE WHEN area_term IS NOT NULL AND id % 6 >= 3 THEN 0.9 ELSE 1 END, 6) AS weight FROM m""",
    "B13_read_weight": f"WITH {ctes('articles')} SELECT id, round(CASE WHEN id % 3 = 0 THEN least(1.0, greatest(0.0, (id % 30 - 5) / 14)) ELSE 1.0 END, 6)::DOUBLE AS weight FROM articles",
    "B15_facet_selection": f"""WITH {ctes("entity_terms")} SELECT entity_id AS id FROM entity_terms WHERE term_id IN (100, 101, 102) INTERSECT SELECT entity_id FROM entity_terms WHERE term_id IN (201, 202)""",
    "B16_selectors": f"""WITH {ctes("terms")}, s AS (SELECT CASE WHEN range % 2 = 0 THEN concat('location:nation-', range) ELSE concat('vibe:vibe-', range) END AS selector FROM range(40))
SELECT selector, split_part(selector, ':', 1) AS facet, id AS term_id FROM s LEFT JOIN terms t ON t.facet = split_part(selector, ':', 1) AND slug = split_part(selector, ':', 2)""",
    "B20_trace": f"""WITH {ctes("places")} SELECT id, status = 'active' AND coalesce(type NOT IN ('stay', 'unknown'), false) AND area_term IS NOT NULL AS survived,
array_to_string(list_filter([CASE WHEN status <> 'active' THEN 'status=not active' END, CASE WHEN NOT coalesce(type NOT IN ('stay', 'unknown'), false) THEN concat('type=type ', coalesce(type, 'unknown')) END, CASE WHEN area_term IS NULL THEN 'area=no area' END], lambda x: x IS NOT NULL), ';') AS failed FROM places""",
    "F2_ladder": f"""WITH {ctes("places")}, p AS (SELECT *, {_DIST} AS m FROM places WHERE status = 'active' AND lat IS NOT NULL AND type IS NOT NULL), g AS (SELECT *, CASE WHEN m <= 2000 THEN 0 WHEN m <= 5000 THEN 1 WHEN m <= 15000 THEN 2 ELSE 3 END AS first FROM p),
n AS (SELECT type, r, (SELECT count(*) FROM g x WHERE x.type = t.type AND x.first <= r) AS have FROM (SELECT DISTINCT type FROM g) t, range(4) s(r)),
stop AS (SELECT type, coalesce(min(r) FILTER (have >= 6), 3) AS rung FROM n GROUP BY 1)
SELECT type, id, rung FROM g JOIN stop USING (type) WHERE first <= rung QUALIFY row_number() OVER (PARTITION BY type ORDER BY m, id) <= 6""",
    "F1_top_k": "SELECT doc_id AS id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
    "F4_section_capped": f"""WITH {ctes("articles")}, s AS (SELECT id, coalesce(primary_type, '(none)') AS primary_type, n_chars FROM articles QUALIFY row_number() OVER (PARTITION BY coalesce(primary_type, '(none)') ORDER BY n_chars DESC, id) <= 2)
SELECT id, primary_type, row_number() OVER (ORDER BY n_chars DESC, id) AS rank FROM s QUALIFY rank <= 9""",
    "F5_bucketed_fill": f"WITH {ctes('articles')} SELECT primary_type, id, row_number() OVER (PARTITION BY primary_type ORDER BY published_day DESC NULLS LAST, id) AS rank FROM articles WHERE primary_type IS NOT NULL QUALIFY rank <= 3",
    "F6_complements": f"WITH {ctes('relations', 'articles')}, s AS (SELECT type, string_split(complements_csv, ',') AS l FROM relations WHERE complements_csv <> '') SELECT id, l[i] AS section, i AS rank FROM articles JOIN s ON type = primary_type, range(1, 4) t(i) WHERE i <= len(l)",
    "E3_order_keeping_dedup": f"""WITH {ctes("articles")}, b AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, id) AS was FROM articles QUALIFY was <= 200),
d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY coalesce(series_key, concat('no:', id)) ORDER BY was) = 1) SELECT id, was, row_number() OVER (ORDER BY was) AS rank FROM d""",
    "E6_renumber": f"""WITH {ctes("articles")}, b AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, id) AS was FROM articles QUALIFY was <= 30) SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY was) AS rank FROM b WHERE id % 3 <> 0""",
    "F8_stratified_sample": f"""WITH {ctes("articles")}, a AS (SELECT lang, id, coalesce(primary_type, '(none)') AS v, sha256(concat('s7:', id)) AS h FROM articles), t AS (SELECT *, row_number() OVER (PARTITION BY lang, v ORDER BY h) AS turn FROM a)
SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY turn, sha256(concat('s7:', v)), h) AS rank FROM t QUALIFY rank <= 12""",
    "E10_stable_hash": "SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('seed:', doc_id))) AS rank FROM documents QUALIFY rank <= 3",
    "F9_queue_order": f"WITH {ctes('entity_terms')} SELECT term_id, entity_id, row_number() OVER (PARTITION BY term_id ORDER BY CASE WHEN source = 'ai' THEN 0 ELSE 1 END, confidence NULLS FIRST, entity_id, term_id) AS rank FROM entity_terms QUALIFY rank <= 5",
    "F10_top_share": f"""WITH {ctes("mentions")}, c AS (SELECT place_id, count(*) AS n FROM mentions GROUP BY 1), t AS (SELECT n FROM c ORDER BY n DESC, place_id LIMIT 100)
SELECT (SELECT sum(n) FROM t)::BIGINT AS top, (SELECT sum(n) FROM c)::BIGINT AS total, round((SELECT sum(n) FROM t) / (SELECT sum(n) FROM c), 6) AS share""",
    "F11_pins_then_fill": f"""WITH {ctes("articles")}, p AS (SELECT lang, id, 0 AS band, NULL AS d FROM articles WHERE id % 50 = 7 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY id) <= 4),
r AS (SELECT lang, id, 1 AS band, published_day AS d FROM articles WHERE id NOT IN (SELECT id FROM p)), u AS (SELECT * FROM p UNION ALL SELECT * FROM r)
SELECT lang, id, band, row_number() OVER (PARTITION BY lang ORDER BY band, d DESC NULLS LAST, id) AS rank FROM u QUALIFY rank <= 10""",
    "F12_spread": """WITH r AS (SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, id FROM r WHERE n <= 5 OR i IN (0, floor(n / 5), floor(2 * n / 5), floor(3 * n / 5), floor(4 * n / 5))""",
    "C10_one_row_cross": f"WITH {ctes('articles')} SELECT id, max(published_day) OVER () - published_day AS behind, n_chars - min(n_chars) OVER () AS over FROM articles",
}
