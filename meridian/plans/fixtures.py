"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB read alike.

The operators take the domain tables (articles, places, interactions ...); these
views give them deterministic stand-ins on any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_DAY = 600

ARTICLES = """
SELECT doc_id AS id,
       CASE doc_id % 10 WHEN 0 THEN 'stay' WHEN 1 THEN 'eat' WHEN 2 THEN 'drink' WHEN 3 THEN 'wellness' WHEN 4 THEN 'shop'
            WHEN 5 THEN 'do' WHEN 6 THEN 'event' WHEN 7 THEN 'editorial' WHEN 8 THEN 'unknown' END AS primary_type,
       CASE doc_id % 6 WHEN 0 THEN 'news' WHEN 1 THEN 'event' WHEN 2 THEN 'review' WHEN 3 THEN 'guide' WHEN 4 THEN 'offer' END AS format,
       CASE WHEN doc_id % 7 < 2 THEN concat('s', CAST(doc_id % 40 AS STRING)) END AS series_key,
       CASE WHEN doc_id % 11 = 0 THEN 'draft' ELSE 'published' END AS status,
       CASE WHEN doc_id % 17 <> 0 THEN doc_id * 13 % 650 END AS published_day,
       doc_id % 13 AS author_id, lang, source, n_chars
FROM documents
"""

PLACES = """
SELECT CAST(p_partkey AS BIGINT) AS id,
       CASE p_partkey % 8 WHEN 0 THEN 'stay' WHEN 1 THEN 'eat' WHEN 2 THEN 'drink' WHEN 3 THEN 'wellness' WHEN 4 THEN 'shop'
            WHEN 5 THEN 'do' WHEN 6 THEN 'unknown' END AS type,
       CASE WHEN p_partkey % 13 = 0 THEN 'closed' ELSE 'active' END AS status,
       concat('Place ', p_name) AS name,
       CASE WHEN p_partkey % 5 <> 0 THEN concat('area', CAST(p_partkey % 12 AS STRING)) END AS area_term,
       CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 60 AS BIGINT) END AS org_id,
       CASE p_partkey % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'moderate' WHEN 2 THEN 'upscale' WHEN 3 THEN 'luxury' END AS price_band,
       CASE WHEN p_partkey % 29 <> 0 THEN -6.3e0 + (p_partkey * 37 % 1009) / 5e3 END AS lat,
       CASE WHEN p_partkey % 29 <> 0 THEN 106.7e0 + (p_partkey * 91 % 1013) / 5e3 END AS lng
FROM part
"""

SCORES = """
SELECT doc_id AS entity_id, quality * 0.5e0 + (doc_id % 10) * 0.05e0 AS score FROM labels
"""

MENTIONS = """
SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS id, CAST(l_orderkey % 997 AS BIGINT) AS article_id, CAST(l_partkey AS BIGINT) AS place_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'featured' WHEN 1 THEN 'reviewed' ELSE 'mentioned' END AS role
FROM lineitem
"""

TERMS = """
SELECT CAST(n_nationkey AS BIGINT) + 100 AS id, concat('nation-', CAST(n_nationkey AS STRING)) AS slug, n_name AS label, CAST(n_regionkey AS BIGINT) AS parent_id, 'location' AS facet FROM nation
UNION ALL
SELECT CAST(r_regionkey AS BIGINT) AS id, concat('region-', CAST(r_regionkey AS STRING)) AS slug, r_name AS label, CAST(NULL AS BIGINT) AS parent_id, 'location' AS facet FROM region
UNION ALL
SELECT CAST(n_nationkey AS BIGINT) + 200 AS id, concat('vibe-', CAST(n_nationkey AS STRING)) AS slug, concat('vibe ', n_name) AS label, CAST(NULL AS BIGINT) AS parent_id, 'vibe' AS facet FROM nation WHERE n_nationkey < 10
"""

ENTITY_TERMS = """
SELECT doc_id AS entity_id, 100 + doc_id % 25 AS term_id, (doc_id * 7 % 20) / 2e1 AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'editor' ELSE 'ai' END AS source FROM documents
UNION ALL
SELECT doc_id AS entity_id, 200 + doc_id % 10 AS term_id, (doc_id * 3 % 20) / 2e1 AS confidence, 'ai' AS source FROM documents WHERE doc_id % 3 <> 0
"""

#: Fixed values of the domain: who competes with and complements whom.
RELATIONS = """
SELECT * FROM (VALUES
  ('stay', true, 'eat,drink,do,wellness', ''), ('eat', true, 'stay,do,drink', 'drink'), ('drink', true, 'stay,do,eat', 'eat'),
  ('wellness', true, 'stay,eat', ''), ('shop', true, 'eat,do', ''), ('unknown', true, '', ''),
  ('do', false, 'stay,eat,drink', ''), ('event', false, 'stay,eat,drink', ''), ('editorial', false, 'stay,eat,drink,do', '')
) AS t(type, exclude_same, complements_csv, competes_csv)
"""

_TABLES = {"articles": (ARTICLES, ["documents"]), "places": (PLACES, ["part"]), "scores": (SCORES, ["labels"]), "mentions": (MENTIONS, ["lineitem"]), "terms": (TERMS, ["nation", "region"]), "entity_terms": (ENTITY_TERMS, ["documents"]), "relations": (RELATIONS, [])}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a domain table by name."""
    if name not in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = _TABLES[name]
    for t in needs:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    found = spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needs})
    if name == "relations":
        split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
        return found.select("type", "exclude_same", split("complements_csv").alias("complements"), split("competes_csv").alias("competes_with"))
    return found


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as interactions: user, entity (the k of props), kind, seconds since 1970, value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").alias("entity_id"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("sec"),
        "ts",
        "value",
    )


#: The same for DuckDB.
SQL_INTERACTIONS = """interactions AS (
  SELECT event_id, user_id, event_type AS kind, json_extract_string(props, '$.k') AS entity_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec, ts, value FROM events
)"""


def ctes(*names: str) -> str:
    """WITH clause items for DuckDB."""
    return ",\n".join(SQL_INTERACTIONS if n == "interactions" else f"{n} AS ({_TABLES[n][0]})" for n in names)
