"""Queries over behaviour logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour as b
from .fixtures import ctes, interactions

#: 2024-01-31 00:00 UTC; the log spans 2024-01-01 to 2024-01-30.
AS_OF = 1706659200
GAP = 12 * 3600
_KINDS = ("view", "click", "purchase")


def _rails(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.concat(F.lit("rail"), F.col("id").cast("string")).alias("rail"))


def _railed(log: DataFrame) -> DataFrame:
    """Rail strings with an experiment's variant for some."""
    base = F.concat(F.lit("rail"), (F.col("entity_id").cast("long") % 6).cast("string"))
    return log.withColumn("rail", F.when(F.col("entity_id").cast("long") % 6 < 3, F.concat(base, F.when(F.col("user_id") % 2 == 0, "~a").otherwise("~b"))).otherwise(base))


_SQL_RAILED = """railed AS (SELECT *, CASE WHEN CAST(entity_id AS BIGINT) % 6 < 3 THEN concat('rail', CAST(entity_id AS BIGINT) % 6, CASE WHEN user_id % 2 = 0 THEN '~a' ELSE '~b' END)
  ELSE concat('rail', CAST(entity_id AS BIGINT) % 6) END AS rail FROM interactions)"""
_SQL_SESSIONS = f"""s0 AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM interactions WHERE kind IN ('view', 'click', 'purchase')),
sessions AS (SELECT *, concat(user_id, '-', sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id)) AS session_id FROM s0)"""
_SQL_COVIS = """seen AS (SELECT DISTINCT session_id, entity_id FROM sessions WHERE entity_id IS NOT NULL),
totals AS (SELECT entity_id, count(*) AS session_count FROM seen GROUP BY 1),
covis AS (SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS co_count FROM seen a JOIN seen b USING (session_id) WHERE a.entity_id <> b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.sessionize(interactions(spark, sf_dir).filter(F.col("kind").isin(*_KINDS)), GAP)


def _covisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.covisitation(sessions(spark, sf_dir))


def D7_covisitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covisited(spark, sf_dir).withColumn("score", F.round("score", 6))


def C6_session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs once each, with how many sessions they share."""
    return _covisited(spark, sf_dir).filter("entity_a < entity_b").select("entity_a", "entity_b", "co_count")


def E8_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.sessionize(interactions(spark, sf_dir), 1800)
    return found.groupBy("user_id", "session_id").agg(F.count("*").alias("events"), (F.max("sec") - F.min("sec")).alias("seconds"))


def C7_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _railed(interactions(spark, sf_dir)).withColumn("rail", F.substring_index("rail", "~", 1))
    joined = b.interval_join(log.filter("kind = 'view'").select("event_id", "user_id", "sec"), log.filter("kind = 'click'").select("user_id", "sec", "rail"), "user_id", 300, 1800)
    return joined.select("event_id", "user_id", "mark_rail", (F.col("mark_at") - F.col("sec")).alias("after_s"))


def D4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _railed(interactions(spark, sf_dir)).withColumn("rail", F.substring_index("rail", "~", 1))
    views, marks = log.filter("kind = 'view'").select("event_id", "user_id", "sec"), log.filter("kind = 'click'").select("user_id", "sec", "rail")
    return b.coverage(views, marks, _rails(spark), "user_id", 300, 1800).withColumn("coverage", F.round("coverage", 6))


def D1_rail_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _railed(interactions(spark, sf_dir)).withColumn("position", F.col("event_id") % 6 + 1)
    return b.count_windows(log.filter("kind = 'click'"), ["rail", "position"], "sec", AS_OF)


def D2_variant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.count_windows(_railed(interactions(spark, sf_dir)).filter("kind = 'view'"), ["rail"], "sec", AS_OF)
    base, variant = b.split_variant(F.col("rail"))
    return counts.groupBy(base.alias("base_rail"), variant.alias("variant")).agg(F.sum("n7").alias("n7"), F.sum("n30").alias("n30"))


def D3_ctr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _railed(interactions(spark, sf_dir)).withColumn("rail", F.substring_index("rail", "~", 1))
    views, clicks = (b.count_windows(log.filter(F.col("kind") == k), ["rail"], "sec", AS_OF) for k in ("view", "click"))
    return b.ctr_summary(views, clicks, _rails(spark)).withColumns({c: F.round(c, 6) for c in ("ctr7", "ctr30")})


def D5_daily_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = interactions(spark, sf_dir)
    return b.daily_totals([log.filter("kind = 'view'"), log.filter("kind <> 'view'")], "2023-12-28", "2024-02-02").select(F.col("day").cast("string").alias("day"), "n")


def L8_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days by kind."""
    return interactions(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").cast("string").alias("day"), "kind", "n")


def L9_trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day the events of the seven days up to it: sliding windows by day."""
    days = interactions(spark, sf_dir).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return days.select(F.date_sub(F.to_date("w.end"), 1).cast("string").alias("day"), "n", "users")


def D6_most_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.most_read(interactions(spark, sf_dir).filter("kind = 'view'"), 5, 100)


def E4_window_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with the total over all rows beside them."""
    counts = interactions(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))))


def L10_session_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest twenty events of their last half hour."""
    log = interactions(spark, sf_dir).filter(F.col("kind").isin("view", "click"))
    ends = log.groupBy("user_id").agg(F.max("sec").alias("end"))
    recent = log.join(ends, "user_id").filter(F.col("sec") >= F.col("end") - 1800)
    return b.latest(recent, ["user_id"], "sec", 20, "event_id").select("user_id", "event_id", "entity_id")


def L11_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = b.rate_limit(interactions(spark, sf_dir).select("user_id", "sec", "event_id"), ["user_id"], "sec", 86400, 2)
    return judged.groupBy("user_id").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.count(F.when(~F.col("allowed"), 1)).alias("refused"))


def _kinds(log: DataFrame) -> DataFrame:
    """purchase stands for a scroll and signup for a dwell, with measures from the value."""
    kind = F.when(F.col("kind") == "purchase", "scroll").when(F.col("kind") == "signup", "dwell").otherwise(F.col("kind"))
    return log.withColumns({"kind": kind, "dwell_ms": (F.col("event_id") % 5 * 10000).cast("long"), "scroll_pct": F.col("event_id") % 100})


_SQL_TASTE = f"""k AS (SELECT event_id, user_id, entity_id, sec, CASE kind WHEN 'purchase' THEN 'scroll' WHEN 'signup' THEN 'dwell' ELSE kind END AS kind, event_id % 5 * 10000 AS dwell_ms, event_id % 100 AS scroll_pct FROM interactions),
newest AS (SELECT * FROM k WHERE kind IN ('click', 'dwell', 'scroll') AND sec >= {AS_OF} - 180 * 86400 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) <= 20),
weighed AS (SELECT user_id, entity_id, CASE WHEN kind = 'click' THEN 0.3 WHEN kind = 'dwell' AND dwell_ms >= 30000 THEN 0.6 WHEN kind = 'scroll' AND scroll_pct >= 70 THEN 0.8 ELSE 0 END::DOUBLE AS weight FROM newest),
taste AS (SELECT user_id, entity_id, max(weight) AS weight FROM weighed WHERE weight > 0 GROUP BY 1, 2)"""


def P1_taste_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.taste_inputs(_kinds(interactions(spark, sf_dir)), AS_OF)


def G10_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = interactions(spark, sf_dir).select("event_id", F.col("user_id").alias("anon_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"), "sec")
    identities = log.filter("anon_id % 4 = 0").select("anon_id", (F.col("anon_id") + 1000000).alias("identity")).distinct()
    done = b.stitch(log, identities, AS_OF, 10, 30)
    return done.groupBy("anon_id").agg(F.count("user_id").alias("known"), F.count(F.when(F.col("user_id") >= 1000000, 1)).alias("stitched"))


_W = f"WITH {ctes('interactions')}"
QUERIES = {f.__name__: f for f in (D7_covisitation, C6_session_pairs, E8_sessions, C7_interval_join, D4_coverage, D1_rail_windows, D2_variant_split, D3_ctr_summary, D5_daily_health, L8_daily_counts, L9_trailing_windows, D6_most_read, E4_window_total, L10_session_intent, L11_rate_limit, P1_taste_inputs, G10_stitch)}

ORACLE = {
    "D7_covisitation": f"{_W}, {_SQL_SESSIONS}, {_SQL_COVIS} SELECT entity_a, entity_b, co_count, session_count, round(co_count / session_count, 6) AS score FROM covis JOIN totals ON entity_a = entity_id",
    "C6_session_pairs": f"{_W}, {_SQL_SESSIONS}, {_SQL_COVIS} SELECT entity_a, entity_b, co_count FROM covis WHERE entity_a < entity_b",
    "E8_sessions": f"""{_W}, s AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) <= 1800 THEN 0 ELSE 1 END AS fresh FROM interactions),
t AS (SELECT *, concat(user_id, '-', sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id)) AS session_id FROM s)
SELECT user_id, session_id, count(*) AS events, max(sec) - min(sec) AS seconds FROM t GROUP BY 1, 2""",
    "C7_interval_join": f"""{_W}, {_SQL_RAILED} SELECT v.event_id, v.user_id, split_part(c.rail, '~', 1) AS mark_rail, c.sec - v.sec AS after_s
FROM railed v JOIN railed c ON v.user_id = c.user_id AND c.sec BETWEEN v.sec - 300 AND v.sec + 1800 WHERE v.kind = 'view' AND c.kind = 'click'""",
    "D4_coverage": f"""{_W}, {_SQL_RAILED}, rails AS (SELECT concat('rail', range) AS rail FROM range(8)),
h AS (SELECT split_part(c.rail, '~', 1) AS rail, count(DISTINCT v.event_id) AS covered FROM railed v JOIN railed c ON v.user_id = c.user_id AND c.sec BETWEEN v.sec - 300 AND v.sec + 1800 WHERE v.kind = 'view' AND c.kind = 'click' GROUP BY 1),
n AS (SELECT count(*) AS views FROM interactions WHERE kind = 'view')
SELECT rails.rail, views, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / nullif(views, 0), 6) AS coverage FROM rails CROSS JOIN n LEFT JOIN h USING (rail)""",
    "D1_rail_windows": f"""{_W}, {_SQL_RAILED} SELECT rail, event_id % 6 + 1 AS position, count(*) FILTER (sec >= {AS_OF} - 7 * 86400) AS n7, count(*) AS n30
FROM railed WHERE kind = 'click' AND sec >= {AS_OF} - 30 * 86400 GROUP BY 1, 2""",
    "D2_variant_split": f"""{_W}, {_SQL_RAILED} SELECT split_part(rail, '~', 1) AS base_rail, nullif(split_part(rail, '~', 2), '') AS variant, count(*) FILTER (sec >= {AS_OF} - 7 * 86400) AS n7, count(*) AS n30
FROM railed WHERE kind = 'view' AND sec >= {AS_OF} - 30 * 86400 GROUP BY 1, 2""",
    "D3_ctr_summary": f"""{_W}, {_SQL_RAILED}, rails AS (SELECT concat('rail', range) AS rail FROM range(8)),
c AS (SELECT split_part(rail, '~', 1) AS rail, count(*) FILTER (kind = 'view' AND sec >= {AS_OF} - 7 * 86400) AS impressions7, count(*) FILTER (kind = 'view') AS impressions30,
  count(*) FILTER (kind = 'click' AND sec >= {AS_OF} - 7 * 86400) AS clicks7, count(*) FILTER (kind = 'click') AS clicks30 FROM railed WHERE sec >= {AS_OF} - 30 * 86400 GROUP BY 1)
SELECT rail, coalesce(impressions7, 0) AS impressions7, coalesce(impressions30, 0) AS impressions30, coalesce(clicks7, 0) AS clicks7, coalesce(clicks30, 0) AS clicks30,
  round(clicks7 / nullif(impressions7, 0), 6) AS ctr7, round(clicks30 / nullif(impressions30, 0), 6) AS ctr30 FROM rails LEFT JOIN c USING (rail)""",
    "D5_daily_health": """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(event_id) AS n FROM generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY) t(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1""",
    "L8_daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "L9_trailing_windows": """WITH x AS (SELECT CAST(ts AS DATE) + CAST(unnest(range(7)) AS INTEGER) AS day, user_id FROM events) SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM x GROUP BY 1""",
    "D6_most_read": f"""{_W}, c AS (SELECT entity_id, count(*) AS n FROM interactions WHERE kind = 'view' GROUP BY 1), t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM c)
SELECT entity_id, n, total FROM t WHERE total >= 100 ORDER BY n DESC, entity_id LIMIT 5""",
    "E4_window_total": "SELECT event_type AS kind, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) OVER () AS kinds FROM events GROUP BY 1",
    "L10_session_intent": f"""{_W}, l AS (SELECT *, max(sec) OVER (PARTITION BY user_id) AS e FROM interactions WHERE kind IN ('view', 'click'))
SELECT user_id, event_id, entity_id FROM l WHERE sec >= e - 1800 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) <= 20""",
    "L11_rate_limit": f"""{_W}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, sec // 86400 ORDER BY sec, event_id) <= 2 AS ok FROM interactions) SELECT user_id, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused FROM r GROUP BY 1""",
    "P1_taste_inputs": f"{_W}, {_SQL_TASTE} SELECT * FROM taste",
    "G10_stitch": f"""{_W}, l AS (SELECT event_id, user_id AS anon_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id, sec FROM interactions),
m AS (SELECT event_id FROM l WHERE user_id IS NULL AND anon_id % 4 = 0 AND sec >= {AS_OF} - 10 * 86400 QUALIFY row_number() OVER (PARTITION BY anon_id ORDER BY sec DESC, event_id DESC) <= 30)
SELECT anon_id, count(*) FILTER (user_id IS NOT NULL OR event_id IN (SELECT event_id FROM m)) AS known, count(*) FILTER (event_id IN (SELECT event_id FROM m)) AS stitched FROM l GROUP BY 1""",
}
