"""Behaviour logs: sessions, co-visitation, coverage, click-through, daily health, tastes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the domain: what each kind of interaction says about taste, and from where dwell and scroll count.
WEIGHTS = {"click": 0.3, "dwell": 0.6, "scroll": 0.8}
SAVED_WEIGHT = 1.0
DWELL_MS, SCROLL_PCT = 30_000, 70
TASTE_DAYS, TASTE_ROWS = 180, 20


def qualifies(kind: Column, dwell_ms: Column | None = None, scroll_pct: Column | None = None) -> Column:
    """A click, a long dwell or a deep scroll."""
    out = kind == "click"
    if dwell_ms is not None:
        out = out | ((kind == "dwell") & (F.coalesce(dwell_ms, F.lit(0)) >= DWELL_MS))
    if scroll_pct is not None:
        out = out | ((kind == "scroll") & (F.coalesce(scroll_pct, F.lit(0)) >= SCROLL_PCT))
    return out


def sessionize(events: DataFrame, gap_s: int, user: str = "user_id", at: str = "sec", order: str = "event_id") -> DataFrame:
    """events with session_id: a user's new one begins after more than gap_s seconds of nothing."""
    w = Window.partitionBy(user).orderBy(at, order)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap_s, 0).otherwise(1)
    marked = events.withColumn("__new", new)
    return marked.withColumn("session_id", F.concat_ws("-", F.col(user).cast("string"), F.sum("__new").over(w).cast("string"))).drop("__new")


def covisitation(visits: DataFrame, min_support: int = 2) -> DataFrame:
    """Directed pairs of entities that share sessions: (entity_a, entity_b, co_count, session_count, score).

    visits: (session_id, entity_id). Sessions are met as distinct pairs, so a
    repeated visit adds nothing; totals come from the same distinct rows.
    """
    seen = visits.filter("session_id IS NOT NULL AND entity_id IS NOT NULL").select("session_id", "entity_id").distinct()
    totals = seen.groupBy(F.col("entity_id").alias("entity_a")).agg(F.count("*").alias("session_count"))
    a, b = seen.withColumnRenamed("entity_id", "entity_a"), seen.withColumnRenamed("entity_id", "entity_b")
    pairs = a.join(b, "session_id").filter("entity_a <> entity_b").groupBy("entity_a", "entity_b").agg(F.count("*").alias("co_count")).filter(F.col("co_count") >= min_support)
    return pairs.join(totals, "entity_a").select("entity_a", "entity_b", "co_count", "session_count", (F.col("co_count") / F.col("session_count")).alias("score"))


def interval_join(views: DataFrame, marks: DataFrame, key: str, before_s: int, after_s: int, at: str = "sec") -> DataFrame:
    """Views with each mark of the same key from before_s before to after_s after: equal keys and time buckets, then the exact test.

    Buckets as long as the interval keep a key with a long history from meeting itself as a whole.
    """
    span = max(before_s + after_s, 1)
    bucket = lambda c: F.floor(c / span)
    left = views.withColumn("__b", F.explode(F.sequence(bucket(F.col(at) - before_s), bucket(F.col(at) + after_s))))
    right = marks.select(F.col(key).alias("__key"), F.col(at).alias("mark_at"), bucket(F.col(at)).alias("__mb"), *[F.col(c).alias(f"mark_{c}") for c in marks.columns if c not in (key, at)])
    near = (left["__b"] == right["__mb"]) & (left[key] == right["__key"]) & right["mark_at"].between(F.col(at) - before_s, F.col(at) + after_s)
    return left.join(right, near).drop("__b", "__key", "__mb")


def coverage(views: DataFrame, marks: DataFrame, rails: DataFrame, key: str, before_s: int = 5, after_s: int = 30) -> DataFrame:
    """For every canonical rail the share of views that a mark of it follows: (rail, views, covered, coverage)."""
    hits = interval_join(views, marks, key, before_s, after_s).groupBy(F.col("mark_rail").alias("rail")).agg(F.count_distinct("event_id").alias("covered"))
    total = views.agg(F.count("*").alias("views"))
    return rails.crossJoin(F.broadcast(total)).join(hits, "rail", "left").select("rail", "views", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) / F.expr("nullif(views, 0)")).alias("coverage"))


def count_windows(log: DataFrame, by: list[str], at: str, as_of: int, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Rows by key within the trailing windows, in one pass: n7, n30, ..."""
    recent = log.filter(F.col(at) >= as_of - max(days) * 86400)
    return recent.groupBy(*by).agg(*[F.count(F.when(F.col(at) >= as_of - d * 86400, 1)).alias(f"n{d}") for d in days])


def split_variant(rail: Column) -> tuple[Column, Column]:
    """A rail string 'base~variant' as its two parts; no or an empty variant is null."""
    return F.substring_index(rail, "~", 1), F.when(F.instr(rail, "~") > 0, F.nullif(F.substring_index(rail, "~", -1), F.lit("")))


def ctr_summary(impressions: DataFrame, clicks: DataFrame, rails: DataFrame) -> DataFrame:
    """Impressions, clicks and their ratio of every canonical rail, those without any row included."""
    return (
        rails.join(impressions.withColumnsRenamed({"n7": "impressions7", "n30": "impressions30"}), "rail", "left")
        .join(clicks.withColumnsRenamed({"n7": "clicks7", "n30": "clicks30"}), "rail", "left")
        .na.fill(0, ["impressions7", "impressions30", "clicks7", "clicks30"])
        .withColumns({f"ctr{d}": F.col(f"clicks{d}") / F.expr(f"nullif(impressions{d}, 0)") for d in (7, 30)})
    )


def daily_totals(logs: list[DataFrame], first: str, last: str, ts: str = "ts") -> DataFrame:
    """(day, n) for every day from first to last over all logs; days without events are 0."""
    days = logs[0].sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = None
    for log in logs:
        part = log.select(F.to_date(ts).alias("day"))
        counts = part if counts is None else counts.unionAll(part)
    return days.join(counts.groupBy("day").agg(F.count("*").alias("n")), "day", "left").na.fill(0, ["n"])


def most_read(views: DataFrame, limit: int, at_least: int, key: str = "entity_id") -> DataFrame:
    """The most viewed entities with the total over all of them; nothing at all under at_least views."""
    counts = views.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), key).limit(limit)
    return top.crossJoin(F.broadcast(total)).filter(F.col("total") >= at_least)


def latest(log: DataFrame, by: list[str], at: str, rows: int, *ties: str) -> DataFrame:
    """The newest `rows` rows of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), *[F.desc(t) for t in ties])
    return log.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= rows).drop("__rn")


def taste_inputs(log: DataFrame, as_of: int, saved: DataFrame | None = None, rows: int = TASTE_ROWS, days: int = TASTE_DAYS) -> DataFrame:
    """(user_id, entity_id, weight): the strongest of a user's newest rows by entity; saved entities weigh most.

    The newest rows are taken first and weighed then, so weak ones use up places too.
    """
    known = log.filter(F.col("kind").isin(*WEIGHTS)).filter(F.col("sec") >= as_of - days * 86400)
    newest = latest(known, ["user_id"], "sec", rows, "event_id")
    weight = F.lit(0.0)
    for kind, w in WEIGHTS.items():
        enough = {"dwell": F.coalesce("dwell_ms", F.lit(0)) >= DWELL_MS, "scroll": F.coalesce("scroll_pct", F.lit(0)) >= SCROLL_PCT}.get(kind, F.lit(True))
        weight = F.when((F.col("kind") == kind) & enough, w).otherwise(weight)
    found = newest.withColumn("weight", weight).filter("weight > 0").select("user_id", "entity_id", "weight")
    if saved is not None:
        found = found.unionByName(saved.select("user_id", "entity_id", F.lit(SAVED_WEIGHT).alias("weight")))
    return found.groupBy("user_id", "entity_id").agg(F.max("weight").alias("weight"))


def rate_limit(log: DataFrame, by: list[str], at: str, size_s: int, limit: int) -> DataFrame:
    """The log with allowed: whether a row is among the first `limit` of its key's fixed window."""
    w = Window.partitionBy(*by, "__window").orderBy(at, *[c for c in log.columns if c not in (*by, at)][:1])
    return log.withColumn("__window", F.floor(F.col(at) / size_s)).withColumn("allowed", F.row_number().over(w) <= limit).drop("__window")


def stitch(log: DataFrame, identities: DataFrame, as_of: int, days: int = 30, rows: int = 5000) -> DataFrame:
    """The log with user_id filled from (anon_id, identity) for each identity's newest rows without one."""
    open_ = log.filter(F.col("user_id").isNull() & (F.col("sec") >= as_of - days * 86400)).join(identities, "anon_id")
    mine = latest(open_, ["identity"], "sec", rows, "event_id").select("event_id", "identity")
    return log.join(mine, "event_id", "left").withColumn("user_id", F.coalesce("user_id", "identity")).drop("identity")
