"""Whole runs, put together from the operators: rail bundles, tagging, mentions, geocoding, seeds of taste, saved items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from . import integrity, junk, resolution
from .retrieval import mean_vectors

#: Fixed values of the domain: how surely a word in each zone names its term, and the least closeness to a term's centroid that tags.
ZONE_CONFIDENCE = {"A": 0.9, "B": 0.7, "C": 0.5}
EMBEDDING_FLOOR = 0.45


def bundle(subjects: DataFrame, cached: DataFrame, rails: dict[str, DataFrame], now: Column, max_age: Column) -> DataFrame:
    """(subject_id, rail, id, rank, cache_hit): a subject's rails from the cache where all of them are there and none is too old, else made anew.

    cached: (subject_id, rail, id, rank, computed_at); rails by name: (subject_id, id, rank).
    """
    ours = cached.filter(F.col("rail").isin(*rails))
    age = ours.groupBy("subject_id", "rail").agg(F.min("computed_at").alias("at"))
    fresh = age.groupBy("subject_id").agg(F.count("*").alias("n"), F.min("at").alias("at")).filter((F.col("n") == len(rails)) & (now - F.col("at") <= max_age))
    hit = subjects.join(fresh.select("subject_id"), "subject_id", "left_semi").select("subject_id")
    out = ours.join(hit, "subject_id", "left_semi").select("subject_id", "rail", "id", "rank", F.lit(True).alias("cache_hit"))
    miss = subjects.join(hit, "subject_id", "left_anti").select("subject_id")
    for name, rows in rails.items():
        out = out.unionByName(rows.join(miss, "subject_id", "left_semi").select("subject_id", F.lit(name).alias("rail"), "id", "rank", F.lit(False).alias("cache_hit")))
    return out


def tagging_run(lexical: DataFrame, close: DataFrame, edited: DataFrame) -> DataFrame:
    """(entity_id, term_id, confidence, source): tags by words and by closeness, the surer of both; what editors have tagged stays theirs.

    lexical: (entity_id, term_id, zone); close: (entity_id, term_id, similarity); edited: (entity_id, term_id).
    """
    sure = F.create_map(*[x for z, w in ZONE_CONFIDENCE.items() for x in (F.lit(z), F.lit(w))])
    words = lexical.select("entity_id", "term_id", sure[F.col("zone")].alias("confidence"), F.lit("lexical").alias("source"))
    near = close.filter(F.col("similarity") >= EMBEDDING_FLOOR).select("entity_id", "term_id", F.col("similarity").alias("confidence"), F.lit("embedding").alias("source"))
    best = words.unionByName(near).groupBy("entity_id", "term_id").agg(F.max(F.struct("confidence", "source")).alias("b"))
    return best.join(edited, ["entity_id", "term_id"], "left_anti").select("entity_id", "term_id", "b.confidence", "b.source")


def mention_run(docs: DataFrame, gazetteer: DataFrame, known: DataFrame) -> DataFrame:
    """(article_id, place_id, surface_text) of new mentions: names in texts that are no junk, looked up, less the (article_id, place_id) that are known.

    docs: (id, text); gazetteer: (place_id, name). A name is looked up once, however many texts have it; of several
    names for one place in a text the first by alphabet stands.
    """
    names = resolution.extract_names(docs)
    verdict, _ = junk.verdict(F.col("name"))
    fit = names.filter(verdict != "junk")
    found = resolution.lookup(fit.select(F.col("name").alias("mention")).distinct(), gazetteer)
    rows = fit.join(found.select(F.col("mention").alias("name"), "place_id"), "name").groupBy(F.col("id").alias("article_id"), "place_id").agg(F.min("name").alias("surface_text"))
    return rows.join(known.select("article_id", "place_id"), ["article_id", "place_id"], "left_anti")


def geocode_run(rows: DataFrame, sources: list[tuple[str, DataFrame]], areas: DataFrame) -> DataFrame:
    """(key, name, slug, lat, lng, step, area_id) of candidates, one for each normal name: rows are merged, located by the first source that has a point in the country, and put in an area by name.

    rows: (id, name, address); sources: (step, (key, lat, lng)) in order; areas: (area_id, name, depth).
    """
    keyed = rows.withColumn("key", c.slugify(F.col("name"))).filter("key <> ''")
    merged = keyed.groupBy("key").agg(F.min_by("name", "id").alias("name"), F.min_by("address", F.when(F.col("address").isNotNull(), F.col("id"))).alias("address"))
    placed = resolution.geocode(merged, sources)
    said = resolution.match_areas(placed.select(F.col("key").alias("id"), F.col("address").alias("text")), areas)
    return placed.join(said.withColumnRenamed("id", "key"), "key", "left").select("key", "name", F.col("key").alias("slug"), "lat", "lng", "step", "area_id")


def stated_seed(picks: DataFrame, term_vectors: DataFrame, tags: DataFrame, article_vectors: DataFrame) -> DataFrame:
    """(user_id, vector): the mean of two means, that of the vectors of the picked terms and that of all articles tagged with one of them; the first alone where no article has a vector.

    picks: (user_id, term_id); term_vectors: (term_id, embedding); tags: (entity_id, term_id); article_vectors: (entity_id, embedding).
    """
    terms = mean_vectors(picks.select("user_id", "term_id").distinct().join(term_vectors, "term_id"), ["user_id"])
    tagged = picks.join(tags.select("entity_id", "term_id"), "term_id").select("user_id", "entity_id").distinct()
    articles = mean_vectors(tagged.join(article_vectors, "entity_id"), ["user_id"]).withColumnRenamed("vector", "__a")
    both = F.zip_with("vector", "__a", lambda x, y: (x + y) / 2)
    return terms.join(articles, "user_id", "left").select("user_id", F.coalesce(both, "vector").alias("vector"))


def saved_items(log: DataFrame, limit: int) -> DataFrame:
    """(user_id, entity_id, saved_at, rank): what each user has saved and not taken back since, newest first. log: (user_id, entity_id, action save or remove, at, event_id)."""
    last = log.groupBy("user_id", "entity_id").agg(F.max(F.struct("at", "event_id", "action")).alias("l")).filter("l.action = 'save'")
    rows = last.select("user_id", "entity_id", F.col("l.at").alias("saved_at"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("saved_at"), "entity_id"))).filter(F.col("rank") <= limit)


def click_events(clicks: DataFrame, campaign: str) -> DataFrame:
    """Outbound click events as they are stored: links as their partner's tier has them; clicks without a valid place id are dropped. clicks: (event_id, at, place_id string, href, tier)."""
    link = integrity.decorate_link(F.col("href"), F.col("tier"), campaign)
    good = clicks.filter(integrity.valid_native_id(F.col("place_id")) & F.col("href").isNotNull())
    return good.select("event_id", F.lit("outbound").alias("kind"), F.lit("place").alias("entity_type"), F.col("place_id").alias("entity_id"), F.coalesce(link["href"], F.col("href")).alias("target_url"), "at")


def triage_scores(places: DataFrame, verdict: Column, region: Column, evidence: Column, partner: Column) -> DataFrame:
    """(id, action, score): what triage says of a place and the quality score that follows: nothing for what goes, half for what people should look at."""
    action = integrity.triage(verdict, region, evidence, partner)
    score = F.when(action == "archive", 0.0).when(action == "review", 0.5).otherwise(1.0)
    return places.select("id", action.alias("action"), score.alias("score"))
