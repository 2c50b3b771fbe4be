"""Catalogue rules: scopes, lexicons, location mentions, subtypes, verdict cascades, regions, k-means, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c

#: Fixed values of the domain: which facets a type of article may have.
SCOPES = {"cuisine": ("eat", "drink"), "vibe": ("stay", "eat", "drink", "wellness", "do"), "price_band": ("stay", "eat", "drink", "wellness", "shop")}
PRICE_CUES = (("luxury", "(luxur|five-star|exclusive)"), ("upscale", "(upscale|fine dining|elegant)"), ("moderate", "(mid-range|affordable|reasonable)"), ("budget", "(cheap|budget|backpacker|street food)"))
SUBTYPES = (("villa", "villa"), ("resort", "resort"), ("hotel", "hotel"), ("beach-club", "beach club"), ("cafe", "(cafe|coffee)"), ("restaurant", "(restaurant|kitchen|dining)"), ("spa", "(spa|massage)"))
#: Fixed values of the domain: bands of confidence, and what one match and none, or several, are worth.
AUTO_APPLY, MEDIUM, ONE_MATCH, NO_MATCH = 0.85, 0.6, 0.70, 0.35
#: Words after a place name that make it a dish, not a place.
DISH = ("chicken", "coffee", "duck", "noodle", "rice", "sauce", "satay", "style")
SPECIFICITY = ("venue", "street", "area", "city", "country")


def in_scope(facet: Column, primary_type: Column) -> Column:
    """Facets without a scope are for all."""
    ok = F.lit(True)
    for name, types in SCOPES.items():
        ok = F.when(facet == name, F.coalesce(primary_type.isin(*types), F.lit(False))).otherwise(ok)
    return ok


def first_match(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern that a text has."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), label).otherwise(out)
    return out


def lexicon_pattern(words: list[str]) -> str:
    """One pattern for whole words, longest first, with ASCII edges."""
    import re

    return "(?:^|[^a-z0-9])(" + "|".join(re.escape(w.lower()) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")(?:[^a-z0-9]|$)"


def hidden_rivals(titles: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """(id, matched_type) of types whose words a title has, whatever it is filed under."""
    found = None
    for kind, words in lexicon.items():
        part = titles.filter(F.lower("title").rlike(lexicon_pattern(words))).select("id", F.lit(kind).alias("matched_type"))
        found = part if found is None else found.unionByName(part)
    return found


def mentions_place(text: Column, name: str) -> Column:
    """Whether a text names a place and not a dish called after it."""
    dishes = "|".join(DISH)
    return F.lower(text).rlike(f"(^|[^a-z]){name.lower()}(?! ({dishes}))([^a-z]|$)")


def names_agree(asked: Column, found: Column, common: tuple[str, ...]) -> Column:
    """Every telling word of the one asked for is in the one found."""
    words = lambda n: F.filter(F.split(c.normalize_name(n), " "), lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, common)), w))
    return (F.size(words(asked)) > 0) & (F.size(F.array_except(words(asked), words(found))) == 0)


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.6, "medium").when(confidence.isNotNull(), "low").otherwise("none")


def specificity(granularity: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, SPECIFICITY)), granularity)
    return F.when(at > 0, at).otherwise(len(SPECIFICITY) + 1)


def unique_slugs(rows: DataFrame, name: str, key: str) -> DataFrame:
    """rows with slug; later ones of a slug get -2, -3 ... by key."""
    base = rows.withColumn("__s", c.slugify(F.col(name)))
    n = F.row_number().over(Window.partitionBy("__s").orderBy(key))
    return base.withColumn("slug", F.when(n == 1, F.col("__s")).otherwise(F.concat("__s", F.lit("-"), n.cast("string")))).drop("__s")


def cascade(*answers: tuple[str, Column]) -> Column:
    """struct(value, by): the first answer that isn't null and who gave it."""
    value = F.coalesce(*[a for _, a in answers])
    by = F.lit("none")
    for name, a in reversed(answers):
        by = F.when(a.isNotNull(), name).otherwise(by)
    return F.struct(value.alias("value"), by.alias("by"))


def region_verdict(places: DataFrame, matched: DataFrame, closure: DataFrame, home: int) -> DataFrame:
    """(id, verdict): inside where the area matched lies under the home node, outside where it lies elsewhere, unknown without one."""
    up = closure.filter(F.col("ancestor") == home).select(F.col("id").alias("__a"))
    out = places.select("id").join(matched, "id", "left").join(up, F.col("area_id") == F.col("__a"), "left")
    return out.select("id", F.when(F.col("area_id").isNull(), "unknown").when(F.col("__a").isNotNull(), "inside").otherwise("outside").alias("verdict"))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of rows (from 1) with the total beside them."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size).crossJoin(F.broadcast(total))


def k_means(vectors: DataFrame, k: int, seed: int = 7, key: str = "vec_id") -> tuple[DataFrame, float]:
    """(key, cluster) by cosine, and the silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows).transform(rows)
    return found.select(key, F.col("prediction").alias("cluster")), ClusteringEvaluator(distanceMeasure="cosine").evaluate(found)


def seeded_vector(text: Column, dim: int = 64) -> Column:
    """A unit vector that follows from the text's hash: a stand-in for an embedding where none can be had."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(2_000_001)) / 1e6 - 1.0)
    return F.transform(raw, lambda x: x / F.nullif(c.norm(raw), F.lit(0.0)))


def title_clusters(articles: DataFrame) -> DataFrame:
    """(key, members, first, kind, series_key) of titles (id, title, series_key) that are alike but for what a yearly refresh changes.

    Conflict: members carry several series already, so a person must decide and none is given. Else the
    series is the one that some carry, or a new one by the title; confident where
    years or an 'updated' differ, uncertain where the titles are the same.
    """
    title = F.col("title")
    signal = F.concat_ws("|", F.array_join(c.years(title), ","), F.lower(title).rlike("(^|[^a-z0-9])updated([^a-z0-9]|$)").cast("string"))
    keyed = articles.select("id", "series_key", c.normalize_title(title).alias("key"), signal.alias("signal")).filter("key <> ''")
    own = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("first"), F.count_distinct("signal").alias("signals"), F.count_distinct("series_key").alias("known"), F.min("series_key").alias("series"))
    kind = F.when(F.col("known") > 1, "conflict").when(F.col("signals") > 1, "confident").otherwise("uncertain")
    series = F.when(F.col("known") == 1, F.col("series")).when(F.col("known") == 0, F.regexp_replace("key", " ", "-"))
    return own.filter("members >= 2").select("key", "members", "first", kind.alias("kind"), series.alias("series_key"))


def confidence_band(value: Column) -> Column:
    """high from what is applied without a person on, medium from 0.6 on, else low; null stays null."""
    return F.when(value >= AUTO_APPLY, "high").when(value >= MEDIUM, "medium").when(value.isNotNull(), "low")


def subtype(name: Column, rules: tuple[tuple[str, str], ...] = SUBTYPES) -> tuple[Column, Column]:
    """(subtype, confidence): the first pattern that a name has, surer where it is the only one."""
    met = sum((F.lower(name).rlike(pattern).cast("int") for _, pattern in rules), F.lit(0))
    return first_match(name, rules), F.when(met == 1, ONE_MATCH).otherwise(NO_MATCH)
