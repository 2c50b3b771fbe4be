"""Queries of retrieval, ranking, vectors, text functions and personal taste."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.stemming import parse
from ..operators import behaviour as b
from ..operators import content, cues, latent, resolution
from ..operators import retrieval as r
from . import behaviour as bp
from .fixtures import AS_OF_DAY, ctes, interactions, table
from .stems import stem_ctes

CUES = {"stay": [("the", 1.0), ("hotel", 2.0)], "eat": [("on", 1.0), ("food", 2.0)], "drink": [("er", 0.5), ("wine", 2.0)]}
MARKERS = {"en": ("the", "and", "of", "that"), "fr": ("le", "la", "de", "et"), "de": ("der", "die", "und", "das"), "es": ("el", "los", "del", "que")}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a title (up to the first full stop) and a body."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", ".", 1).alias("title"), "text", "lang", "source", "n_chars")


#: What the searches ask: stems, alternatives, words in quotes, words ruled out.
SEARCHES = [(1, "Ering"), (2, "tion of the onings"), (3, '"de ci" or quelles'), (4, 'erly "nd nd" or aned -ther')]


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id long, query string")


def I1_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.websearch(_docs(spark, sf_dir), {"A": "title", "C": "text"}, _searches(spark), 20).select("query_id", "id", "score", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _knn(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return r.nearest(v, asked, limit)


def I2_exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 10)


_SQL_KNN = "knn AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"


def I4_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    long = r.ranked(docs, ["query_id"], [F.desc("n_chars"), F.col("id")], 80)
    by_hash = r.ranked(docs.filter("id % 3 = 0"), ["query_id"], [c.stable_rank("q", F.col("id"))], 80)
    return r.fuse([long, by_hash], 60).select("id", "score", "rails", "rank")


def I5_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors fused: documents carry the vector of their number modulo the embeddings'."""
    docs = _docs(spark, sf_dir)
    lexical = r.websearch(docs, {"A": "title", "C": "text"}, _searches(spark), 60)
    n = 500
    vecs = docs.select("id", (F.col("id") % n).alias("vec_id")).join(_vectors(spark, sf_dir).select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    asked = _vectors(spark, sf_dir).filter("vec_id BETWEEN 1 AND 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    semantic = r.nearest(vecs, asked, 60, "id", not_itself=False)
    return r.fuse([lexical.select("query_id", "id", "rank"), semantic.select("query_id", "id", "rank")], 20).select("query_id", "id", "score", "rank")


def F3_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    pool = _knn(spark, sf_dir, 40).join(v, "vec_id").select("query_id", F.col("vec_id").alias("id"), "rank", F.col("similarity").alias("relevance"), "embedding", (F.col("vec_id") % 30).alias("org_id"), (F.col("vec_id") % 7).alias("area_term"), F.col("label").alias("format"), (F.col("vec_id") % 11 == 0).alias("paid"))
    return r.diversify(pool, 10)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, s = table(spark, sf_dir, "articles"), table(spark, sf_dir, "scores")
    a = a.join(s.withColumnRenamed("entity_id", "id"), "id", "left")
    age = c.age_days(F.col("published_day"), AS_OF_DAY)
    fresh = c.freshness(F.col("format"), age, F.col("id") % 20 / 20.0, F.when(F.col("id") % 4 == 0, "editor").otherwise("ai"))
    return a.withColumns({"freshness": fresh, "semantic": F.when(F.col("id") % 3 != 0, (F.col("id") * 37 % 101) / 101.0), "covis": F.when(F.col("id") % 5 == 0, (F.col("id") % 7) / 7.0), "geo": c.geo_proximity(F.when(F.col("id") % 2 == 0, (F.col("id") % 50) * 100.0)), "promo": F.lit(None).cast("double")})


_SQL_FRESH = f"""fr AS (SELECT a.*, s.score, greatest({AS_OF_DAY} - published_day, 0)::DOUBLE AS age, (id % 4 = 0 OR (id % 20) / 20 >= 0.85) AS trusted FROM articles a LEFT JOIN scores s ON s.entity_id = a.id),
fx AS (SELECT *, CASE WHEN NOT trusted THEN 365 ELSE CASE format WHEN 'news' THEN 21 WHEN 'event' THEN 14 WHEN 'review' THEN 540 END END AS life FROM fr),
comp AS (SELECT *, CASE WHEN format IS NULL THEN NULL WHEN life IS NULL THEN 1 ELSE pow(0.5, age / life) END AS freshness, CASE WHEN id % 3 <> 0 THEN (id * 37 % 101) / 101 END AS semantic, CASE WHEN id % 5 = 0 THEN (id % 7) / 7 END AS covis, CASE WHEN id % 2 = 0 THEN exp(-(id % 50) * 100 / 3000) END AS geo FROM fx),
bl AS (SELECT *, coalesce(semantic * 0.35, 0) + coalesce(covis * 0.15, 0) + coalesce(freshness * 0.15, 0) + coalesce(score * 0.20, 0) + coalesce(geo * 0.10, 0) AS num,
  CASE WHEN semantic IS NULL THEN 0 ELSE 0.35 END + CASE WHEN covis IS NULL THEN 0 ELSE 0.15 END + CASE WHEN freshness IS NULL THEN 0 ELSE 0.15 END + CASE WHEN score IS NULL THEN 0 ELSE 0.20 END + CASE WHEN geo IS NULL THEN 0 ELSE 0.10 END AS den FROM comp)"""


def H16_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select("id", F.round("freshness", 6).alias("freshness"))


def H17_format_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = c.format_trusted(F.when(F.col("id") % 7 != 0, F.col("id") % 20 / 20.0), F.when(F.col("id") % 4 == 0, "editor"))
    return table(spark, sf_dir, "articles").groupBy(trusted.alias("trusted"), "format").agg(F.count("*").alias("n"))


def _blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {k: F.col(k) for k in ("semantic", "covis", "freshness", "geo", "promo")} | {"quality": F.col("score")}
    return _components(spark, sf_dir).withColumn("blend", c.blend(parts))


def I6_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir).select("id", F.round("blend", 6).alias("blend"))


def I7_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 by semantic score of each language, by blend, then at most two of a format: ten."""
    pool = r.ranked(_blended(spark, sf_dir).filter("semantic IS NOT NULL"), ["lang"], [F.desc("semantic"), F.col("id")], 40).drop("rank")
    order = [F.desc(F.round("blend", 9)), F.col("id")]
    return r.capped(pool.withColumn("format", F.coalesce("format", F.lit("(none)"))), ["lang"], "format", order, 2, 10).select("lang", "id", "rank")


def I8_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of places for one subject."""
    p = table(spark, sf_dir, "places")
    meters = c.haversine_m(F.lit(-6.2), F.lit(106.8), F.col("lat"), F.col("lng"))
    return p.select(
        "id",
        F.round(meters, 3).alias("geo_distance"),
        F.round(c.price_compat(F.lit("moderate"), F.col("price_band")), 6).alias("price_compat"),
        c.same_area(F.lit("area3"), F.col("area_term")).cast("int").alias("same_area"),
        F.when(F.col("type").isin("stay", "unknown"), 0.0).when(F.col("type").isin("eat", "drink", "do", "wellness"), 1.0).when(F.col("type").isNotNull(), 0.5).alias("type_compat"),
    )


def H18_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    meters = c.haversine_m(F.lit(-6.2), F.lit(106.8), F.col("lat"), F.col("lng"))
    return table(spark, sf_dir, "places").select("id", F.round(c.geo_proximity(meters), 9).alias("proximity"))


def H19_price_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "places").select("id", F.round(c.price_compat(F.col("price_band"), F.lit("luxury")), 6).alias("price"), c.same_area(F.col("area_term"), F.lit("area2")).alias("same"))


def H20_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("id", c.tokens(F.col("title")).alias("a"), c.tokens(F.col("text")).alias("b"))
    return docs.select("id", F.round(c.jaccard(F.col("a"), F.col("b")), 6).alias("null_if_empty"), F.round(c.jaccard(F.col("a"), F.col("b"), 1.0), 6).alias("one_if_empty"))


def H21_facet_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places")
    one = p.filter("id = 6").select(F.col("type").alias("t"), F.col("area_term").alias("a"), F.col("price_band").alias("b"))
    return p.crossJoin(F.broadcast(one)).select("id", F.round(c.facet_similarity([(F.col("type"), F.col("t")), (F.col("area_term"), F.col("a")), (F.col("price_band"), F.col("b"))]), 6).alias("similarity"))


def H22_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    one = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(c.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


def H23_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chars, media = F.col("n_chars"), F.col("doc_id") % 6
    parts = {"length": c.score_length(chars), "media": c.score_media(media, F.col("doc_id") % 2 == 0), "structure": c.score_structure(F.col("doc_id") % 4, F.col("doc_id") % 5), "author": F.when(F.col("doc_id") % 9 != 0, 1.0).otherwise(0.0), "yoast": c.score_share([F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0])}
    return d.select("doc_id", c.quality(chars, parts).alias("quality"))


def H24_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "mentions").groupBy("place_id").agg(F.count(F.when(F.col("role") == "featured", 1)).alias("f"), F.count_distinct("article_id").alias("a"), F.max("article_id").alias("newest"))
    return m.select("place_id", F.round(c.evidence_score(F.col("f"), F.col("a"), F.col("place_id") % 10 == 0, (1000 - F.col("newest")) / 200.0), 6).alias("score"))


def E5_log_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity of the 300 most mentioned on a log scale; nothing for the rest."""
    views = table(spark, sf_dir, "mentions").groupBy("place_id").agg(F.count("*").alias("views"))
    head = views.orderBy(F.desc("views"), "place_id").limit(300)
    span = head.agg(F.min("views").alias("low"), F.max("views").alias("high"))
    known = head.select(F.col("place_id").alias("__p"))
    prior = F.when(F.col("__p").isNull(), 0.0).when(F.col("high") > F.col("low"), (F.log(F.col("views") + 1.0) - F.log(F.col("low") + 1.0)) / (F.log(F.col("high") + 1.0) - F.log(F.col("low") + 1.0))).otherwise(1.0)
    return views.join(known, F.col("place_id") == F.col("__p"), "left").crossJoin(F.broadcast(span)).select("place_id", "views", F.round(prior, 4).alias("prior"))


def H25_cue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cues.score(_docs(spark, sf_dir), "title", "text", CUES)
    return found.select("id", F.col("cue.value").alias("value"), F.round("cue.margin", 6).alias("margin"), F.col("cue.confident").alias("confident"))


def H26_first_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(cues.first_person_density(F.col("text")), 6).alias("density"))


def D28_language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = cues.language_shares(F.col("text"), MARKERS)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(s, 6).alias(k) for k, s in shares.items()])


def H30_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("bucket", c.hash_bucket(F.col("doc_id"), 5))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def H15_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = c.embedding_text(F.col("title"), F.when(F.col("id") % 2 == 0, F.col("source")).otherwise(""), F.col("text"))
    return _docs(spark, sf_dir).select("id", F.sha2(built, 256).alias("text_hash"), F.length(built).alias("chars"))


def H1_normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", c.normalize_name(F.col("title")).alias("name"))


def H2_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _docs(spark, sf_dir).select("id", c.slugify(t).alias("slug"), c.candidate_key(t).alias("key"))


def H3_normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("title", F.lit(" 2"), (F.col("id") % 30 + 10).cast("string"), F.lit("9 &amp; 3rd "), F.when(F.col("id") % 2 == 0, "[Updated]").otherwise("2024"))
    return _docs(spark, sf_dir).select("id", c.normalize_title(title).alias("title"), F.array_join(F.transform(c.years(title), lambda y: y.cast("string")), ",").alias("years"))


def H4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("id", F.array_join(c.tokens(F.col("text")), " ").alias("tokens"))


def H5_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(c.visible_text(F.col("html")), 256).alias("text_sha"), F.length(c.visible_text(F.col("html"))).alias("chars"))


def H11_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(c.links(F.col("html"))).alias("pos", "href"))


def H12_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = c.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), c.root_domain(host).alias("root"), c.subdomain(host).alias("sub"))


def H13_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", c.canonical_url(F.col("url")).alias("url"))


def H33_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    back = c.parse_vector(c.vector_literal(F.col("embedding").cast("array<double>")))
    return v.select("vec_id", F.size(back).alias("dim"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def H10_word_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a text has more often than its first half has, by document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"), F.lower(F.expr("substring(text, 1, cast(n_chars / 2 as int))")).alias("half"))
    return content.word_delta(docs, "text", "half")


def I15_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return r.centroid_predict(v.select("vec_id", "embedding"), r.mean_vectors(v, ["label"]), "vec_id", "label")


_SQL_MEANS = "mv AS (SELECT label, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {where}) GROUP BY 1, 2) GROUP BY 1)"


def D24_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = r.mean_vectors(_vectors(spark, sf_dir), ["label"])
    return means.select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def I16_loo_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth row's class by its five nearest others."""
    near = _knn(spark, sf_dir, 5).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("predicted"), F.max("n").alias("votes"))


def I18_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of each class to its own centroid."""
    v = _vectors(spark, sf_dir)
    means = r.mean_vectors(v, ["label"])
    met = v.join(means, "label")
    return met.groupBy("label").agg(F.round(F.avg(c.cosine(F.col("embedding"), F.col("vector"))), 6).alias("cohesion"), F.count("*").alias("n"))


def I19_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = latent.tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"), F.round(F.sum("weight"), 5).alias("total"))


def I19_reduced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the leading directions keep, and how near it is to all documents' mean: neither hangs on the directions' signs or order."""
    v = latent.reduced_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", components=32)
    v = resolution.durable(v)
    mean = r.mean_vectors(v.withColumnRenamed("vector", "embedding").withColumn("one", F.lit(1)), ["one"]).select(F.col("vector").alias("mean"))
    return v.crossJoin(F.broadcast(mean)).select("doc_id", F.round("kept", 5).alias("kept"), F.round(c.cosine(F.col("vector"), F.col("mean")), 5).alias("centrality"))


def I20_lexicon_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(1, "ther"), (2, "tion"), (3, "erth"), (4, "eaux"), (5, "keit")], "term_id long, word string")
    docs = _docs(spark, sf_dir).withColumns({"lead": F.substring("text", 1, 400), "body": F.substring("text", 401, 1200)})
    return r.tag(docs, words, {"A": "title", "B": "lead", "C": "body"})


def I25_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's order, co-visits and closeness to the session: (1 - place / n) + covis / 2 + 0.3 cosine."""
    v = _vectors(spark, sf_dir)
    pool = _knn(spark, sf_dir, 20)
    centre = r.mean_vectors(v.filter("vec_id BETWEEN 10 AND 14").withColumn("one", F.lit(1)), ["one"]).select("vector")
    met = pool.join(v.select("vec_id", "embedding"), "vec_id").crossJoin(F.broadcast(centre))
    score = 1 - (F.col("rank") - 1) / 20 + 0.5 * (F.col("vec_id") % 4) / 4 + 0.3 * c.cosine(F.col("embedding"), F.col("vector"))
    return met.select("query_id", "vec_id", F.round(score, 6).alias("score"))


def P2_taste_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's revealed taste, mixed with a stated one by how much is known."""
    taste = b.taste_inputs(bp._kinds(interactions(spark, sf_dir)), bp.AS_OF)
    v = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("entity_id"), "embedding")
    revealed = r.mean_vectors(taste.join(v, "entity_id"), ["user_id"], weight="weight")
    stated = r.mean_vectors(_vectors(spark, sf_dir).filter("label = 3").withColumn("one", F.lit(1)), ["one"]).select(F.col("vector").alias("stated"))
    n = taste.join(v, "entity_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))
    mixed = revealed.join(n, "user_id").crossJoin(F.broadcast(stated)).withColumn("t", c.mix(F.col("vector"), F.col("stated"), F.col("n") / (F.col("n") + 20)))
    return mixed.select("user_id", "n", F.round(F.col("t")[0], 6).alias("x0"), F.round(F.aggregate("t", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


QUERIES = {
    x.__name__: x
    for x in (I1_lexical, I2_exact_knn, I4_rank_fusion, I5_hybrid_search, F3_mmr, H16_freshness, H17_format_trust, I6_blend, I7_rerank, I8_features, H18_proximity, H19_price_area, H20_jaccard, H21_facet_similarity, H22_cosine, H23_quality, H24_evidence_score, E5_log_prior, H25_cue_scores, H26_first_person, D28_language_share, H30_hash_bucket, H15_embedding_text, H1_normalize_name, H2_slugify, H3_normalize_title, H4_tokens, H5_visible_text, H11_links, H12_hosts, H13_canonical_url, H33_vector_text, H10_word_delta, I15_centroids, D24_mean_vectors, I16_loo_knn, I18_cohesion, I19_tf_idf, I19_reduced_vectors, I20_lexicon_tags, I25_rescore, P2_taste_blend)
}

_FOLD = "translate({0}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')"
_STOP = "('the', 'a', 'an', 'in', 'at', 'of', 'to', 'for', 'and', 'on', 'with', 'is', 'are', 'your', 'this', 'that')"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({_FOLD.format(x)}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN {_STOP})"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({_FOLD.format(x)}), '[’‘''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _visible(x: str) -> str:
    for pattern, to in (("(?is)<(script|style|svg)[^>]*>.*?</(script|style|svg)>", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^>]*>", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    for e, s in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{e}', '{s}')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


_D = "d AS (SELECT doc_id AS id, split_part(text, '.', 1) AS title, text, lang, source, n_chars FROM documents)"
def _all_words(x: str) -> str:
    return f"regexp_extract_all(lower({_FOLD.format(x)}), '[a-z0-9]+')"


def _asked_sql() -> str:
    """What the searches ask as rows: query, alternative, atom, whether ruled out, stem, offset, words of the atom, number among what is wanted, how many are."""
    rows = []
    for q, text in SEARCHES:
        found, k = parse(text), {}
        need = {a: sum(1 for x in found if x[0] == a and not x[2]) for a in {x[0] for x in found}}
        for alt, atom, negated, stem, offset, words in found:
            k[alt] = k.get(alt, 0) + (not negated)
            rows.append(f"({q}::BIGINT, {alt}, {atom}, {negated}, '{stem}', {offset}, {words}, {k[alt]}, {need[alt]})")
    return ", ".join(rows)


_MOST = max(sum(1 for x in parse(t) if x[0] == a and not x[2]) for _, t in SEARCHES for a in {x[0] for x in parse(t)})
_LAST = [f"l{i}" for i in range(1, _MOST + 1)]
_LEX = f"""wl AS (SELECT id, {_all_words("title")} AS a, {_all_words("text")} AS c FROM d), oc AS (SELECT id, generate_subscripts(a, 1) AS pos, unnest(a) AS t, 1.0::DOUBLE AS w FROM wl UNION ALL SELECT id, len(a) + generate_subscripts(c, 1), unnest(c), 0.2::DOUBLE FROM wl),
{stem_ctes("oc")},
asked(query_id, alt, atom, negated, stem, off, words, k, need) AS (VALUES {_asked_sql()}),
met AS (SELECT query_id, alt, atom, negated, words, k, need, id, pos, w, count(*) OVER (PARTITION BY query_id, atom, id, pos - off) AS here FROM oc JOIN st ON oc.t = st.word JOIN asked USING (stem)),
hw AS (SELECT *, {", ".join(f"max(pos) FILTER (k = {i}) OVER win AS l{i}" for i in range(1, _MOST + 1))}, count(*) OVER win AS n, sum(1 / w) OVER win AS inv FROM met m WHERE here = words AND NOT negated
  AND NOT EXISTS (SELECT 1 FROM met x WHERE x.negated AND x.here = x.words AND x.query_id = m.query_id AND x.alt = m.alt AND x.id = m.id) WINDOW win AS (PARTITION BY query_id, alt, id ORDER BY pos)),
bg AS (SELECT *, CASE WHEN len(list_filter([{", ".join(_LAST)}], lambda x: x IS NOT NULL)) = need THEN least({", ".join(_LAST)}) END AS p FROM hw), en AS (SELECT query_id, alt, id, p, min(pos) AS q, arg_min(n, pos) AS n1, arg_min(inv, pos) AS i1 FROM bg WHERE p IS NOT NULL GROUP BY 1, 2, 3, 4),
be AS (SELECT query_id, alt, id, pos, min(n) - count(*) AS n0, min(inv) - sum(1 / w) AS i0 FROM hw GROUP BY 1, 2, 3, 4),
lex AS (SELECT en.query_id, en.id, round(sum((n1 - n0) / (i1 - i0) / (1 + greatest(0, q - en.p - (n1 - n0 - 1)))), 6) AS score FROM en JOIN be b ON b.query_id = en.query_id AND b.alt = en.alt AND b.id = en.id AND b.pos = en.p GROUP BY 1, 2)"""


def _cue_sql() -> str:
    zones = {"title": "lower(title)", "lead": "lower(substring(text, 1, 400))", "body": "lower(substring(text, 401, 1200))"}
    hits = lambda k, z: "(" + " + ".join(f"least(len(regexp_extract_all({zones[z]}, '{p}')), 3) * {w}" for p, w in CUES[k]) + f") * {cues.ZONE_WEIGHTS[z]}"
    raw = ", ".join(f"({hits(k, z)})::DOUBLE AS {k}_{z}" for k in CUES for z in zones)
    heads = ", ".join(f"{k}_title + least({k}_lead, 2 * {k}_title + 1.5) AS {k}_head" for k in CUES)
    total = ", ".join(f"CASE WHEN {k}_title <= 0 THEN least({k}_lead + {k}_body, 2.0) ELSE {k}_head + least({k}_body, 1.5 * {k}_head + 1.5) END AS {k}_s" for k in CUES)
    listed = "list_sort([" + ", ".join(f"{{'s': -{k}_s, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(CUES)) + "])"
    return f"WITH {_D}, a AS (SELECT id, {raw} FROM d), b AS (SELECT *, {heads} FROM a), e AS (SELECT id, {total} FROM b), l AS (SELECT id, {listed} AS l FROM e), m AS (SELECT id, l[1].k AS k, -l[1].s AS top, l[2].s - l[1].s AS margin FROM l) SELECT id, CASE WHEN top >= 2.5 AND margin >= 1 THEN k END AS value, round(margin, 6) AS margin, top >= 2.5 AND margin >= 2 AS confident FROM m"


_LENGTH = "CASE WHEN n_chars < 500 THEN round(n_chars / 500 * 0.3, 4) ELSE round(least(1.0, greatest(0.3, (ln(n_chars) - ln(500)) / (ln(6000) - ln(500)))), 4) END"
ORACLE = {
    "I1_lexical": f"WITH {_D}, {_LEX} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 20",
    "I2_exact_knn": f"WITH {_SQL_KNN} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM knn QUALIFY rank <= 10",
    "I4_rank_fusion": """WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 80), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY sha256(concat('q:', doc_id))) AS r FROM documents WHERE doc_id % 3 = 0 QUALIFY r <= 80),
f AS (SELECT id, round(sum(1 / (60 + r)), 9) AS score, count(*) AS rails FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) SELECT id, score, rails, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank FROM f QUALIFY rank <= 60""",
    "I5_hybrid_search": f"""WITH {_D}, {_LEX}, lr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 60),
sem AS (SELECT q.vec_id AS query_id, d.id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS s FROM d JOIN embeddings v ON v.vec_id = d.id % 500, embeddings q WHERE q.vec_id BETWEEN 1 AND 4),
sr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sem QUALIFY rank <= 60),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM lr UNION ALL SELECT * FROM sr) GROUP BY 1, 2) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM f QUALIFY rank <= 20""",
    "H16_freshness": f"WITH {ctes('articles', 'scores')}, {_SQL_FRESH} SELECT id, round(freshness, 6)::DOUBLE AS freshness FROM comp",
    "H17_format_trust": f"WITH {ctes('articles')} SELECT id % 4 = 0 OR coalesce(CASE WHEN id % 7 <> 0 THEN (id % 20) / 20 END >= 0.85, false) AS trusted, format, count(*) AS n FROM articles GROUP BY 1, 2",
    "I6_blend": f"WITH {ctes('articles', 'scores')}, {_SQL_FRESH} SELECT id, round(CASE WHEN den > 0 THEN num / den ELSE 0 END, 6)::DOUBLE AS blend FROM bl",
    "I7_rerank": f"""WITH {ctes("articles", "scores")}, {_SQL_FRESH}, p AS (SELECT id, lang, coalesce(format, '(none)') AS format, round(num / den, 9) AS blend FROM bl WHERE semantic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY semantic DESC, id) <= 40),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lang, format ORDER BY blend DESC, id) <= 2) SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY blend DESC, id) AS rank FROM q QUALIFY rank <= 10""",
    "I8_features": f"""WITH {ctes("places")} SELECT id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - -6.2) / 2), 2) + cos(radians(-6.2)) * cos(radians(lat)) * pow(sin(radians(lng - 106.8) / 2), 2)))), 3) AS geo_distance,
round(1 - abs(CASE price_band WHEN 'budget' THEN 0 WHEN 'moderate' THEN 1 WHEN 'upscale' THEN 2 WHEN 'luxury' THEN 3 END - 1) / 3, 6) AS price_compat, (area_term = 'area3')::INT AS same_area,
CASE WHEN type IN ('stay', 'unknown') THEN 0.0 WHEN type IN ('eat', 'drink', 'do', 'wellness') THEN 1.0 WHEN type IS NOT NULL THEN 0.5 END::DOUBLE AS type_compat FROM places""",
    "H18_proximity": f"WITH {ctes('places')} SELECT id, round(exp(-2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - -6.2) / 2), 2) + cos(radians(-6.2)) * cos(radians(lat)) * pow(sin(radians(lng - 106.8) / 2), 2)))) / 3000), 9) AS proximity FROM places",
    "H19_price_area": f"WITH {ctes('places')} SELECT id, round(1 - abs(CASE price_band WHEN 'budget' THEN 0 WHEN 'moderate' THEN 1 WHEN 'upscale' THEN 2 WHEN 'luxury' THEN 3 END - 3) / 3, 6) AS price, area_term = 'area2' AS same FROM places",
    "H20_jaccard": f"""WITH {_D}, t AS (SELECT id, list_distinct({_tok("title")}) AS a, list_distinct({_tok("text")}) AS b FROM d), j AS (SELECT *, len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) AS s FROM t)
SELECT id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(s, 6) END AS null_if_empty, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE round(coalesce(s, 0), 6) END::DOUBLE AS one_if_empty FROM j""",
    "H21_facet_similarity": f"""WITH {ctes("places")}, o AS (SELECT type AS t, area_term AS a, price_band AS b FROM places WHERE id = 6), x AS (SELECT id, coalesce((type = t)::INT, 0) + coalesce((area_term = a)::INT, 0) + coalesce((price_band = b)::INT, 0) AS e,
(type IS NOT NULL AND t IS NOT NULL)::INT + (area_term IS NOT NULL AND a IS NOT NULL)::INT + (price_band IS NOT NULL AND b IS NOT NULL)::INT AS k FROM places, o) SELECT id, CASE WHEN k > 0 THEN round(e / k, 6) ELSE 0 END::DOUBLE AS similarity FROM x""",
    "H22_cosine": "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id = 0",
    "H23_quality": f"""WITH p AS (SELECT doc_id, n_chars, {_LENGTH} AS l, round(least(1.0, (doc_id % 6 + (doc_id % 2 = 0)::INT) / 4), 4) AS m, round(0.5 * least(1.0, (doc_id % 4) / 3) + 0.5 * least(1.0, (doc_id % 5) / 3), 4) AS s, (doc_id % 9 <> 0)::INT AS a, round(((doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT) / 3, 4) AS y FROM documents),
r AS (SELECT *, round((0.30 * l + 0.20 * m + 0.20 * s + 0.10 * a + 0.20 * y)::DOUBLE, 9) AS raw FROM p) SELECT doc_id, round(greatest(0.0, least(1.0, CASE WHEN n_chars < 500 THEN least(raw, 0.15) ELSE raw END)) + 1e-9, 4)::DOUBLE AS quality FROM r""",
    "H24_evidence_score": f"""WITH {ctes("mentions")}, m AS (SELECT place_id, count(*) FILTER (role = 'featured') AS f, count(DISTINCT article_id) AS a, max(article_id) AS newest FROM mentions GROUP BY 1) SELECT place_id, round(3 * f + a + 2 * (place_id % 10 = 0)::INT + greatest(0.0, 1 - (1000 - newest) / 200 / 5), 6)::DOUBLE AS score FROM m""",
    "E5_log_prior": f"""WITH {ctes("mentions")}, v AS (SELECT place_id, count(*) AS views FROM mentions GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY views DESC, place_id) <= 300 AS head FROM v), s AS (SELECT min(views) AS low, max(views) AS high FROM k WHERE head)
SELECT place_id, views, round(CASE WHEN NOT head THEN 0 WHEN high > low THEN (ln(views + 1) - ln(low + 1)) / (ln(high + 1) - ln(low + 1)) ELSE 1 END, 4)::DOUBLE AS prior FROM k, s""",
    "H25_cue_scores": _cue_sql(),
    "H26_first_person": """WITH t AS (SELECT doc_id, lower(text) AS s FROM documents), w AS (SELECT doc_id, regexp_extract_all(s, '[a-z]+') AS w FROM t) SELECT doc_id, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x IN ('i', 'we', 'my', 'our'))) * 1000 / len(w), 6) ELSE 0 END::DOUBLE AS density FROM w""",
    "D28_language_share": "WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, " + ", ".join(f"round(len(list_filter(w, lambda x: x IN {m})) / nullif(len(w), 0), 6) AS {k}" for k, m in MARKERS.items()) + " FROM w",
    "H30_hash_bucket": "SELECT ('0x' || sha256(doc_id::VARCHAR)[1:8])::BIGINT % 5 AS bucket, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "H15_embedding_text": f"""WITH {_D}, b AS (SELECT id, array_to_string(list_filter([nullif(trim(title), ''), CASE WHEN id % 2 = 0 THEN nullif(trim(source), '') END, nullif(trim(substring(text, 1, 1600)), '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS t FROM d) SELECT id, sha256(t) AS text_hash, length(t)::INT AS chars FROM b""",
    "H1_normalize_name": f"WITH {_D} SELECT id, {_norm('title')} AS name FROM d",
    "H2_slugify": f"WITH {_D} SELECT id, replace({_norm('title')}, ' ', '-') AS slug, sha1({_norm('title')})[1:16] AS key FROM d",
    "H4_tokens": f"WITH {_D} SELECT id, array_to_string({_tok('text')}, ' ') AS tokens FROM d",
    "H5_visible_text": f"WITH t AS (SELECT page_id, {_visible('html')} AS t FROM pages) SELECT page_id, sha256(t) AS text_sha, length(t)::INT AS chars FROM t",
    "H11_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, i::INT - 1 AS pos, l[i] AS href FROM l, unnest(range(1, len(l) + 1)) t(i)""",
    "H12_hosts": """WITH h AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '') AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS l FROM h),
r AS (SELECT page_id, host, l, CASE WHEN array_to_string(l[-2:], '.') IN ('co.id', 'or.id', 'go.id', 'web.id', 'ac.id', 'co.uk', 'org.uk', 'com.au', 'com.sg', 'co.jp') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS root FROM p)
SELECT page_id, host, root, CASE WHEN host <> root THEN host[1:length(host) - length(root) - 1] END AS sub FROM r""",
    "H13_canonical_url": """SELECT page_id, regexp_replace(nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '') || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS url FROM pages""",
    "H33_vector_text": "SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "H10_word_delta": """WITH e AS (SELECT doc_id AS id, text, n_chars FROM documents), a AS (SELECT id, w, count(*) AS a FROM (SELECT id, unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS w FROM e) WHERE w <> '' GROUP BY 1, 2),
b AS (SELECT id, w, count(*) AS b FROM (SELECT id, unnest(string_split_regex(lower(substring(text, 1, (n_chars // 2)::INT)), '[ \\t\\r\\n]+')) AS w FROM e) WHERE w <> '' GROUP BY 1, 2)
SELECT id, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS lost, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS gained FROM a FULL JOIN b USING (id, w) GROUP BY 1""",
    "I15_centroids": f"""WITH {_SQL_MEANS.format(where="true")}, s AS (SELECT vec_id, m.label, round(list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS s FROM embeddings e, mv m), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS r FROM s)
SELECT a.vec_id, a.label, a.s AS similarity, round(a.s - b.s, 6) AS margin FROM k a LEFT JOIN k b ON b.vec_id = a.vec_id AND b.r = 2 WHERE a.r = 1""",
    "D24_mean_vectors": f"WITH {_SQL_MEANS.format(where='true')} SELECT label, (i - 1)::INT AS pos, round(vector[i], 6) AS x FROM mv, unnest(range(1, 65)) t(i)",
    "I16_loo_knn": f"""WITH {_SQL_KNN}, n AS (SELECT k.query_id, e.label FROM (SELECT * FROM knn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5) k JOIN embeddings e USING (vec_id)), v AS (SELECT query_id, label, count(*) AS n FROM n GROUP BY 1, 2)
SELECT query_id, label AS predicted, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""",
    "I18_cohesion": f"WITH {_SQL_MEANS.format(where='true')} SELECT label, round(avg(list_cosine_similarity(embedding::DOUBLE[], vector)), 6) AS cohesion, count(*) AS n FROM embeddings JOIN mv USING (label) GROUP BY 1",
    "I19_tf_idf": f"""WITH d AS (SELECT doc_id, text AS t FROM documents), w AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({_tok("t")}) AS w FROM d) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM d),
df AS (SELECT w, count(*) AS df, any_value(n) AS n FROM w, n GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= any_value(n) * 0.5), x AS (SELECT doc_id, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM w JOIN df USING (w)),
u AS (SELECT doc_id, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS u FROM x) SELECT doc_id, count(*) AS terms, round(max(u), 6) AS top, round(sum(u), 5) AS total FROM u GROUP BY 1""",
    "I20_lexicon_tags": f"""WITH {_D}, l(term_id, w) AS (VALUES (1::BIGINT, 'ther'), (2, 'tion'), (3, 'erth'), (4, 'eaux'), (5, 'keit')), z AS (SELECT id, 'A' AS zone, {_tok("title")} AS t FROM d UNION ALL SELECT id, 'B', {_tok("substring(text, 1, 400)")} FROM d UNION ALL SELECT id, 'C', {_tok("substring(text, 401, 1200)")} FROM d) SELECT id, term_id, min(zone) AS zone FROM z, l WHERE list_contains(t, w) GROUP BY 1, 2""",
    "I25_rescore": f"""WITH {_SQL_KNN}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM knn QUALIFY rank <= 20), c AS (SELECT list(m ORDER BY i) AS vector FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id BETWEEN 10 AND 14) GROUP BY 1))
SELECT query_id, k.vec_id, round(1 - (rank - 1) / 20 + 0.5 * (k.vec_id % 4) / 4 + 0.3 * list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS score FROM k JOIN embeddings e ON e.vec_id = k.vec_id, c""",
    "P2_taste_blend": f"""WITH {ctes("interactions")}, {bp._SQL_TASTE}, t AS (SELECT user_id, weight, embedding FROM taste JOIN embeddings ON vec_id::VARCHAR = entity_id), n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT user_id, weight, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM t), rv AS (SELECT user_id, i, sum(weight * x) / sum(weight) AS r FROM p GROUP BY 1, 2),
sv AS (SELECT i, avg(x) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 3) GROUP BY 1), m AS (SELECT user_id, n, i, n / (n + 20) * r + (1 - n / (n + 20)) * s AS v FROM rv JOIN sv USING (i) JOIN n USING (user_id))
SELECT user_id, n, round(max(v) FILTER (i = 1), 6) AS x0, round(sum(v), 6) AS total FROM m GROUP BY 1, 2""",
}
