"""Queries of aggregates, measures, resolution, integrity and itineraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import behaviour as b
from ..operators import evaluation as e
from ..operators import integrity as g
from ..operators import itinerary as it
from ..operators import joins as j
from ..operators import junk
from ..operators import resolution as res
from ..operators import retrieval as r
from . import behaviour as bp
from .fixtures import ctes, interactions, table
from .ranking import ORACLE as _RANKING
from .ranking import _tok, _vectors


def D8_review_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "entity_terms")
    top = r.ranked(t, ["term_id"], [F.col("confidence").asc_nulls_first(), F.col("entity_id")], 3).groupBy("term_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))), lambda x: x["entity_id"].cast("string")), ",").alias("first"))
    sums = t.groupBy("term_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count_distinct("source").alias("sources"))
    return sums.join(top, "term_id")


def D9_weakest_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "entity_terms")
    return t.groupBy("entity_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("confidence") < 0.5, 1)).alias("weak"), F.min_by("term_id", F.struct(F.coalesce("confidence", F.lit(-1.0)), F.col("term_id"))).alias("weakest"))


_FACETS = {"lang": "en", "source": "src1", "format": "news"}


def D10_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each facet under the other facets' filters: one pass, a row given to every facet whose own filter alone it may break."""
    a = table(spark, sf_dir, "articles")
    keeps = {k: F.coalesce(F.col(k) == v, F.lit(False)) for k, v in _FACETS.items()}
    parts = []
    for k in _FACETS:
        others = F.lit(True)
        for x, ok in keeps.items():
            if x != k:
                others = others & ok
        parts.append(F.when(others, F.struct(F.lit(k).alias("facet"), F.coalesce(F.col(k), F.lit("null")).alias("value"))))
    return a.select(F.explode(F.array_compact(F.array(*parts))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def D11_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").withColumn("format", F.coalesce("format", F.lit("Unformatted")))
    return a.rollup("lang", "format").agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).filter("gid < 3").select("lang", F.when(F.col("gid") == 1, "All").otherwise(F.col("format")).alias("format"), "n")


def D12_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.agg(F.count("*").alias("articles"), F.count(F.when(F.col("status") == "draft", 1)).alias("drafts"), F.count(F.when(F.col("primary_type").isNull(), 1)).alias("untyped"), F.count_distinct("series_key").alias("series"))


def D13_org_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places").filter("org_id IS NOT NULL")
    each = p.groupBy("org_id").agg(F.count("*").alias("places"), F.count(F.when(F.col("status") == "active", 1)).alias("active"))
    return each.crossJoin(F.broadcast(each.agg(F.count("*").alias("total"))))


def D14_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = table(spark, sf_dir, "places"), table(spark, sf_dir, "mentions")
    return p.join(m.drop("id"), p["id"] == m["place_id"], "left").groupBy("org_id").agg(F.count("place_id").alias("mentions"), F.count_distinct("place_id").alias("places"), F.count_distinct("article_id").alias("articles"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("article_id"), (F.col("page_id") % 90).alias("day"), F.col("url").alias("base"), F.explode(c.links(F.col("html"))).alias("href"))
    return links.withColumns({"netloc": F.coalesce(c.host(F.col("href")), c.host(F.col("base"))), "rel": F.when(F.col("article_id") % 3 == 0, "nofollow").when(F.col("article_id") % 3 == 1, "sponsored nofollow")})


def D15_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.links_by_domain(_links(spark, sf_dir)).select("netloc", "links", "articles", "first_day", "last_day", "sponsored", "nofollow", "plain", F.array_join(F.slice("samples", 1, 2), " ").alias("samples"))


def D16_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for each place: featured and other mentions, articles, the share that is featured."""
    m = table(spark, sf_dir, "mentions")
    own = m.groupBy("place_id").agg(F.count_if(F.col("role") == "featured").alias("featured"), F.count("*").alias("mentions"), F.count_distinct("article_id").alias("articles"))
    return table(spark, sf_dir, "places").select(F.col("id").alias("place_id")).join(own, "place_id", "left").na.fill(0).withColumn("share", F.round(F.col("featured") / F.nullif("mentions", F.lit(0)), 6))


def E1_best_of_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five surest members of each term, ties by id."""
    return r.ranked(table(spark, sf_dir, "entity_terms").select("term_id", "entity_id", "confidence"), ["term_id"], [F.desc("confidence"), F.col("entity_id")], 5)


def H32_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of texts, greatest and first known values, hours, and local days in another zone, counted."""
    e = table(spark, sf_dir, "events")
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Jakarta"), "ts")
    return e.groupBy(
        F.date_format(local, "yyyy-MM-dd").alias("local_day"),
        F.split_part(F.col("event_type"), F.lit("a"), F.lit(1)).alias("part"),
        F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month"),
    ).agg(F.count("*").alias("n"), F.round(F.sum(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(10.0))), 4).alias("at_least"))


def D17_duplicate_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = table(spark, sf_dir, "places").filter("lat IS NOT NULL").select(F.round("lat", 1).alias("lat"), F.round("lng", 1).alias("lng"), F.col("id").alias("key"), (F.col("id") % 2 == 0).alias("seeded"))
    return res.duplicate_centroids(pts, 5).select("lat", "lng", F.size("keys").alias("n"), F.col("keys")[0].alias("first"))


def D18_series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select("doc_id", c.normalize_name(F.substring_index("text", ".", 1)).alias("key"))
    return titles.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n >= 2").select("first", "n", F.sha2("key", 256).alias("key_sha"))


def D20_pick_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles").filter("series_key IS NOT NULL")
    return a.groupBy("series_key").agg(F.max_by("id", F.struct(F.coalesce("published_day", F.lit(-1)), F.col("id"))).alias("current"), F.count("*").alias("members"))


def D21_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", 0.95, ["lang"])


def D22_population_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "articles").groupBy("primary_type", "format").agg(F.count("*").alias("n"))
    totals = cells.groupBy(F.col("primary_type").alias("__t")).agg(F.sum("n").alias("total"))
    return cells.join(totals, F.col("primary_type").eqNullSafe(F.col("__t"))).select("primary_type", "format", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def D25_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, s = table(spark, sf_dir, "articles"), table(spark, sf_dir, "scores")
    both = a.join(s, a["id"] == s["entity_id"], "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("entity_id").alias("scored"), F.count(F.when(F.col("score") < 0.35, 1)).alias("low"))


def D27_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ("tion", "ther", "erth", "quelle", "keit", "eaux")], "word string")
    each = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(c.tokens(F.col("text"))).alias("word"))
    return each.join(words, "word").groupBy("word").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"))


def D31_facet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, tags = table(spark, sf_dir, "terms"), table(spark, sf_dir, "entity_terms")
    facets = terms.select("facet").unionAll(spark.createDataFrame([("occasion",)], "facet string")).distinct()
    sums = tags.join(terms.select(F.col("id").alias("term_id"), "facet"), "term_id").groupBy("facet").agg(F.count("*").alias("assignments"), F.count_distinct("entity_id").alias("articles"))
    return facets.join(sums, "facet", "left").na.fill(0)


def D32_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, tags = table(spark, sf_dir, "terms"), table(spark, sf_dir, "entity_terms")
    return tags.join(terms.select(F.col("id").alias("term_id"), "slug"), "term_id").groupBy("slug").agg(F.count_distinct("entity_id").alias("n"))


def D33_normalised_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " ").alias("key"), F.col("p_retailprice").cast("double").alias("price"))
    return p.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"))


def D34_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    sums = o.groupBy("o_custkey").agg(F.count("*").alias("placements"))
    return cust.join(sums, cust["c_custkey"] == sums["o_custkey"], "left").select(F.col("c_custkey").alias("id"), F.coalesce("placements", F.lit(0)).alias("placements"))


def D35_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entity_terms").groupBy(F.round("confidence", 1).alias("value"), "source").agg(F.count("*").alias("n"))


def D37_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources' terms for a normalised key: same, partial, conflict."""
    a = table(spark, sf_dir, "articles").filter("series_key IS NOT NULL")
    side = lambda lang, n: a.filter(F.col("lang") == lang).groupBy("series_key").agg(F.array_sort(F.collect_set("format")).alias(n))
    both = side("en", "x").join(side("fr", "y"), "series_key")
    kind = F.when(F.col("x") == F.col("y"), "same").when(F.arrays_overlap("x", "y"), "partial").otherwise("conflict")
    return both.select("series_key", kind.alias("kind"))


def K1_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, grades = _ranked(spark, sf_dir)
    return e.ndcg(ranked, grades, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries are sources; their documents by length, graded where labels know them."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = r.ranked(d, ["query_id"], [F.desc("n_chars"), F.col("id")])
    grades = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).cast("double").alias("grade")).join(d.select("query_id", "id"), "id")
    return ranked, grades.select("query_id", "id", "grade")


_SQL_RANKED = """rk AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), gr AS (SELECT source AS query_id, doc_id AS id, (quality + toxic)::DOUBLE AS grade FROM labels JOIN documents USING (doc_id))"""


def K2_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, grades = _ranked(spark, sf_dir)
    found = e.precision(ranked, grades.filter("grade > 0"), 10)
    return found.select("query_id", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "average_precision")])


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found = r.centroid_predict(v.select("vec_id", "embedding"), r.mean_vectors(v, ["label"]), "vec_id", "label")
    return v.select("vec_id", F.col("label").alias("actual")).join(found.select("vec_id", F.col("label").alias("predicted"), "similarity", "margin"), "vec_id")


def K3_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("guess", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1))
    return e.confusion(labels, "quality", "guess")


def K3_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("guess", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1))
    return e.accuracy(labels, "quality", "guess").withColumn("accuracy", F.round("accuracy", 6))


def K4_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    p, low, high = c.wilson(F.col("k"), F.col("n"))
    return sums.select("lang", "n", F.round(p, 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def K5_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    agree, checked = F.col("quality") == 1, F.col("doc_id") % 3 == 0
    cells = t.groupBy(F.col("lang").alias("cell")).agg(F.count("*").alias("n_sampled"), F.count(F.when(agree, 1)).alias("n_agree"), F.count(F.when(agree & checked, 1)).alias("n_agree_checked"), F.count(F.when(agree & checked & (F.col("toxic") == 0), 1)).alias("n_agree_correct"), F.count(F.when(~agree & (F.col("doc_id") % 2 == 0), 1)).alias("n_disagree_correct"))
    return e.two_stage_accuracy(cells).select("cell", *[F.round(x, 6).alias(x) for x in ("estimated_correct", "point", "low", "high")])


def K6_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 100) / 100).alias("confidence"), (F.col("quality") == 1).alias("correct"))
    found = e.coverage_curve(p, [0.0, 0.25, 0.5, 0.75, 0.9, 1.5])
    return found.select("threshold", "covered", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


def K7_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, grades = _ranked(spark, sf_dir)
    a = e.ndcg(ranked, grades, 10).withColumnRenamed("ndcg", "a")
    b2 = e.ndcg(ranked, grades, 30).withColumnRenamed("ndcg", "b")
    return e.paired_bootstrap(a.join(b2, "query_id"), 500)


def K9_z_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = interactions(spark, sf_dir).withColumn("arm", c.hash_bucket(F.col("user_id"), 2))
    s = log.groupBy("arm").agg(F.count(F.when(F.col("kind") == "view", 1)).alias("n"), F.count(F.when(F.col("kind") == "click", 1)).alias("k"))
    a, b2 = s.filter("arm = 0").select(F.col("n").alias("na"), F.col("k").alias("ka")), s.filter("arm = 1").select(F.col("n").alias("nb"), F.col("k").alias("kb"))
    z, p = c.two_proportions(F.least("ka", "na"), F.col("na"), F.least("kb", "nb"), F.col("nb"))
    return a.crossJoin(F.broadcast(b2)).select("na", "ka", "nb", "kb", F.round(z, 6).alias("z"), F.round(p, 6).alias("p"), c.sample_size(F.col("ka") / F.col("na") / 2).alias("needed"))


def K10_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bp._railed(interactions(spark, sf_dir)).filter("instr(rail, '~') > 0")
    base, variant = b.split_variant(F.col("rail"))
    arms = log.groupBy(base.alias("base"), variant.alias("variant")).agg(F.count("*").alias("impressions"), F.count(F.when(F.col("kind") == "click", 1)).alias("clicks"))
    found = e.compare_arms(arms)
    return found.select("base", "control", "variant", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"), "needed", "enough")


def K11_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")).select(F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("metric"), F.col("toxic").alias("value")))).alias("m")).select("m.*")
    baseline = spark.createDataFrame([("quality", 0.5, None), ("toxic", 0.9, 0.2), ("latency", 0.1, None)], "metric string, baseline double, minimum double")
    return e.gates(report, baseline, 0.05).select("metric", F.round("value", 6).alias("value"), F.round("floor", 6).alias("floor"), "passed")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of places: (id, name, n)."""
    return table(spark, sf_dir, "places").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def J1_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names, each under the least id that bears it."""
    return res.candidate_pairs(_names(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def J2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are surely one place, over links of at least AUTO; each cluster under its most frequent name."""
    return res.clusters(_names(spark, sf_dir))


def J3_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names and, of equal names, each place with the one of the least id."""
    places, names = table(spark, sf_dir, "places"), _names(spark, sf_dir)
    equal = places.select(F.col("id").alias("b"), "name").join(names.select(F.col("id").alias("a"), "name"), "name").filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    return res.merge_plan(res.candidate_pairs(names).unionByName(equal), places).groupBy("action", "reason").agg(F.count("*").alias("n"))


def J4_bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places").withColumn("key", F.substring("name", 7, 9))
    return res.first_known(p, "key", [F.col("id")], ["type", "area_term", "price_band"]).select("key", "type", "area_term", "price_band", F.array_join("conflicts", ",").alias("conflicts"))


def J5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.initcap("text").alias("text"))
    return res.extract_names(docs).groupBy("id").agg(F.count("*").alias("n"))


def J6_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth place's name, its first letter lost where the id is odd in hundreds, against all names."""
    gaz = _names(spark, sf_dir).select(F.col("id").alias("place_id"), "name")
    said = F.when(F.col("id") % 200 == 0, F.upper("name")).otherwise(F.concat(F.substring("name", 1, 6), F.expr("substring(name, 8)")))
    asked = table(spark, sf_dir, "places").filter("id % 100 = 0").select(said.alias("mention")).distinct()
    return res.lookup(asked, gaz).select("mention", "place_id", F.round("similarity", 6).alias("similarity"))


#: Names by the rule that takes them, in the order of the rules; of each one fits a share of the places.
_JUNK = (
    ("...", "empty"), ("www.place.com", "url"), ("Nusa Dua", "area"), ("a b c d e f g h i j k l m n o", "run_on"), ("The Sunset Bar''s Terrace", "possessive"), ("Ubud Centre", "phrase"), ("Discover Ubud", "lead"), ("New Thai Kitchen", "new_kind"),
    ("The Best Warung", "the_best"), ("General Manager Ketut", "job"), ("Jalan Raya Ubud", "address"), ("World Travel Awards", "award"), ("Warung Guide 2016", "year"), ("Jazz Festival", "event"), ("Sunday Farmers Market", "weekday"), ("Barista Championship", "gathering"),
    ("Global Wellness Day", "day"), ("Three Days Retreat", "offer"), ("10pm Rooftop", "time"), ("Dahana Level 2", "level"), ("Jazz in December at Mulia", "month_at"), ("Wine Dinner at Mulia", "held_at"), ("Deluxe Ocean Room", "room"), ("Ubud Getaway", "caption"),
    ("The Taste of Java", "concept"), ("Conrad Hilton Ubud", "two_brands"), ("Central Park Tribeca Park", "same_noun"), ("Indulge and Imbibe at Mulia", "and_at"), ("Made & I", "cut_after_and"), ("Sunset Bar and Locavore", "two_venues"), ("Mozaic Gal", "cut_off"), ("Seafood Bar and Lounge", "generic"),
    ("This Is Ubud", "opener"), ("Made and Wayan", "joined"), ("Kayu at Mulia", "at"), ("Kingdom of Toys", "of"), ("Warung 99", "number"), ("Copa Restaurant La Floriane Lounge", "two_outlets"), ("Kayu Batu Made Wayan Nyoman Ketut Putu Gede", "long"),
)
_DOUBTFUL = ("opener", "joined", "at", "of", "number", "two_outlets", "long")
_JUNK_WORDS = junk.Words(brands=("conrad", "hilton"), areas=("nusa dua",), phrases=("ubud centre",))


def J8_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the places' names, of which 39 in 60 are written over by names that one rule each takes; every fourth has blanks around."""
    made = F.get(F.array(*[F.lit(x.replace("''", "'")) for x, _ in _JUNK]), (F.col("id") % 60).cast("int"))
    p = table(spark, sf_dir, "places").select("id", F.coalesce(F.when(F.col("id") % 4 == 0, F.concat(F.lit("  "), made, F.lit(" "))).otherwise(made), F.col("name")).alias("name"))
    return junk.verdict_counts(p, _JUNK_WORDS)


def J10_area_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [(1, "red", 1), (2, "blue green", 2), (3, "green", 1), (4, "hot", 2), (5, "misty rose", 3)]
    areas = spark.createDataFrame(words, "area_id long, name string, depth int")
    return res.match_areas(table(spark, sf_dir, "places").select("id", F.col("name").alias("text")), areas)


def J11_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places").select(F.col("id").alias("key"))
    at = lambda m, off: p.filter(F.col("key") % m == 0).select("key", (-6.0 + F.col("key") % 100 / 50 + off).alias("lat"), (106.0 + F.col("key") % 10).alias("lng"))
    found = res.geocode(p, [("override", at(50, 0.0)), ("existing", at(7, 0.1)), ("address", at(3, 11.6)), ("name", at(2, 0.3))])
    return found.select("key", "step", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def J12_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(c.host(F.col("url")).alias("netloc")).groupBy("netloc").agg(F.count("*").alias("links"))
    return res.organisations(hosts)


def O1_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    facts = a.filter("id % 8 <> 1").select("id", F.when(F.col("id") % 12 == 0, "other").otherwise(F.col("format")).alias("fact"))
    return g.drift(a, facts, "id", "format").select("id", "kind")


def O2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "mentions")
    found = g.orphans(m, table(spark, sf_dir, "places").filter("id % 40 <> 0"), "place_id", "id")
    return found.select("place_id", "n", F.col("samples")[0].alias("first"))


def O5_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places")
    live = g.effective(F.col("status"), F.when(F.col("id") % 3 == 0, F.col("id") % 200), F.when(F.col("id") % 4 == 0, F.col("id") % 300), F.lit(100))
    return p.filter(live).select("id")


def O6_link_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    tier = F.when(F.col("page_id") % 3 == 0, "paid").when(F.col("page_id") % 3 == 1, "listed").otherwise("free")
    return p.withColumn("l", g.decorate_link(F.col("url"), tier, "x")).select("page_id", F.col("l.href").alias("href"), F.col("l.rel").alias("rel"))


def B23_host_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = ("m.facebook.com", "bit.ly", "drive.google.com", "youtu.be", "images.unsplash.com", "x.onelink.me", "notbit.ly")
    host = F.coalesce(*[F.when(F.col("page_id") % 11 == i, h) for i, h in enumerate(some)], c.host(F.col("url")))
    return table(spark, sf_dir, "pages").groupBy(g.host_class(host, ("example.net",)).alias("kind")).agg(F.count("*").alias("n"))


def B24_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = j.evidence(table(spark, sf_dir, "places"), table(spark, sf_dir, "mentions").filter("place_id % 3 <> 0"))
    verdict = F.when(F.col("id") % 4 == 0, "junk").when(F.col("id") % 4 == 1, "suspect").otherwise("ok")
    act = g.triage(verdict, F.when(F.col("id") % 5 == 0, "outside").otherwise("inside"), F.col("mentions"), F.col("id") % 50 == 0)
    return p.groupBy(act.alias("action")).agg(F.count("*").alias("n"))


def B19_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places").withColumn("lat", F.when(F.col("id") % 11 == 0, 40.0).otherwise(F.col("lat")))
    return p.filter(g.in_country(F.col("lat"), F.col("lng"))).select("id")


def _slots(spark: SparkSession) -> DataFrame:
    rows = [(d, d % 7, s, t, o, cl) for d in range(2) for s, t, o, cl in (("morning", ["do", "wellness"], 540, 720), ("lunch", ["eat"], 720, 840), ("evening", ["drink", "eat"], 1140, 1380))]
    return spark.createDataFrame(rows, "day int, weekday int, slot string, types array<string>, opens int, closes int")


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places").filter("status = 'active' AND lat IS NOT NULL")
    hours = F.when(F.col("id") % 4 != 0, F.array(*[F.struct(F.lit(d).alias("weekday"), (F.col("id") % 6 * 60 + 480).cast("int").alias("opens"), (F.col("id") % 5 * 60 + 900).cast("int").alias("closes")) for d in range(7)]))
    return p.select(F.col("id").alias("place_id"), "type", ((F.col("id") * 31 % 97) / 97.0).alias("score"), "price_band", F.lit(60).alias("dwell"), hours.alias("hours"), "org_id", "lat", "lng", (F.col("id") % 3 != 0).alias("kids"))


def N1_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.eligible(_stops(spark, sf_dir), _slots(spark), ["kids"], "upscale", 5).select("day", "slot", "place_id", "rank")


def N2_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _slots(spark)
    return it.precheck(it.eligible(_stops(spark, sf_dir), slots, ["kids"], "upscale", 5), slots, 1)


def N3_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen trips over the same slots, with caps, budgets, partners and interests of their own; lunch is required."""
    found = it.eligible(_stops(spark, sf_dir), _slots(spark), [], "upscale")
    asked = spark.range(16).select(F.col("id").alias("request_id"), (1 + F.col("id") % 3).alias("max_per_org"), (1 + F.col("id") % 2).alias("max_per_type"), F.when(F.col("id") % 4 != 0, 4 + F.col("id")).alias("budget"), (F.col("id") % 3).alias("partners"), F.when(F.col("id") % 5 == 0, F.array(F.lit("do"))).alias("interests"))
    price = F.when(F.col("price_band").isNotNull(), F.coalesce(c.price_rank(F.col("price_band")), F.lit(0)) + 1)
    of_slot = found.select("day", "slot", F.col("opens").alias("starts"), (F.col("slot") == "lunch").alias("required"), "place_id", "type", "org_id", price.cast("int").alias("price"), (F.col("place_id") % 7 == 0).alias("partner"), "score", "earliest", "latest", "dwell", "lat", "lng")
    return it.plan(of_slot.crossJoin(F.broadcast(asked.select("request_id"))), asked)


def N4_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places").filter("lat IS NOT NULL")
    a, b2 = p.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a")), p.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    known = a.join(b2, F.col("b") == F.col("a") + 1).select("a", "b", F.lit(7).alias("minutes"))
    return it.pair_minutes(a.join(b2, F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10)).filter("a <> b"), known)


def N5_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a careless plan breaks: the best stop of each slot, whatever was taken before."""
    slots = _slots(spark)
    best = it.eligible(_stops(spark, sf_dir), slots, [], None, 1)
    plans = best.filter("NOT (day = 1 AND slot = 'lunch')").select(F.lit(1).cast("long").alias("request_id"), "day", "slot", "place_id")
    return it.violations(plans, _stops(spark, sf_dir).drop("kids", "hours", "price_band", "score"), slots, 1).groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {
    x.__name__: x
    for x in (D8_review_clusters, D9_weakest_term, D10_facet_counts, D11_rollup, D12_dashboard, D13_org_list, D14_blast_radius, D15_domain_links, D16_evidence, E1_best_of_cluster, H32_scalars, D17_duplicate_centroids, D18_series_keys, D20_pick_current, D21_nearest_rank, D22_population_share, D25_coverage_audit, D27_vocabulary, D31_facet_coverage, D32_term_counts, D33_normalised_groups, D34_campaigns, D35_cells, D37_agreement, K1_ndcg, K2_precision, K3_confusion, K3_accuracy, K4_wilson, K5_two_stage, K6_coverage_curve, K7_bootstrap, K9_z_test, K10_experiments, K11_gates, J1_name_similarity, J2_clusters, J3_merge_plan, J4_bucket_merge, J5_names, J6_lookup, J8_junk, J10_area_match, J11_geocode, J12_organisations, O1_drift, O2_orphans, O5_effective, O6_link_policy, B23_host_class, B24_triage, B19_bbox, N1_eligible, N2_precheck, N3_plan, N4_travel, N5_validate)
}

_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))"
_SLOTS = """sl(day, slot, types, o, c) AS (SELECT d::INT, s, t, o, c FROM range(2) r(d), (VALUES ('morning', ['do', 'wellness'], 540, 720), ('lunch', ['eat'], 720, 840), ('evening', ['drink', 'eat'], 1140, 1380)) v(s, t, o, c)),
st AS (SELECT id, type, (id * 31 % 97) / 97 AS score, price_band, org_id, lat, lng, id % 3 <> 0 AS kids, id % 4 <> 0 AS timed, id % 6 * 60 + 480 AS ho, id % 5 * 60 + 900 AS hc FROM places WHERE status = 'active' AND lat IS NOT NULL),
el AS (SELECT day, slot, st.*, row_number() OVER (PARTITION BY day, slot ORDER BY score DESC, id) AS rank FROM sl, st WHERE list_contains(types, type) AND kids AND coalesce(price_band, '') <> 'luxury' AND (NOT timed OR least(hc, c) - greatest(ho, o) >= 60) QUALIFY rank <= 5)"""



def _host(x: str) -> str:
    return f"nullif(regexp_replace(regexp_extract(lower({x}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '')"


ORACLE = {
    "D8_review_clusters": f"""WITH {ctes("entity_terms")}, x AS (SELECT term_id, entity_id, row_number() OVER (PARTITION BY term_id ORDER BY confidence NULLS FIRST, entity_id) AS rn FROM entity_terms QUALIFY rn <= 3), f AS (SELECT term_id, string_agg(entity_id::VARCHAR, ',' ORDER BY rn) AS first FROM x GROUP BY 1)
SELECT term_id, count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS low, max(confidence) AS high, count(DISTINCT source) AS sources, any_value(first) AS first FROM entity_terms JOIN f USING (term_id) GROUP BY 1""",
    "D9_weakest_term": f"WITH {ctes('entity_terms')} SELECT entity_id, count(*) AS n, count(*) FILTER (confidence < 0.5) AS weak, arg_min(term_id, (coalesce(confidence, -1), term_id)) AS weakest FROM entity_terms GROUP BY 1",
    "D10_facet_counts": f"""WITH {ctes("articles")} SELECT 'lang' AS facet, coalesce(lang, 'null') AS value, count(*) AS n FROM articles WHERE source = 'src1' AND format = 'news' GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'null'), count(*) FROM articles WHERE lang = 'en' AND format = 'news' GROUP BY 2
UNION ALL SELECT 'format', coalesce(format, 'null'), count(*) FROM articles WHERE lang = 'en' AND source = 'src1' GROUP BY 2""",
    "D11_rollup": f"WITH {ctes('articles')}, a AS (SELECT lang, coalesce(format, 'Unformatted') AS format FROM articles) SELECT lang, format, count(*) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT lang, 'All', count(*) FROM a GROUP BY 1",
    "D12_dashboard": f"WITH {ctes('articles')} SELECT count(*) AS articles, count(*) FILTER (status = 'draft') AS drafts, count(*) FILTER (primary_type IS NULL) AS untyped, count(DISTINCT series_key) AS series FROM articles",
    "D13_org_list": f"WITH {ctes('places')} SELECT org_id, count(*) AS places, count(*) FILTER (status = 'active') AS active, count(*) OVER () AS total FROM places WHERE org_id IS NOT NULL GROUP BY 1",
    "D14_blast_radius": f"WITH {ctes('places', 'mentions')} SELECT org_id, count(place_id) AS mentions, count(DISTINCT place_id) AS places, count(DISTINCT article_id) AS articles FROM places p LEFT JOIN mentions m ON place_id = p.id GROUP BY 1",
    "D17_duplicate_centroids": f"WITH {ctes('places')}, p AS (SELECT round(lat, 1) AS lat, round(lng, 1) AS lng, id FROM places WHERE lat IS NOT NULL) SELECT lat, lng, count(DISTINCT id)::INT AS n, min(id) AS first FROM p GROUP BY 1, 2 HAVING count(DISTINCT id) >= 2 AND count(*) FILTER (id % 2 <> 0) > 0",
    "D16_evidence": f"WITH {ctes('mentions', 'places')}, m AS (SELECT place_id, count(*) FILTER (role = 'featured') AS f, count(*) AS n, count(DISTINCT article_id) AS a FROM mentions GROUP BY 1) SELECT id AS place_id, coalesce(f, 0) AS featured, coalesce(n, 0) AS mentions, coalesce(a, 0) AS articles, round(f / n, 6) AS share FROM places LEFT JOIN m ON place_id = id",
    "E1_best_of_cluster": f"WITH {ctes('entity_terms')} SELECT term_id, entity_id, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY term_id ORDER BY confidence DESC, entity_id) AS rank FROM entity_terms QUALIFY rank <= 5",
    "H32_scalars": "SELECT strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Jakarta', '%Y-%m-%d') AS local_day, split_part(event_type, 'a', 1) AS part, strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, round(sum(greatest(coalesce(value, 0), 10)), 4)::DOUBLE AS at_least FROM events GROUP BY 1, 2, 3",
    "D18_series_keys": "WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(translate(split_part(text, '.', 1), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[’‘''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents) SELECT sha256(key) AS key_sha, count(*) AS n, min(doc_id) AS first FROM d GROUP BY key HAVING count(*) >= 2",
    "D20_pick_current": f"WITH {ctes('articles')} SELECT series_key, arg_max(id, (coalesce(published_day, -1), id)) AS current, count(*) AS members FROM articles WHERE series_key IS NOT NULL GROUP BY 1",
    "D21_nearest_rank": "WITH l AS (SELECT lang, list_sort(list(n_chars)) AS l FROM documents GROUP BY 1) SELECT lang, l[least(floor(len(l) * 0.95)::BIGINT, len(l) - 1) + 1] AS value FROM l",
    "D22_population_share": f"WITH {ctes('articles')} SELECT primary_type, format, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY primary_type), 6) AS share FROM articles GROUP BY 1, 2",
    "D25_coverage_audit": f"WITH {ctes('articles', 'scores')} SELECT lang, count(*) AS n, count(entity_id) AS scored, count(*) FILTER (score < 0.35) AS low FROM articles LEFT JOIN scores ON entity_id = id GROUP BY 1",
    "D31_facet_coverage": f"WITH {ctes('terms', 'entity_terms')}, f AS (SELECT DISTINCT facet FROM terms UNION SELECT 'occasion') SELECT f.facet, count(e.entity_id) AS assignments, count(DISTINCT e.entity_id) AS articles FROM f LEFT JOIN terms t ON t.facet = f.facet LEFT JOIN entity_terms e ON e.term_id = t.id GROUP BY 1",
    "D32_term_counts": f"WITH {ctes('terms', 'entity_terms')} SELECT slug, count(DISTINCT entity_id) AS n FROM entity_terms JOIN terms t ON t.id = term_id GROUP BY 1",
    "D33_normalised_groups": "SELECT regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g') AS key, count(*) AS n, round(avg(p_retailprice::DOUBLE), 4) AS mean FROM part GROUP BY 1",
    "D34_campaigns": "SELECT c_custkey AS id, count(o_orderkey) AS placements FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "D35_cells": f"WITH {ctes('entity_terms')} SELECT round(confidence, 1) AS value, source, count(*) AS n FROM entity_terms GROUP BY 1, 2",
    "D37_agreement": f"""WITH {ctes("articles")}, s AS (SELECT series_key, list_sort(list(DISTINCT format) FILTER (lang = 'en' AND format IS NOT NULL)) AS x, list_sort(list(DISTINCT format) FILTER (lang = 'fr' AND format IS NOT NULL)) AS y, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM articles WHERE series_key IS NOT NULL GROUP BY 1)
SELECT series_key, CASE WHEN coalesce(x, []) = coalesce(y, []) THEN 'same' WHEN list_has_any(coalesce(x, []), coalesce(y, [])) THEN 'partial' ELSE 'conflict' END AS kind FROM s WHERE a > 0 AND b > 0""",
    "K1_ndcg": f"""WITH {_SQL_RANKED}, d AS (SELECT r.query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM rk r LEFT JOIN gr g USING (query_id, id) WHERE rank <= 10 GROUP BY 1), i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM gr) WHERE r <= 10 GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(idcg, 0) = 0 THEN 0 ELSE round(dcg / idcg, 6) END AS ndcg FROM d LEFT JOIN i USING (query_id)""",
    "K2_precision": f"""WITH {_SQL_RANKED}, h AS (SELECT r.query_id, rank, (coalesce(grade, 0) > 0)::INT AS hit FROM rk r LEFT JOIN gr USING (query_id, id) WHERE rank <= 10), c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM h), s AS (SELECT query_id, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN c / rank ELSE 0 END) AS ap FROM c GROUP BY 1), n AS (SELECT query_id, count(*) FILTER (grade > 0) AS n FROM gr GROUP BY 1)
SELECT query_id, round(hits / 10, 6) AS precision, CASE WHEN coalesce(n, 0) > 0 THEN round(hits / n, 6) ELSE 0 END AS recall, CASE WHEN coalesce(n, 0) > 0 THEN round(ap / least(n, 10), 6) ELSE 0 END AS average_precision FROM s LEFT JOIN n USING (query_id)""",
    "K3_confusion": "SELECT quality, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS guess, count(*) AS n FROM labels GROUP BY 1, 2",
    "K3_accuracy": "SELECT count(*) AS n, round(avg((quality = CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END)::INT), 6) AS accuracy FROM labels",
    "K4_wilson": """WITH s AS (SELECT lang, sum(quality) AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 * 1.96 AS zz FROM s), x AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS c, 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n) AS h FROM p)
SELECT lang, n::BIGINT AS n, round(p, 6) AS p, round(greatest(0, c - h), 6) AS low, round(least(1, c + h), 6) AS high FROM x""",
    "K5_two_stage": """WITH t AS (SELECT lang AS cell, count(*) AS n, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 1 AND doc_id % 3 = 0) AS ac, count(*) FILTER (quality = 1 AND doc_id % 3 = 0 AND toxic = 0) AS ok, count(*) FILTER (quality <> 1 AND doc_id % 2 = 0) AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1),
e AS (SELECT cell, n::DOUBLE AS n, d + a * (ok / nullif(ac, 0)) AS est FROM t), p AS (SELECT *, round_even(est, 0) / n AS p, 1.96 * 1.96 AS zz FROM e), x AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS c, 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n) AS h FROM p)
SELECT cell, round(est, 6) AS estimated_correct, round(p, 6) AS point, round(greatest(0, c - h), 6) AS low, round(least(1, c + h), 6) AS high FROM x""",
    "K6_coverage_curve": """WITH p AS (SELECT (doc_id * 37 % 100) / 100 AS c, quality = 1 AS ok FROM labels), t(threshold) AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 1.5])::DOUBLE)
SELECT threshold, count(*) FILTER (c >= threshold) AS covered, round(count(*) FILTER (c >= threshold) / count(*), 6) AS coverage, round(count(*) FILTER (c >= threshold AND ok) / nullif(count(*) FILTER (c >= threshold), 0), 6) AS accuracy FROM t, p GROUP BY 1""",
    "K9_z_test": f"""WITH {ctes("interactions")}, l AS (SELECT ('0x' || sha256(user_id::VARCHAR)[1:8])::BIGINT % 2 AS arm, kind FROM interactions), s AS (SELECT count(*) FILTER (arm = 0 AND kind = 'view') AS na, count(*) FILTER (arm = 0 AND kind = 'click') AS ka, count(*) FILTER (arm = 1 AND kind = 'view') AS nb, count(*) FILTER (arm = 1 AND kind = 'click') AS kb FROM l),
r AS (SELECT *, least(ka, na) / na AS pa, least(kb, nb) / nb AS pb, (least(ka, na) + least(kb, nb)) / (na + nb) AS pp, least(greatest(ka / na / 2, 0.005), 0.5) AS p1 FROM s), z AS (SELECT *, coalesce((pb - pa) / nullif(sqrt(pp * (1 - pp) * (1 / na + 1 / nb)), 0), 'nan'::DOUBLE) AS z, least(p1 + 0.02, 0.999) AS p2 FROM r), y AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z)
SELECT na, ka, nb, kb, CASE WHEN isfinite(z) THEN round(z, 6) ELSE 0 END AS z, CASE WHEN isfinite(z) THEN round(2 * (1 - 0.5 * (1 + {_ERF})), 6) ELSE 1 END AS p, ceil(pow(1.959964 + 0.841621, 2) * (p1 * (1 - p1) + p2 * (1 - p2)) / pow(p2 - p1, 2))::BIGINT AS needed FROM y""",
    "K11_gates": "WITH s AS (SELECT avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT 'quality' AS metric, round(q, 6) AS value, 0.45::DOUBLE AS floor, q >= 0.45 AS passed FROM s UNION ALL SELECT 'toxic', round(t, 6), 0.85, t >= 0.85 FROM s UNION ALL SELECT 'latency', NULL, 0.05, false",
    "K10_experiments": f"""WITH {ctes("interactions")}, {bp._SQL_RAILED}, a AS (SELECT split_part(rail, '~', 1) AS base, split_part(rail, '~', 2) AS v, count(*) AS n, count(*) FILTER (kind = 'click') AS k FROM railed WHERE rail LIKE '%~%' GROUP BY 1, 2), m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY base ORDER BY n DESC, v DESC) = 1),
r AS (SELECT m.base, m.v AS control, a.v AS variant, m.n AS na, a.n AS nb, m.k / m.n AS pa, a.k / a.n AS pb, (m.k + a.k) / (m.n + a.n) AS pp, least(greatest(CASE WHEN m.k > 0 THEN m.k / m.n ELSE 0.02 END, 0.005), 0.5) AS p1 FROM m JOIN a ON a.base = m.base AND a.v <> m.v),
z AS (SELECT *, (pb - pa) / nullif(sqrt(pp * (1 - pp) * (1 / na + 1 / nb)), 0) AS z, least(p1 + 0.02, 0.999) AS p2 FROM r), y AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t, ceil(pow(1.959964 + 0.841621, 2) * (p1 * (1 - p1) + p2 * (1 - p2)) / pow(p2 - p1, 2))::BIGINT AS needed FROM z)
SELECT base, control, variant, coalesce(round(z, 6), 0) AS z, coalesce(round(2 * (1 - 0.5 * (1 + {_ERF})), 6), 1) AS p, needed, least(na, nb) >= needed AS enough FROM y""",
    "D15_domain_links": f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS href FROM pages), n AS (SELECT page_id, page_id % 90 AS day, href, coalesce({_host("href")}, {_host("url")}) AS netloc FROM l)
SELECT netloc, count(*) AS links, count(DISTINCT page_id) AS articles, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (page_id % 3 = 1) AS sponsored, count(*) FILTER (page_id % 3 = 0) AS nofollow, count(*) FILTER (page_id % 3 = 2) AS plain, array_to_string(list_sort(list_distinct(list(href)))[1:2], ' ') AS samples FROM n GROUP BY 1""",
    "D27_vocabulary": f"SELECT word, count(*) AS mentions, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources FROM (SELECT doc_id, source, unnest({_tok('text')}) AS word FROM documents) WHERE word IN ('tion', 'ther', 'erth', 'quelle', 'keit', 'eaux') GROUP BY 1",
    "J10_area_match": f"""WITH {ctes("places")}, a(area_id, name, depth) AS (VALUES (1::BIGINT, 'red', 1), (2, 'blue green', 2), (3, 'green', 1), (4, 'hot', 2), (5, 'misty rose', 3)), w AS (SELECT id, ' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM places)
SELECT w.id, area_id FROM w JOIN a ON contains(t, ' ' || a.name || ' ') QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY depth DESC, length(a.name) DESC, area_id) = 1""",
    "J12_organisations": f"""WITH h AS ({_RANKING["H12_hosts"]}), e AS (SELECT root, sub AS subdomain, count(*) AS links FROM h GROUP BY 1, 2), u AS (SELECT * FROM e UNION ALL SELECT DISTINCT root, NULL, 0 FROM e WHERE root NOT IN (SELECT root FROM e WHERE subdomain IS NULL))
SELECT root, subdomain, links, CASE WHEN subdomain IS NOT NULL THEN root END AS parent FROM u""",
    "J4_bucket_merge": f"""WITH {ctes("places")}, p AS (SELECT *, substring(name, 7, 9) AS key FROM places) SELECT key, arg_min(type, id) FILTER (type IS NOT NULL) AS type, arg_min(area_term, id) FILTER (area_term IS NOT NULL) AS area_term, arg_min(price_band, id) FILTER (price_band IS NOT NULL) AS price_band,
array_to_string(list_filter([CASE WHEN count(DISTINCT type) > 1 THEN 'type' END, CASE WHEN count(DISTINCT area_term) > 1 THEN 'area_term' END, CASE WHEN count(DISTINCT price_band) > 1 THEN 'price_band' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM p GROUP BY 1""",
    "J8_junk": f"""WITH w(k, reason) AS (VALUES {", ".join(f"({i}, '{why}')" for i, (_, why) in enumerate(_JUNK))}) SELECT CASE WHEN reason IS NULL THEN 'ok' WHEN reason IN {_DOUBTFUL} THEN 'suspect' ELSE 'junk' END AS verdict, reason, count(*) AS n, min(p_partkey::BIGINT) AS first FROM part LEFT JOIN w ON k = p_partkey % 60 GROUP BY 1, 2""",
    "J11_geocode": """WITH p AS (SELECT p_partkey::BIGINT AS key, -6 + (p_partkey % 100) / 50 AS lat, 106.0 + p_partkey % 10 AS lng FROM part), s AS (SELECT *, CASE WHEN key % 50 = 0 THEN 'override' WHEN key % 7 = 0 THEN 'existing' WHEN key % 3 = 0 AND lat + 11.6 <= 6.5 THEN 'address' WHEN key % 2 = 0 THEN 'name' ELSE 'unresolved' END AS step FROM p)
SELECT key, step, round(CASE step WHEN 'override' THEN lat WHEN 'existing' THEN lat + 0.1 WHEN 'address' THEN lat + 11.6 WHEN 'name' THEN lat + 0.3 END, 6)::DOUBLE AS lat, round(CASE WHEN step <> 'unresolved' THEN lng END, 6)::DOUBLE AS lng FROM s""",
    "O1_drift": f"""WITH {ctes("articles")}, f AS (SELECT id, CASE WHEN id % 12 = 0 THEN 'other' ELSE format END AS fact FROM articles WHERE id % 8 <> 1), j AS (SELECT a.id, format, fact FROM articles a LEFT JOIN f USING (id)), k AS (SELECT id, CASE WHEN fact IS NULL AND format IS NOT NULL THEN 'missing' WHEN format IS DISTINCT FROM fact THEN 'disagree' END AS kind FROM j) SELECT * FROM k WHERE kind IS NOT NULL""",
    "O2_orphans": f"WITH {ctes('mentions', 'places')} SELECT place_id, count(*) AS n, min(id) AS first FROM mentions WHERE place_id NOT IN (SELECT id FROM places WHERE id % 40 <> 0) GROUP BY 1",
    "O5_effective": f"WITH {ctes('places')} SELECT id FROM places WHERE status = 'active' AND (id % 3 <> 0 OR id % 200 <= 100) AND (id % 4 <> 0 OR id % 300 > 100)",
    "O6_link_policy": "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_source=site&utm_campaign=x') END AS href, CASE page_id % 3 WHEN 0 THEN 'sponsored noopener' WHEN 1 THEN 'nofollow noopener' END AS rel FROM pages",
    "B23_host_class": f"""WITH h AS (SELECT CASE page_id % 11 WHEN 0 THEN 'm.facebook.com' WHEN 1 THEN 'bit.ly' WHEN 2 THEN 'drive.google.com' WHEN 3 THEN 'youtu.be' WHEN 4 THEN 'images.unsplash.com' WHEN 5 THEN 'x.onelink.me' WHEN 6 THEN 'notbit.ly' ELSE {_host("url")} END AS h FROM pages)
SELECT CASE WHEN h IN ('m.facebook.com', 'youtu.be') THEN 'social' WHEN h = 'images.unsplash.com' THEN 'stock' WHEN h IN ('bit.ly', 'x.onelink.me') THEN 'shortener' WHEN h = 'drive.google.com' THEN 'utility' WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'internal' END AS kind, count(*) AS n FROM h GROUP BY 1""",
    "B24_triage": f"""WITH {ctes("places", "mentions")}, e AS (SELECT p.id, count(m.id) AS n FROM places p LEFT JOIN mentions m ON place_id = p.id AND place_id % 3 <> 0 GROUP BY 1) SELECT CASE WHEN id % 50 = 0 THEN 'keep' WHEN id % 4 = 0 AND n = 0 THEN 'archive' WHEN id % 4 < 2 THEN 'review' WHEN id % 5 = 0 THEN 'review' ELSE 'keep' END AS action, count(*) AS n FROM e GROUP BY 1""",
    "B19_bbox": f"WITH {ctes('places')} SELECT id FROM places WHERE lat IS NOT NULL AND id % 11 <> 0",
    "N1_eligible": f"WITH {ctes('places')}, {_SLOTS} SELECT day, slot, id AS place_id, rank FROM el",
    "N2_precheck": f"""WITH {ctes("places")}, {_SLOTS}, d AS (SELECT DISTINCT id, org_id FROM el), x AS (SELECT (SELECT count(*) FROM sl) AS slots, (SELECT count(DISTINCT org_id) + count(*) FILTER (org_id IS NULL) FROM d) AS supply, (SELECT count(*) FROM sl WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.day = sl.day AND el.slot = sl.slot)) AS empty) SELECT slots, supply, empty, supply >= slots AND empty = 0 AS feasible FROM x""",
    "N4_travel": f"""WITH {ctes("places")}, p AS (SELECT * FROM places WHERE lat IS NOT NULL), x AS (SELECT a.id AS a, b.id AS b, 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS km FROM p a, p b WHERE a.id <> b.id AND a.id // 10 = b.id // 10)
SELECT a, b, CASE WHEN abs(a - b) = 1 THEN 7 ELSE greatest(5, round_even(km / 18 * 60, 0)::INT) END AS minutes FROM x""",
}
