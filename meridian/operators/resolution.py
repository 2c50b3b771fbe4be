"""Entity resolution: names, candidate pairs, components, areas, lookups."""

from __future__ import annotations

import difflib
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import columns as c
from .joins import block_pairs

#: Fixed values of the domain: when a pair is one place, and when people should look.
AUTO, REVIEW = 0.85, 0.55
#: Fixed values of the domain: what equal core words are worth, and the weight of the main evidence.
SAME_CORE, MAJOR = 0.9, 0.7
#: Words that many names have: a short default; a domain's own are an argument.
GENERIC = ("the", "a", "of", "and", "at", "in", "by", "hotel", "resort", "restaurant", "cafe", "bar", "spa", "club", "villa", "villas")


def core_tokens(name: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Words of a name in order, without those that many names have; all of them where none else is left."""
    found = F.array_distinct(F.filter(F.split(c.normalize_name(name), " "), lambda w: w != ""))
    own = F.filter(found, lambda w: ~F.array_contains(F.array(*map(F.lit, generic)), w))
    return F.when(F.size(own) > 0, own).otherwise(found)


def block(name: Column) -> Column:
    """The first core word: names without a common one are never held against each other."""
    return F.try_element_at(core_tokens(name), F.lit(1))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in function has."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def _similar(a: Column, b: Column, ratio: Callable[[Column, Column], Column]) -> Column:
    """What two names' similarity is, given that of their letters' sequence; it grows with that."""
    na, nb = c.normalize_name(a), c.normalize_name(b)
    overlap, shared = c.jaccard(core_tokens(a), core_tokens(b), 0.0), F.size(F.array_intersect(core_tokens(a), core_tokens(b)))
    r = ratio(na, nb)
    main = F.when(shared >= 2, F.when(overlap == 1, F.greatest(F.lit(SAME_CORE), r)).otherwise(MAJOR * overlap + (1 - MAJOR) * r)).otherwise((1 - MAJOR) * overlap + MAJOR * r)
    return F.when((na == nb) & (na != ""), 1.0).otherwise(main)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normal names. With two core words in common their overlap weighs most, and equal core words are sure; else the sequence does."""
    return _similar(a, b, sequence_ratio)


def _length_bound(a: Column, b: Column) -> Column:
    """What the similarity of two sequences can be at most, by their lengths."""
    return F.coalesce(2.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(1.0))


def candidate_pairs(names: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, similarity) of names that share their first core word, at least worth a review. Pairs that can't be, by their words and lengths alone, are left before any sequence is compared."""
    pairs = block_pairs(names.select(key, "name", block(F.col("name")).alias("block")), "block", key)
    able = pairs.filter(_similar(F.col("a_name"), F.col("b_name"), _length_bound) >= REVIEW - 1e-9)
    return able.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), name_similarity(F.col("a_name"), F.col("b_name")).alias("similarity")).filter(F.col("similarity") >= REVIEW)


def _checkpoint_folder(spark: SparkSession) -> None:
    """Set the folder that spark.checkpoint.dir names, where none is set; a folder of its own will do on one machine only."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='meridian-')}")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, where it outlives executors."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of `nodes`: the least node reachable over edges (a, b).

    Labels spread by joins and jump to their label's label, so chains take few
    rounds; each round is checkpointed to the session's checkpoint folder where
    one is set. A round that moves nothing ends it.
    """
    both = edges.select("a", "b").unionAll(edges.select("b", "a")).toDF("a", "b").distinct()
    now = nodes.select("node", F.col("node").alias("root"))
    _checkpoint_folder(nodes.sparkSession)
    now = now.checkpoint()
    for _ in range(rounds):
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("r"))
        step = now.join(near, now["node"] == near["a"], "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = step.join(step.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col("root") == F.col("__n"), "left").select("node", F.least("root", F.coalesce("__r", "root")).alias("root"))
        nxt = jump.checkpoint()
        moved = nxt.join(now.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        now = nxt
        if not moved:
            return now
    raise RuntimeError("labels still move")


def canonical(members: DataFrame) -> DataFrame:
    """Of each root the name by count, then length, then alphabet: (root, name)."""
    return members.groupBy("root").agg(F.max_by("name", F.struct("n", F.length("name"), F.col("name"))).alias("name"), F.sum("n").alias("n"), F.count("*").alias("members"))


def clusters(names: DataFrame) -> DataFrame:
    """(root, name, n, members) of distinct names (id, name, n): components over links of at least AUTO."""
    pairs = candidate_pairs(names).filter(F.col("similarity") >= AUTO)
    roots = components(pairs, names.select(F.col("id").alias("node")))
    return canonical(roots.join(names, F.col("node") == F.col("id")).select("root", "name", "n"))


def review_pairs(names: DataFrame) -> DataFrame:
    """(a, b, similarity) of names that people should look at."""
    return candidate_pairs(names).filter(F.col("similarity") < AUTO)


def merge_plan(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, action, reason): sure pairs merge unless a guard holds them back for review.

    Guards: other types, other organisations, other areas.
    """
    side = lambda p: places.select(F.col("id").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in ("type", "org_id", "area_term")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differs = lambda x: F.col(f"a_{x}").isNotNull() & F.col(f"b_{x}").isNotNull() & (F.col(f"a_{x}") != F.col(f"b_{x}"))
    reason = F.when(F.col("similarity") < AUTO, "unsure").when(differs("type"), "type").when(differs("org_id"), "organisation").when(differs("area_term"), "area")
    return both.select("a", "b", F.when(reason.isNull(), "merge").otherwise("review").alias("action"), reason.alias("reason"))


def first_known(rows: DataFrame, by: str, order: list[Column], fields: list[str]) -> DataFrame:
    """Of each key the first non-null value of each field by precedence, and the fields in which rows disagree.

    Rows of equal values meet first, under the least of the last order column. Where that is a number, Spark sums them up by hash
    as they are read; to sort, a task must hold all its rows.
    """
    *lead, last = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    leads, name = [f"__o{i}" for i in range(len(lead))], f"__o{len(lead)}"
    alike = rows.select(by, *lead, last, *fields).groupBy(by, *leads, F.col(name).isNull().alias("__null"), *fields).agg(F.min(name).alias(name))
    first = F.struct(*leads, name)
    values = [F.min_by(f, F.when(F.col(f).isNotNull(), first)).alias(f) for f in fields]
    conflicts = F.array_compact(F.array(*[F.when(F.min(f) != F.max(f), F.lit(f)) for f in fields])).alias("conflicts")
    return alike.groupBy(by).agg(*values, conflicts)


def match_areas(texts: DataFrame, areas: DataFrame, key: str = "id") -> DataFrame:
    """(key, area_id) of the area named in a text: the deepest, then the longest name, then the least id. areas: (area_id, name, depth).

    Names meet the text's runs of up to three words by an equal join, so no pattern is tried on every row.
    """
    words = F.split(c.normalize_name(F.col("text")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("__w")), lambda i: i + n <= F.size("__w")), lambda i: F.array_join(F.slice("__w", i + 1, n), " "))))
    said = texts.withColumn("__w", words).select(key, F.explode(F.array_distinct(runs)).alias("__run"))
    named = areas.select("area_id", "depth", c.normalize_name(F.col("name")).alias("__run"))
    return said.join(named, "__run").groupBy(key).agg(F.max_by("area_id", F.struct("depth", F.length("__run"), -F.col("area_id"))).alias("area_id"))


def organisations(domains: DataFrame) -> DataFrame:
    """(root, subdomain, links, parent): hosts as children of their root, roots made up where only children are known. domains: (netloc, links)."""
    each = domains.groupBy(c.root_domain(F.col("netloc")).alias("root"), c.subdomain(F.col("netloc")).alias("subdomain")).agg(F.sum("links").alias("links"))
    roots = each.filter("subdomain IS NULL").select("root")
    made = each.select("root").distinct().join(roots, "root", "left_anti").select("root", F.lit(None).cast("string").alias("subdomain"), F.lit(0).cast("long").alias("links"))
    return each.unionByName(made).withColumn("parent", F.when(F.col("subdomain").isNotNull(), F.col("root")))


def lookup(mentions: DataFrame, gazetteer: DataFrame, at_least: float = 0.75) -> DataFrame:
    """(mention, place_id, similarity): equal normal names first, else the most similar one with the same first core word."""
    m = mentions.select("mention", c.normalize_name(F.col("mention")).alias("__n"), block(F.col("mention")).alias("__b"))
    g = gazetteer.select("place_id", F.col("name"), c.normalize_name(F.col("name")).alias("__gn"), block(F.col("name")).alias("__gb"))
    exact = m.join(g, F.col("__n") == F.col("__gn")).groupBy("mention").agg(F.min("place_id").alias("place_id")).withColumn("similarity", F.lit(1.0))
    rest = m.join(exact.select(F.col("mention").alias("__done")), F.col("mention") == F.col("__done"), "left_anti").join(g, F.col("__b") == F.col("__gb"))
    fuzzy = rest.withColumn("similarity", name_similarity(F.col("mention"), F.col("name"))).filter(F.col("similarity") >= at_least)
    return exact.unionByName(fuzzy.groupBy("mention").agg(F.max_by("place_id", F.struct("similarity", -F.col("place_id"))).alias("place_id"), F.max("similarity").alias("similarity")))


def geocode(candidates: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """Candidates with lat, lng and the step that gave them: the first source with a point inside the country wins.

    sources: (step, (key, lat, lng)), in the order override, existing, address, name.
    """
    out = candidates
    picks = []
    for i, (step, rows) in enumerate(sources):
        inside = rows.filter(F.col("lat").between(-11.5, 6.5) & F.col("lng").between(94.5, 141.5))
        out = out.join(inside.select(F.col(key).alias(f"__k{i}"), F.struct(F.lit(step).alias("step"), "lat", "lng").alias(f"__s{i}")), F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        picks.append(F.col(f"__s{i}"))
    best = F.coalesce(*picks)
    return out.withColumns({"step": F.coalesce(best["step"], F.lit("unresolved")), "lat": best["lat"], "lng": best["lng"]}).drop(*[f"__s{i}" for i in range(len(sources))])


def duplicate_centroids(points: DataFrame, places: int = 5) -> DataFrame:
    """Rounded points that two or more keys share, one of them not seeded: (lat, lng, keys)."""
    at = points.groupBy(F.round("lat", places).alias("lat"), F.round("lng", places).alias("lng"))
    return at.agg(F.array_sort(F.collect_set("key")).alias("keys"), F.max((~F.col("seeded")).cast("int")).alias("__open")).filter((F.size("keys") >= 2) & (F.col("__open") == 1)).drop("__open")


def extract_names(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, name) of runs of two to five capitalised words, connectors inside kept, as venue names are written."""
    pattern = "([A-ZÀ-Þ][a-zà-ÿ]+(?: (?:of|the|and|de|la|&|[A-ZÀ-Þ][a-zà-ÿ]+)){1,4})"
    found = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))).alias("name"))
    trimmed = F.regexp_replace(F.col("name"), "( (of|the|and|de|la|&))+$", "")
    return found.select(key, trimmed.alias("name")).filter(F.instr("name", " ") > 0).distinct()
