"""Queries of loaders and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loading as lo
from ..operators import resolution
from .fixtures import ctes, table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "nation", F.col("c_mktsegment").alias("segment"))


def A25_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put into a table that has every third one, some with another segment: old numbers stay, new ones follow by name; those of nations that aren't loaded are left out."""
    rows = _customers(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("nation"), (F.col("n_nationkey") + 1000).cast("long").alias("id"))
    old = rows.filter("k % 3 = 0").select("name", "k", "segment")
    ids = resolution.durable(lo.numbered(old, ["name"]))
    had = ids.select("id", F.lit(None).cast("long").alias("nation_id"), F.when(F.col("k") % 2 == 0, "OTHER").otherwise(F.col("segment")).alias("segment"))
    got, _, _ = lo.load(had, ids.select("name", "id"), rows.drop("k"), ["name"], {"nation_id": (nations, ["nation"])})
    return got


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "places")
    name = lambda i: F.concat("name", F.lit(" "), i.cast("string"))
    return p.select("id", name(F.col("id")).alias("a_name"), name(F.col("id") + 1).alias("b_name"), (F.col("id") * 37 % 100 / 100).alias("similarity"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every third pair, told in the other order, and old ones on every fifth."""
    p = _pairs(spark, sf_dir).withColumn("hash", lo.content_hash(F.col("b_name"), F.col("a_name")))
    return p.filter("id % 3 = 0").select("hash", (F.col("id") % 2 == 0).alias("same"), F.lit(2).alias("version")).unionByName(p.filter("id % 5 = 0").select("hash", F.lit(True).alias("same"), F.lit(1).alias("version")))


def M4_adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.adjudicated(_pairs(spark, sf_dir), _verdicts(spark, sf_dir), 2, resolution.AUTO, resolution.REVIEW).select("id", "action")


def M4_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _pairs(spark, sf_dir).filter(F.col("similarity").between(resolution.REVIEW, resolution.AUTO - 1e-9))
    return lo.undecided(some, _verdicts(spark, sf_dir), 2).select("a_name", "b_name")


QUERIES = {x.__name__: x for x in (A25_load, M4_adjudicated, M4_undecided)}

_PAIRS = f"WITH {ctes('places')}, p AS (SELECT id, concat(name, ' ', id) AS a_name, concat(name, ' ', id + 1) AS b_name, (id * 37 % 100) / 100 AS s FROM places)"
ORACLE = {
    "A25_load": """WITH n AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, n_nationkey AS nk FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey), o AS (SELECT *, row_number() OVER (ORDER BY name) AS id FROM n WHERE k % 3 = 0),
x AS (SELECT *, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY name) AS id FROM n WHERE k % 3 <> 0 AND nk % 5 <> 0)
SELECT id::BIGINT AS id, CASE WHEN nk % 5 <> 0 THEN nk + 1000 END::BIGINT AS nation_id, CASE WHEN nk % 5 <> 0 OR k % 2 <> 0 THEN segment ELSE 'OTHER' END AS segment FROM o
UNION ALL SELECT id::BIGINT, (nk + 1000)::BIGINT, segment FROM x""",
    "M4_adjudicated": f"{_PAIRS} SELECT id, CASE WHEN s >= {resolution.AUTO} THEN 'merge' WHEN s < {resolution.REVIEW} THEN 'apart' WHEN id % 3 = 0 AND id % 2 = 0 THEN 'merge' WHEN id % 3 = 0 THEN 'apart' ELSE 'review' END AS action FROM p",
    "M4_undecided": f"{_PAIRS} SELECT a_name, b_name FROM p WHERE s >= {resolution.REVIEW} AND s < {resolution.AUTO} AND id % 3 <> 0",
}
