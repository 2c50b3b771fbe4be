"""What the spatial join deals out where many places share a cell."""

from pyspark.sql import functions as F

from meridian.operators import joins


def _places(spark, n):
    """Places in one cell of a kilometre, all of them within a kilometre of each other."""
    return spark.range(n).selectExpr("id", "0.9105 + id % 60 * 1e-5 AS lat", "0.0005 + floor(id / 60) * 1e-5 AS lng")


def _dealt(plan):
    kids = plan.children()
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(_dealt(kids.apply(i)) for i in range(kids.size()))


def test_rows_of_a_crowded_cell_are_dealt_out_a_few_times(spark):
    n = 4000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = joins.within_distance(_places(spark, n), 1000.0).agg(F.count("*").alias("pairs"))
        assert got.collect()[0].pairs == n * (n - 1) // 2
        assert _dealt(got._jdf.queryExecution().executedPlan()) < 9 * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_tiles_of_a_crowded_cell_make_each_pair_once(spark):
    """Twenty parts of places, and five of those who ask."""
    n = 300
    got = joins.within_distance(_places(spark, n), 1000.0, part=15).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(n) for b in range(a + 1, n)]
