"""First values by precedence, against plain Python; what a task holds of rows with equal values."""

import random

from pyspark.sql import functions as F

from meridian.operators import resolution


def test_first_values_and_conflicts_follow_the_order(spark):
    rng = random.Random(23)
    ids = rng.sample(range(1000), 239)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3]), i, rng.choice(["x", "y", None]), rng.choice([0.5, 1.5, float("nan"), None])) for i in ids]
    rows += [("a", 1, None, "z", 2.5), ("alone", None, 2000, None, None), ("same", 2, 2001, "x", 1.5), ("same", 1, 2002, None, 1.5), ("same", 2, 2003, "x", None)]
    df = spark.createDataFrame(rows, "key string, rank int, id long, kind string, worth double").repartition(3)
    least = lambda v: (v is not None, v or 0)
    for columns, order in ((["id"], lambda r: least(r[2])), (["rank", "id"], lambda r: (least(r[1]), least(r[2])))):
        want = {}
        for key in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == key), key=order)
            known = [[str(r[i]) for r in own if r[i] is not None] for i in (3, 4)]
            want[key] = (*(k[0] if k else "None" for k in known), [n for n, k in zip(("kind", "worth"), known, strict=True) if len(set(k)) > 1])
        got = resolution.first_known(df, "key", [F.col(c) for c in columns], ["kind", "worth"]).collect()
        assert {r.key: (str(r.kind), str(r.worth), r.conflicts) for r in got} == want and len(got) == len(want)


def test_what_a_task_holds_does_not_grow_with_rows_of_equal_values(spark):
    def peak(plan):
        own = plan.metrics().get("peakMemory")
        kids = plan.children()
        return max([own.get().value() if own.isDefined() else 0, *(peak(kids.apply(i)) for i in range(kids.size()))])

    def held(n):
        kind = lambda k: F.when(F.col("id") % k > 0, F.concat(F.lit("kind "), F.col("id") % k))
        df = spark.range(0, n, 1, 1).select("id", F.concat(F.lit("key "), F.col("id") % 3).alias("key"), kind(4).alias("a"), kind(5).alias("b"), kind(7).alias("c"))
        got = resolution.first_known(df, "key", [F.col("id")], ["a", "b", "c"])
        assert sorted((r.key, r.a, r.b, r.c, r.conflicts) for r in got.collect()) == [("key 0", "kind 3", "kind 3", "kind 3", ["a", "b", "c"]), *((f"key {i}", *[f"kind {i}"] * 3, ["a", "b", "c"]) for i in (1, 2))]
        return peak(got._jdf.queryExecution().executedPlan())

    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        small, large = held(4_000), held(400_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert large <= 1.2 * small, (small, large)
