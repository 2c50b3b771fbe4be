"""How few other sets a token set is compared with."""

import random

from pyspark.sql import functions as F

from meridian.functions import columns as c
from meridian.operators import joins


def test_few_unlike_sets_are_compared(spark, monkeypatch):
    rng = random.Random(8)
    sets = [set(rng.sample(range(60), 10)) for _ in range(150)]
    sets += [{*list(s)[:8], 70 + i} for i, s in enumerate(sets[:20])] + [set(range(100, 700)), set(range(110, 720))]
    df = spark.createDataFrame([(i, sorted(map(str, s))) for i, s in enumerate(sets)], "id long, s array<string>")
    seen, jaccard = spark.sparkContext.accumulator(0), c.jaccard
    count = F.udf(lambda s: seen.add(1) or s, "array<string>").asNondeterministic()
    monkeypatch.setattr(joins.c, "jaccard", lambda a, b, *more: jaccard(count(a), b, *more))
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i < j and 2 * len(s & t) >= len(s | t)}
    got = [(r.a, r.b) for r in joins.token_pairs(df, 0.5).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 21
    assert seen.value < 600  # of 14,706 pairs
