"""Word deltas against counting by hand, and what they shuffle."""

from collections import Counter

from meridian.operators import content
from meridian.plans import registry

ROWS = [
    (1, "a b  a\tc\nd", "a b"), (2, "x y", "x y z z"), (3, None, None), (4, " \n", ""), (5, "q r s", "q r"),
    (6, "a b", "a"), (6, "b c c", "b b"), (None, "a b", "a"), (None, "a", None), (7, "no half", None),
]


def _want(rows):
    have, left, keys = Counter(), Counter(), set()
    split = lambda t: [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    for k, text, part in rows:
        for w in split(text):
            have[k, w, k is None] += 1
            keys.add(k)
        for w in split(part):
            left[k, w, False] += 1  # without a key the sides don't meet
            keys.add(k)
    return {(k, sum(n for w, n in (have - left).items() if w[0] == k), sum(n for w, n in (left - have).items() if w[0] == k)) for k in keys}


def test_word_delta_equals_counting(spark):
    for rows in (ROWS, [r for r in ROWS if r[0] not in (6, None)]):
        df = spark.createDataFrame(rows, "id long, text string, half string").repartition(3)
        got = [tuple(r) for r in content.word_delta(df, "text", "half").select("id", "lost", "gained").collect()]
        assert len(got) == len(set(got)) and set(got) == _want(rows)


def test_words_of_documents_are_not_shuffled(spark, sf_dir):
    plan = registry.queries()["H10_word_delta"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
