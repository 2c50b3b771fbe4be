"""Offline measures: rankings, classifications, intervals, calibration, experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .resolution import durable


#: Pairs that draw their bootstrap weights together.
BLOCK = 2000
#: Distinct values that are placed by one sort a key; beyond that about so many in a range, and so many ranges at most.
RANGE_ROWS, RANGES = 100_000, 4096


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ndcg(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): gains 2^grade - 1 over log2(rank + 1) against the ideal order of all grades; 0 where nothing is relevant.

    ranked: (query_id, id, rank); grades: (query_id, id, grade).
    """
    got = ranked.filter(F.col("rank") <= k).join(grades, ["query_id", "id"], "left").groupBy("query_id").agg(F.sum(_gain(F.coalesce("grade", F.lit(0.0)), F.col("rank"))).alias("dcg"))
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))).filter(F.col("r") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("r"))).alias("idcg"))
    return ranked.select("query_id").distinct().join(got, "query_id", "left").join(best, "query_id", "left").select("query_id", F.when(F.coalesce("idcg", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.nullif("idcg", F.lit(0.0))).alias("ndcg"))


def precision(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, average_precision) at k: hits over k, over the relevant, and AP over min(relevant, k)."""
    top = ranked.filter(F.col("rank") <= k).join(relevant.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").na.fill(0, ["hit"])
    cum = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    sums = top.withColumn("__c", cum).groupBy("query_id").agg(F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.col("__c") / F.col("rank")).otherwise(0.0)).alias("ap"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = ranked.select("query_id").distinct().join(sums, "query_id", "left").join(total, "query_id", "left").na.fill(0)
    return out.select("query_id", (F.col("hits") / k).alias("precision"), F.when(F.col("relevant") > 0, F.col("hits") / F.nullif("relevant", F.lit(0))).otherwise(0.0).alias("recall"), F.when(F.col("relevant") > 0, F.col("ap") / F.nullif(F.least("relevant", F.lit(k)), F.lit(0))).otherwise(0.0).alias("average_precision"))


def metric_bundle(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall, hit, mrr) at k of each query: recall is hits over min(relevant, k), mrr one over the first hit's rank."""
    relevant = grades.filter("grade > 0")
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = ndcg(ranked, grades, k).join(hits, "query_id", "left").join(total, "query_id", "left").na.fill(0, ["hits", "relevant"])
    recall = F.when(F.col("relevant") > 0, F.col("hits") / F.nullif(F.least("relevant", F.lit(k)), F.lit(0))).otherwise(0.0)
    return out.select("query_id", "ndcg", recall.alias("recall"), (F.col("hits") > 0).cast("double").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def group_means(bundle: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Mean metrics of the queries of each group, and their number. groups: (query_id, by)."""
    return bundle.join(groups, "query_id").groupBy(by).agg(F.count("*").alias("queries"), *[F.avg(x).alias(x) for x in ("ndcg", "recall", "hit", "mrr")])


def compare_systems(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, mean_a, mean_b, diff, wins, losses) of two systems' metric bundles over the queries that both answer."""
    names = ("ndcg", "recall", "hit", "mrr")
    both = a.select("query_id", *[F.col(x).alias(f"a_{x}") for x in names]).join(b.select("query_id", *[F.col(x).alias(f"b_{x}") for x in names]), "query_id")
    each = both.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"a_{x}").alias("a"), F.col(f"b_{x}").alias("b")) for x in names])).alias("m")).select("m.*")
    return each.groupBy("metric").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("diff"), F.count(F.when(F.col("b") > F.col("a") + 1e-12, 1)).alias("wins"), F.count(F.when(F.col("b") < F.col("a") - 1e-12, 1)).alias("losses"))


def latencies(timings: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, n, p50, p95, p99) of timings, by nearest rank."""
    out = timings.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        part = nearest_rank(timings, value, share, by).withColumnRenamed("value", name)
        out = out.join(part, list(by)) if by else out.crossJoin(F.broadcast(part))
    return out


def confusion(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    return pairs.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def multilabel(actual: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """Micro precision and recall of sets of labels (key, label)."""
    both = actual.select(key, label, F.lit(1).alias("a")).join(predicted.select(key, label, F.lit(1).alias("p")), [key, label], "full").na.fill(0, ["a", "p"])
    sums = both.agg(F.sum(F.col("a") * F.col("p")).alias("tp"), F.sum("a").alias("actual"), F.sum("p").alias("predicted"))
    return sums.select("tp", "actual", "predicted", (F.col("tp") / F.nullif("predicted", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("actual", F.lit(0))).alias("recall"))


def two_stage_accuracy(cells: DataFrame) -> DataFrame:
    """Accuracy of each cell from adjudicated disagreements and a control slice of agreements.

    cells: cell, n_sampled, n_agree, n_agree_checked, n_agree_correct, n_disagree_correct. Null without a control slice.
    """
    rate = F.col("n_agree_correct") / F.nullif("n_agree_checked", F.lit(0))
    estimated = F.col("n_disagree_correct") + F.col("n_agree") * rate
    point, low, high = c.wilson(F.bround(estimated), F.col("n_sampled"))
    return cells.select("cell", estimated.alias("estimated_correct"), point.alias("point"), low.alias("low"), high.alias("high"))


def coverage_curve(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold how many predictions reach it and how many of those hold: (confidence, correct). One pass: sums by how many thresholds a row reaches."""
    steps = sorted(thresholds)
    reached = sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in steps), F.lit(0))
    sums = predictions.groupBy(reached.alias("r")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("ok"))
    total = predictions.agg(F.count("*").alias("total"))
    marks = predictions.sparkSession.createDataFrame([(float(t), i + 1) for i, t in enumerate(steps)], "threshold double, need int")
    met = marks.join(sums, F.col("r") >= F.col("need"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"))
    return met.crossJoin(F.broadcast(total)).select("threshold", "covered", (F.col("covered") / F.nullif("total", F.lit(0))).alias("coverage"), (F.col("correct") / F.nullif("covered", F.lit(0))).alias("accuracy"))


def block_draws(sizes: np.ndarray, block: int, rounds: int, seed: int) -> np.ndarray:
    """How many of all draws fall on one block in each round, where each round draws as often as there are rows.

    The draws of a range of blocks are split between its halves by a binomial,
    seeded by the range; blocks go down the same splits, so their numbers are one
    multinomial draw and sum to the number of rows in every round, with no block knowing more than all sizes.
    """
    upto, lo, hi = np.r_[0, np.cumsum(sizes)], 0, len(sizes)
    draws = np.full(rounds, upto[-1])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).binomial(draws, (upto[mid] - upto[lo]) / max(upto[hi] - upto[lo], 1))
        draws, lo, hi = (left, lo, mid) if block < mid else (draws - left, mid, hi)
    return draws


def paired_bootstrap(pairs: DataFrame, rounds: int = 2000, seed: int = 7, block_rows: int = BLOCK) -> DataFrame:
    """(mean_diff, low, high, p_b_better) of b - a over resampled queries: (query_id, a, b).

    Each round draws n of the n queries with replacement. Queries are dealt into blocks
    of about block_rows by hash; a block knows how many of a round's draws are its own
    (block_draws) and draws those among its rows, so rounds are sums that any executor can add up.
    """
    import pandas as pd

    blocks = max(1, -(-pairs.count() // block_rows))
    rows = pairs.select(F.xxhash64("query_id").alias("h"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).withColumn("block", F.pmod("h", F.lit(blocks)))
    sizes = np.zeros(blocks, np.int64)
    for r in rows.groupBy("block").count().collect():  # one number a block
        sizes[r["block"]] = r["count"]

    def draw(some: pd.DataFrame) -> pd.DataFrame:
        some, block = some.sort_values(["h", "a", "b"]), int(some["block"].iloc[0])
        d = (some["b"] - some["a"]).to_numpy(float)
        n = block_draws(sizes, block, rounds, seed)
        rng = np.random.default_rng([seed, block])
        return pd.DataFrame({"round": np.arange(rounds), "s": [d[rng.integers(0, len(d), k)].sum() for k in n], "w": n.astype(float)})

    means = rows.groupBy("block").applyInPandas(draw, "round long, s double, w double").groupBy("round").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    point = pairs.agg(F.avg(F.col("b") - F.col("a")).alias("mean_diff"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_b_better")).crossJoin(point)


def compare_arms(arms: DataFrame) -> DataFrame:
    """Each arm of an experiment against its control, the arm with most impressions: z, p, sample needed, whether it is there.

    arms: (base, variant, impressions, clicks). An experiment of one arm isn't compared.
    """
    control = arms.groupBy("base").agg(F.max(F.struct("impressions", "variant", "clicks")).alias("x"))
    both = arms.select("base", F.struct("impressions", "variant", "clicks").alias("y"))
    listed = both.join(control, "base").filter(F.col("x.variant") != F.col("y.variant"))
    x, y = F.col("x"), F.col("y")
    z, p = c.two_proportions(x["clicks"], x["impressions"], y["clicks"], y["impressions"])
    rate = F.when(x["clicks"] > 0, x["clicks"] / F.nullif(x["impressions"], F.lit(0))).otherwise(0.02)
    need = c.sample_size(rate)
    return listed.select("base", x["variant"].alias("control"), y["variant"].alias("variant"), z.alias("z"), p.alias("p"), need.alias("needed"), (F.least(x["impressions"], y["impressions"]) >= need).alias("enough"))


def gates(report: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(metric, value, floor, passed): no metric below its baseline less tolerance or its minimum; a missing one fails."""
    both = baseline.join(report, "metric", "left")
    floor = F.greatest(F.col("baseline") - tolerance, F.coalesce("minimum", F.col("baseline") - tolerance))
    return both.select("metric", "value", floor.alias("floor"), F.coalesce(F.col("value") >= floor, F.lit(False)).alias("passed"))


def nearest_rank(rows: DataFrame, value: str, share: float, by: list[str] = ()) -> DataFrame:
    """The value at index int(n * share) of the sorted values, not interpolated.

    Values are counted first. Where a key may have more distinct values than a task should
    sort, the counts are dealt out by ranges of the values; sums by range, a row a key and range,
    tell in which range the value stands, and only that one is looked through.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*by)
    place = lambda total: F.least(F.floor(total * share), total - 1)
    n = counts.count()
    if n <= RANGE_ROWS:
        placed = counts.withColumns({"__upto": F.sum("__n").over(over.orderBy("value")), "__at": place(F.sum("__n").over(over))})
        return placed.filter("__upto > __at").groupBy(*by).agg(F.min("value").alias("value"))
    dealt = durable(counts.repartitionByRange(min(RANGES, n // RANGE_ROWS + 1), "value").withColumn("__r", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "__r").agg(F.sum("__n").alias("__s"))
    upto = sums.withColumns({"__upto": F.sum("__s").over(over.orderBy("__r")), "__at": place(F.sum("__s").over(over))})
    here = upto.filter((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__s") <= F.col("__at"))).select(*by, "__r", (F.col("__at") - F.col("__upto") + F.col("__s")).alias("__left"))
    near = (dealt.join(here, [*by, "__r"]) if by else dealt.join(F.broadcast(here), "__r")).withColumn("__in", F.sum("__n").over(over.orderBy("value")))
    return near.filter(F.col("__in") > F.col("__left")).groupBy(*by).agg(F.min("value").alias("value"))
