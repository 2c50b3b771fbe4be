"""Quality rules: a decision list learned from labelled document statistics.

Sequential covering: grow a conjunction of thresholds by FOIL gain on two thirds
of the labelled rows, prune its last conditions on the other third, keep it if it
is precise there, take away what it covers, and go on. The list becomes one
ordered Spark conditional expression.

Defined cases: null and blank texts have no words and fail the base rule. Labels
that are null or name no document don't count; a document with several labels
counts once for each. With no label of one of the two classes the list is empty
and keeps all that the base rule keeps. Rows that repeat a doc_id are each
reported. Extra columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: The most labelled rows that a fit takes (those with the least hash of their id).
SAMPLE = 20_000
#: A rule must be this precise on the pruning rows, and cover this many of the growing rows.
PRECISION, LEAST = 0.8, 8
MAX_RULES, MAX_CONDITIONS, CUTS = 16, 4, 64

_SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    ws = text.split()
    n = len(ws)
    raw = np.frombuffer(b"".join(ws), np.uint8)
    chars = int(np.count_nonzero(raw & 0xC0 != 0x80))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()]
    repeat = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in ws], np.int64)
        pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, which, times = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = np.r_[times[which] > 1, False, False]
        repeat = int((twice | np.r_[False, twice[:-1]] | np.r_[False, False, twice[:-2]]).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, counts): text_key tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([counts(t) for t in b.column(2).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, k]) for k in range(5))], ["doc_id", "text_key", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, by: dict[str, Column]) -> Column:
        return by[self.feature] > self.threshold if self.above else by[self.feature] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction; a document that one covers is rejected, others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        by, out = features(), None
        for rule in self.rules:
            hit = rule[0].column(by)
            for c in rule[1:]:
                hit = hit & c.column(by)
            out = F.when(hit, False) if out is None else out.when(hit, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def describe(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in self.rules) or "keep all"


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    on = np.ones(n, bool)
    for c in rule:
        on &= c.mask(x)
    return on


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (on & ~bad).any():
        p, n = (on & bad).sum(), (on & ~bad).sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for name in x:
            cuts = np.unique(np.quantile(x[name][on & bad], np.linspace(0, 1, CUTS)))
            cuts = np.unique(np.r_[cuts, np.quantile(x[name][on & ~bad], np.linspace(0, 1, CUTS))])
            sb, sg = np.sort(x[name][on & bad]), np.sort(x[name][on & ~bad])
            pb, pg = np.searchsorted(sb, cuts, "right"), np.searchsorted(sg, cuts, "right")
            for above, pos, neg in ((False, pb, pg), (True, p - pb, n - pg)):
                ok = pos >= LEAST
                gain = np.where(ok, pos * (np.log2(np.maximum(pos, 1) / np.maximum(pos + neg, 1)) - np.log2(p / (p + n))), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].mask(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """Rules for the rows marked bad, by sequential covering; every third row prunes."""
    rules: list[tuple[Condition, ...]] = []
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, check = left & ~prune, left & prune
        if (grow & bad).sum() < LEAST or not (grow & ~bad).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break

        def worth(r: list[Condition], check=check) -> float:
            on = _covered(r, x, len(bad)) & check
            p, n = (on & bad).sum(), (on & ~bad).sum()
            return (p - n) / max(p + n, 1)

        best = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (round(worth(r), 9), -len(r)))
        on = _covered(best, x, len(bad)) & check
        if (on & bad).sum() < PRECISION * max(on.sum(), 1) or not on.any():
            break
        rules.append(tuple(best))
        left &= ~_covered(best, x, len(bad))
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learn what `quality` 0 looks like among documents that the base rule keeps, from at most `sample` labelled rows."""
    marked = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("__l"), (F.col("quality") == 0).alias("bad"))
    rows = stats.filter(~base_failed()).join(marked, F.col("doc_id") == F.col("__l"))
    by = features()
    order = F.xxhash64("doc_id")
    n = rows.count()
    share = 2 * sample / max(n, 1)  # the least hashes are in the first share, twice what is asked for: tasks needn't each send a whole sample
    near = rows if share >= 1 else rows.filter(order <= int((share - 0.5) * 2.0**64))

    def least(some: DataFrame) -> pd.DataFrame:
        return some.select(*[c.alias(k) for k, c in by.items()], "bad", "doc_id", "text_key").orderBy(order, "doc_id", "text_key", "bad").limit(sample).toPandas()

    got = least(near)
    if len(got) < min(sample, n):  # rows that repeat a doc_id share a hash
        got = least(rows)
    return learn({k: got[k].to_numpy(float) for k in by}, got["bad"].to_numpy(bool))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_key, counts, base_failed, kept) for every row."""
    stats = cut(statistics(docs), "rules")
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fit(stats, labels, sample).kept())


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the rules keep."""
    verdict = judge(docs, labels, sample).filter("kept").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    return docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left_semi")
