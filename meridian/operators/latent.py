"""Reduced document vectors: TF-IDF rows and their truncated singular value decomposition, by randomised range finding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .resolution import durable

#: Fixed values of the domain: terms at least, components, random columns beyond them, power steps.
MAX_FEATURES, COMPONENTS, OVERSAMPLE, POWER = 20_000, 128, 10, 5
#: Rows of a sum of sparse products that travel together, how many tasks' sums meet at a time, tasks of a product at most (each hands on a matrix as large as the basis).
BAND, FAN, TASKS = 256, 32, 2000

_FOLD = str.maketrans(c.ACCENTED, c.PLAIN)
_WORD = re.compile("[a-z0-9]+")


def _terms(text: str | None) -> list[str]:
    return [w for w in _WORD.findall((text or "").lower().translate(_FOLD)) if len(w) > 2 and w not in c.STOPWORDS]


def slices(batches: Iterator[pd.DataFrame], size: int = 256) -> Iterator[pd.DataFrame]:
    """Batches of texts in slices, so that what is made of them isn't held for a whole batch."""
    for b in batches:
        for k in range(0, len(b), size):
            yield b.iloc[k : k + size]


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): how often each term stands in each document, counted inside the documents' tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            rows = [(k, term, n) for k, t in zip(b[key], b[text], strict=True) for term, n in Counter(_terms(t)).items()]
            yield pd.DataFrame(rows, columns=[key, "term", "tf"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, term string, tf long")


def tf_idf(docs: DataFrame, key: str, text: str, min_df: int = 3, max_df: float = 0.5) -> DataFrame:
    """(key, term, weight): sublinear tf times smoothed idf, unit length, of terms in at least min_df and at most a share max_df of the documents."""
    tf = term_counts(docs, key, text)
    total = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
    raw = tf.join(df, "term").withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    whole = raw.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("l"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return whole.select(key, "len", F.explode("l").alias("e")).select(key, F.col("e.term").alias("term"), (F.col("e.w") / F.col("len")).alias("weight"))


def sparse_rows(docs: DataFrame, key: str, text: str, min_df: int = 3, max_df: float = 0.5, max_features: int = MAX_FEATURES) -> tuple[DataFrame, int]:
    """((key, places, weights), columns): each document's TF-IDF row of unit length over the max_features commonest terms, and how many there are.

    The vocabulary is bounded by max_features, so the driver and each task hold it.
    """
    n = docs.count()
    counts = term_counts(docs, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    known = counts.filter((F.col("df") >= min_df) & (F.col("df") <= n * max_df)).orderBy(F.desc("all"), "term").limit(max_features).collect()
    place = {r.term: i for i, r in enumerate(sorted(known, key=lambda r: r.term))}
    idf = np.zeros(len(place))
    for r in known:
        idf[place[r.term]] = np.log((1 + n) / (1 + r.df)) + 1
    sent = docs.sparkSession.sparkContext.broadcast((place, idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, idf = sent.value
        for b in slices(batches):
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                found = sorted((place[w], n) for w, n in Counter(_terms(t)).items() if w in place)
                at, tf = np.array([p for p, _ in found], np.int32), np.array([n for _, n in found], float)
                weight = (1 + np.log(tf)) * idf[at] if len(at) else tf
                rows.append((k, at, weight / np.linalg.norm(weight) if len(at) else weight))
            yield pd.DataFrame(rows, columns=[key, "places", "weights"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, places array<int>, weights array<double>"), len(place)


def _times(batch: pd.DataFrame, basis: np.ndarray) -> np.ndarray:
    """The batch's sparse rows times a basis (columns by components)."""
    out = np.zeros((len(batch), basis.shape[1]))
    for i, (at, w) in enumerate(zip(batch["places"], batch["weights"], strict=True)):
        if len(at):
            out[i] = w @ basis[at]
    return out


def _gram_step(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """X'X times the basis. Each task adds up its own documents; bands of the sums meet FAN tasks at a time, and one matrix as large as the basis comes back."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    tasks = min(TASKS, rows.rdd.getNumPartitions())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(sent.value)
        for b in batches:
            for at, w, z in zip(b["places"], b["weights"], _times(b, sent.value), strict=True):
                total[at] += w[:, None] * z  # the places of a row differ
        met = [k for k in range(0, len(total), BAND) if total[k : k + BAND].any()]
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "band": met, "sums": [total[k : k + BAND].tobytes() for k in met]})

    def add(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("part")
        total = np.frombuffer(some["sums"].iloc[0]).copy()
        for raw in some["sums"].iloc[1:]:
            total += np.frombuffer(raw)
        return pd.DataFrame({"part": [some["part"].iloc[0] // FAN], "band": [some["band"].iloc[0]], "sums": [total.tobytes()]})

    sums = rows.select("places", "weights").coalesce(tasks).mapInPandas(run, "part long, band long, sums binary")
    while tasks > 1:
        sums = sums.groupBy("band", F.floor(F.col("part") / FAN)).applyInPandas(add, "part long, band long, sums binary")
        tasks = -(-tasks // FAN)
    out = np.zeros_like(basis)
    for r in sums.collect():
        band = np.frombuffer(bytes(r.sums)).reshape(-1, basis.shape[1])
        out[r.band : r.band + len(band)] = band
    return out


def principal_directions(rows: DataFrame, columns: int, components: int = COMPONENTS, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, directions: columns by components) of sparse rows (places, weights), largest first.

    Randomised: random columns are drawn towards the leading right singular
    vectors by power steps with X'X, orthonormal after each, and the small Gram
    matrix of the rows in that basis is solved exactly. All that the driver holds
    is as large as the basis, columns by components + oversample.
    """
    k = min(components, columns)
    wide = min(columns, k + oversample)
    if not wide:
        return np.zeros(0), np.zeros((columns, 0))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, wide)))[0]
    for _ in range(power):
        basis = np.linalg.qr(_gram_step(rows, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ _gram_step(rows, basis))
    order = np.argsort(-values)[:k]
    found = basis @ turn[:, order]
    found *= np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])  # a direction's largest place is positive
    return np.sqrt(np.maximum(values[order], 0)), found


def reduced_vectors(docs: DataFrame, key: str, text: str, components: int = COMPONENTS, min_df: int = 3, max_df: float = 0.5, max_features: int = MAX_FEATURES, power: int = POWER, seed: int = 0) -> DataFrame:
    """(key, vector, kept): each document along the leading directions of all TF-IDF rows, at unit length, and what length was kept of 1; documents without a known term have zeros."""
    rows, columns = sparse_rows(docs, key, text, min_df, max_df, max_features)
    rows = durable(rows)
    _, directions = principal_directions(rows, columns, components, power=power, seed=seed)
    sent = docs.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = _times(b, sent.value)
            kept = np.linalg.norm(z, axis=1)
            unit = np.divide(z, kept[:, None], out=np.zeros_like(z), where=kept[:, None] > 1e-12)
            yield pd.DataFrame({key: b[key], "vector": list(unit), "kept": kept})

    return rows.mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, vector array<double>, kept double")
