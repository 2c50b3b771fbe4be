"""Reduced vectors against a whole decomposition by numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from meridian.operators import latent


def corpus(n=120):
    rng = random.Random(3)
    topics = [[f"{t}word{i}" for i in range(14)] for t in ("sea", "food", "temple", "market")]
    out = []
    for k in range(n):
        own = topics[k % 4] + topics[(k * 7) % 4][:3]
        out.append((k, " ".join(rng.choice(own) for _ in range(rng.randrange(5, 60))) + (" the Café of é" if k % 5 == 0 else "")))
    return out + [(n, None), (n + 1, ""), (n + 2, "nothing known here"), (n + 3, out[0][1]), (n + 3, out[0][1])]


def dense(docs, max_features=20_000, min_df=3, max_df=0.5):
    """Rows of unit length over the commonest terms."""
    words = [Counter(latent._terms(t)) for _, t in docs]
    df, total = Counter(w for c in words for w in c), Counter()
    for c in words:
        total.update(c)
    n = len(docs)
    vocab = sorted(sorted((w for w in df if min_df <= df[w] <= n * max_df), key=lambda w: (-total[w], w))[:max_features])
    x = np.array([[(1 + math.log(c[w])) * (math.log((1 + n) / (1 + df[w])) + 1) if w in c else 0.0 for w in vocab] for c in words])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize("fan,band,features", [(32, 256, 20_000), (2, 5, 14)])
def test_directions_equal_the_whole_decomposition(spark, monkeypatch, fan, band, features):
    monkeypatch.setattr(latent, "FAN", fan)
    monkeypatch.setattr(latent, "BAND", band)
    docs = corpus()
    x = dense(docs, features)
    df = spark.createDataFrame(docs, "id long, text string").repartition(5)
    rows, columns = latent.sparse_rows(df, "id", "text", max_features=features)
    assert columns == x.shape[1]
    values, directions = latent.principal_directions(latent.durable(rows), columns, 8)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    exact = columns <= 18  # as many random columns as there are: nothing is left to chance
    assert values == pytest.approx(s[:8], rel=1e-9 if exact else 1e-3) and values[:4] == pytest.approx(s[:4], rel=1e-6)
    assert np.abs(np.sum(directions[:, :4] * vt[:4].T, axis=0)) == pytest.approx(np.ones(4), abs=1e-6)
    if not exact:
        return
    got = {}
    for r in latent.reduced_vectors(df, "id", "text", components=8, max_features=features).collect():
        got.setdefault(r.id, (np.array(r.vector), r.kept))
    whole = x @ vt[:8].T
    for (i, _), z in zip(docs, whole, strict=True):
        vector, kept = got[i]
        assert kept == pytest.approx(np.linalg.norm(z), abs=1e-5)
        for (j, _), y in zip(docs[:20], whole[:20], strict=True):
            want = z @ y / (np.linalg.norm(z) * np.linalg.norm(y)) if np.linalg.norm(z) > 1e-9 else 0
            assert vector @ got[j][0] == pytest.approx(want, abs=1e-4)


def test_no_documents_and_no_terms(spark):
    df = spark.createDataFrame([(1, "one"), (2, None)], "id long, text string")
    assert [(r.vector, r.kept) for r in latent.reduced_vectors(df, "id", "text").collect()] == [([], 0.0), ([], 0.0)]
    assert latent.reduced_vectors(df.limit(0), "id", "text").count() == 0


def test_texts_are_taken_in_slices():
    import pandas as pd

    from meridian.operators import latent

    batch = pd.DataFrame({"id": range(1000), "text": ["a"] * 1000})
    parts = list(latent.slices(iter([batch, batch[:0], batch[:5]])))
    assert max(map(len, parts)) <= 256 and pd.concat(parts)["id"].tolist() == [*range(1000), *range(5)]
