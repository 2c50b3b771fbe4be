"""Which of op7's groups are split string by string, and the order of suffixes in a group."""

import random

import numpy as np
import pytest

from meridian.llm import suffixdedup


def _texts():
    """Texts of their own words around one passage: its 16-grams are in every batch, in few bytes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = " ".join(word() for _ in range(4))
    return [(i, " ".join(word() for _ in range(60)) + passage + " ".join(word() for _ in range(60))) for i in range(80)]


def _kept(docs, width=50):
    known, out = {}, {}
    for d, t in docs:
        cover = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if known.setdefault(t[p : p + width], d) < d:
                cover[p : p + width] = b"\1" * width
        out[d] = bytes(c for c, g in zip(t.encode(), cover, strict=True) if not g)
    return out


def _dealt(plan, name):
    """Rows that the exchanges of a plan dealt out, those after `name` operators."""
    kids = plan.children()
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() and name in plan.toString() else 0) + sum(_dealt(kids.apply(i), name) for i in range(kids.size()))


def test_strings_that_many_batches_have_in_few_bytes_are_not_split(spark):
    docs = _texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = suffixdedup.dedup_substrings(df, fan=2, batch=3000)
        assert {r.doc_id: bytes(r.kept) for r in got.collect()} == _kept(docs)
        rows = _dealt(got._jdf.queryExecution().executedPlan(), "FlatMapGroupsInArrow")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert rows < 400


@pytest.mark.parametrize("crowd", [0, 300, 1 << 20])
def test_every_crowd_gives_the_same_texts(spark, crowd):
    docs = _texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffixdedup.dedup_substrings(df, fan=3, batch=3000, crowd=crowd)
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == _kept(docs)


@pytest.mark.parametrize("width", [16, 24, 50])
def test_suffix_order_equals_plain_sorting(width):
    rng = np.random.default_rng(width)
    for k in range(20):
        data = rng.choice(np.array([0, 9, 255], np.uint8)[: 1 + k % 3], 200)
        places = np.flatnonzero(rng.random(len(data) - width + 1) < 0.5)
        doc, text = rng.integers(0, 5, len(places)), data.tobytes()
        cut = [text[p : p + width] for p in places]
        order, lcp = suffixdedup.suffix_order(data, places, doc, width)
        want = sorted(range(len(places)), key=lambda i: (cut[i], doc[i]))  # noqa: B023
        assert [(cut[i], doc[i]) for i in order] == [(cut[i], doc[i]) for i in want]
        shared = lambda a, b: next((i for i in range(width) if a[i] != b[i]), width)  # noqa: B023, E731
        assert lcp.tolist() == [0, *(shared(cut[a], cut[b]) for a, b in zip(want, want[1:], strict=False))][: len(want)]
