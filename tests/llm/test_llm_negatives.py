"""Hard negatives against all pairs, on ties, hot vectors and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanstrata.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_mine(rows, positives=5, top=5, low=80, scale=256):
    """All scores of all anchors, in Python's integers."""
    kept = [(i, lab, [math.floor(scale * x) for x in e]) for i, e, lab in rows
            if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, la, ea in {(i, lab, tuple(e)) for i, lab, e in kept if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(ea, e)), i, lab) for i, lab, e in kept if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:positives]:
            near = [s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:top]
            out += [(a, p, r, s[1], -ps, -s[0]) for r, s in enumerate(near, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.mine(df).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def odd_vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(420, 20)) * 0.2
    x[150:290] = x[100]  # a third of the rows hold one vector, among them anchors
    x[300:330] = np.round(x[300:330], 1)
    x[5] = 0
    rows = [(i, x[i].tolist(), int(i % 4)) for i in range(420)]
    return rows + [
        (500, None, 1), (600, [], 1), (601, [], 2), (602, [None] * 20, 1), (603, [float("nan")] * 20, 1), (604, [float("inf")] * 20, 1),
        (700, x[3].tolist(), None), (800, x[3][:7].tolist(), 2), (801, [*x[3].tolist(), 9.0, 9.0], 2), (None, x[3].tolist(), 1),
        (12, x[12].tolist(), 0), (12, x[12].tolist(), 0), (200, x[200].tolist(), 0), (200, x[9].tolist(), 3), (900, (-x[3]).tolist(), 1)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 20)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "block", "kind", "targets", "copies", "score")})
    want = plain_mine(rows)
    assert len(want) > 40 and mined(df) == want


def test_defined_on_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1), (None, None, None)], SCHEMA)) == []


def test_join_lists_fewer_dimensions_and_loses_nothing():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(3000, 64)) * 0.3 ** np.arange(64).clip(0, 8)[None, ::-1])
    index = negatives.Index(np.arange(3000), np.zeros(3000, int), x)
    q = index.cut(x[:30])
    rest = index.remaining(q, 30)
    for least in (1e9, 2e5, 4e4, 0.0, -1e6):
        a, b, score = index.join(q, rest, np.full(30, least), np.arange(3000))
        full = x[:30] @ x.T
        assert sorted(zip(a, b)) == sorted(zip(*np.nonzero(full >= least)))
        assert (score == full[a, b]).all()
