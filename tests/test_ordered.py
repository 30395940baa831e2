"""The scale path of every ordered operator must give what the one-task path gives, hot values included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loanstrata.functions.ordered import quantiles, ranked_groups, value_totals
from loanstrata.operators import metrics
from pyspark.sql import functions as F

TINY = 40


@pytest.fixture(scope="module")
def frame(spark):
    """Two groups; a third of all rows share one score, the rest are continuous or coarse."""
    rng = np.random.default_rng(3)
    n = 900
    score = np.where(np.arange(n) % 3 == 0, 0.5, np.where(np.arange(n) % 3 == 1, rng.random(n), np.round(rng.random(n), 1)))
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": np.where(np.arange(n) < 700, "a", "b"), "score": score,
                        "label": (rng.random(n) < 0.3).astype(int)})
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


def test_quantiles_match_numpy_on_both_paths(frame):
    df, pdf = frame
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for rows in (10_000, TINY):
        found = {r["g"]: r["q"] for r in quantiles(df, ["score"], probs, ["g"], rows).collect()}
        for g, part in pdf.groupby("g"):
            assert np.allclose(found[g], np.quantile(part["score"], probs), atol=1e-12)


def test_running_totals_match_a_sort(frame):
    df, pdf = frame
    out = value_totals(df, ["g"], "score", {"n": F.count(F.lit(1)), "pos": F.sum("label")}, TINY).toPandas()
    assert len(out) == pdf.groupby(["g", "score"]).ngroups
    for g, part in pdf.groupby("g"):
        want = part.groupby("score")["label"].agg(["count", "sum"]).sort_index()
        got = out[out.g == g].set_index("score").sort_index()
        assert (got["n_before"] == want["count"].cumsum() - want["count"]).all()
        assert (got["pos_before"] == want["sum"].cumsum() - want["sum"]).all()
        assert (got["n_all"] == len(part)).all()


@pytest.mark.parametrize("groups", [3, 7, 10])
def test_equal_groups_match_ntile(frame, groups):
    df, pdf = frame
    one = ranked_groups(df, ["g"], "score", "id", groups, 10_000).select("id", "bucket").toPandas()
    many = ranked_groups(df, ["g"], "score", "id", groups, TINY).select("id", "bucket").toPandas()
    both = one.merge(many, on="id")
    assert len(both) == len(pdf)
    assert (both.bucket_x == both.bucket_y).all()


def test_more_groups_than_rows(spark):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(4)], "id long, g string, score double")
    one = ranked_groups(df, ["g"], "score", "id", 10, 100).orderBy("id").collect()
    many = ranked_groups(df, ["g"], "score", "id", 10, 2).orderBy("id").collect()
    assert [r["bucket"] for r in one] == [r["bucket"] for r in many] == [1, 2, 3, 4]


def test_metrics_do_not_depend_on_the_path(frame):
    df, pdf = frame
    for name in ("discrimination", "hosmer_lemeshow"):
        f = getattr(metrics, name)
        a = f(df, ["g"], task_rows=10_000).orderBy("g").toPandas()
        b = f(df, ["g"], task_rows=TINY).orderBy("g").toPandas()
        pd.testing.assert_frame_equal(a, b)
    found = {r["g"]: r for r in metrics.discrimination(df, ["g"], TINY).collect()}
    for g, part in pdf.groupby("g"):
        pos, neg = part[part.label == 1].score.values, part[part.label == 0].score.values
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert found[g]["auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def test_cut_points_are_joined_when_groups_are_many(frame, monkeypatch):
    df, pdf = frame
    monkeypatch.setattr("loanstrata.functions.ordered.small_table", lambda *a, **k: None)
    out = value_totals(df, ["g"], "score", {"n": F.count(F.lit(1))}, TINY).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.groupby("score").size().sort_index().cumsum()
        got = out[out.g == g].set_index("score").sort_index()
        assert (got["n_before"] + got["n"] == want).all()


def test_one_class_is_undecided(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")
    row = metrics.discrimination(df, []).collect()[0]
    assert (row["auc"], row["ks"], row["ks_pvalue"]) == (0.5, 0.0, None)


def test_equal_groups_with_nulls_nan_and_text_ids(spark):
    rng = np.random.default_rng(11)
    n = 700
    score = np.where(rng.random(n) < 0.25, None, np.where(rng.random(n) < 0.05, np.nan, np.round(rng.random(n), 1)))
    rows = [(f"L{i}", "ab"[i % 3 == 0], None if s is None else float(s)) for i, s in enumerate(score)]
    df = spark.createDataFrame(rows, "id string, g string, score double").repartition(4)
    order = lambda r: (r[2] is not None, r[2] is not None and np.isnan(r[2]), 0.0 if r[2] is None or np.isnan(r[2]) else r[2], r[0])
    want = {}
    for g in "ab":
        part = sorted((r for r in rows if r[1] == g), key=order)
        for bucket, ids in enumerate(np.array_split([r[0] for r in part], 10), 1):
            want.update({i: bucket for i in ids})
    for size in (None, 10_000, TINY):
        got = {r["id"]: r["bucket"] for r in ranked_groups(df, ["g"], "score", "id", 10, *([size, n] if size else [])).collect()}
        assert got == want


def test_correlation_survives_constant_and_odd_columns(spark):
    from loanstrata.operators import features
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, float("nan")), (3.0, 5.9, 5.0, float("inf")), (4.0, 8.0, 5.0, 1.0)],
                               "a double, b double, c double, d double")
    got = {(r["feature_1"], r["feature_2"]): r["r"] for r in features.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4.1, 5.9, 8])[0, 1])
    assert all(r is None for pair, r in got.items() if pair != ("a", "b")) and len(got) == 6
    assert [r["feature_1"] for r in features.flagged_pairs(features.correlation_pairs(df, ["a", "b", "c", "d"])).collect()] == ["a"]


def test_quantiles_beyond_one_task_are_selected_without_sorting_the_values(spark, monkeypatch):
    """Ties, infinities, NaN, a null group and an empty column; the values themselves must not be put in order."""
    from loanstrata.functions import ordered

    rng = np.random.default_rng(8)
    n = 6000
    x = np.where(np.arange(n) % 4 == 0, 7.0, rng.normal(size=n))
    x[:3] = np.inf, -np.inf, -0.0
    y = np.where(np.arange(n) % 5 == 0, np.nan, np.round(rng.random(n), 2))
    rows = [(["a", "b", None][i % 3], float(x[i]), None if i % 7 == 0 else float(y[i]), None) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5).cache()
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.99, 1.0]
    small = {(r["g"], r["feature"]): r["q"] for r in quantiles(df, ["x", "y", "z"], probs, ["g"], n).collect()}
    whole = {r["feature"]: r["q"] for r in quantiles(df, ["x", "y", "z"], probs, None, n).collect()}

    def refuse(*args, **named):
        raise AssertionError("the values were put in order")

    monkeypatch.setattr(ordered, "value_totals", refuse)
    for accuracy in (10_000, 40):
        monkeypatch.setattr(ordered, "BRACKET_ACCURACY", accuracy)
        found = {(r["g"], r["feature"]): r["q"] for r in quantiles(df, ["x", "y", "z"], probs, ["g"], n - 1).collect()}
        assert found.keys() == small.keys() and len(found) == 6
        assert all(np.allclose(found[k], small[k], atol=1e-12, equal_nan=True) for k in small)
        found = {r["feature"]: r["q"] for r in quantiles(df, ["x", "y", "z"], probs, None, n - 1).collect()}
        assert found.keys() == whole.keys()
        assert all(np.allclose(found[k], whole[k], atol=1e-12, equal_nan=True) for k in whole)


def test_running_totals_beyond_one_task_make_their_input_twice_at_most(spark):
    """Once for the cut points and once for the sums."""
    made = spark.sparkContext.accumulator(0)

    def score(i):
        made.add(1)
        return i % 50 / 50

    df = spark.range(400).repartition(3).select(F.udf(score, "double")("id").alias("score"))
    out = value_totals(df, [], "score", {"n": F.count(F.lit(1))}, TINY, 400).toPandas()
    assert len(out) == 50 and (out["n_all"] == 400).all() and sorted(out["n_before"]) == list(range(0, 400, 8))
    assert made.value <= 800
