"""Training, robustness and neighbours against brute force or closed forms on small frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loanstrata.operators import candidates, features, metrics, models, robustness
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sample(spark):
    """The usual modelling sample: 1,000 loans, one informative feature, one noise feature, one copy."""
    rng = np.random.default_rng(42)
    n = 1000
    rate, dti = rng.uniform(5, 25, n), rng.uniform(0, 40, n)
    chance = 1 / (1 + np.exp(-(0.2 * (rate - 15) + 0.02 * (dti - 20) - 1)))
    pdf = pd.DataFrame({"id": np.arange(n), "int_rate": rate, "dti": dti, "noise": rng.normal(size=n), "copy": rate * 2 + 0.1 * rng.normal(size=n),
                        "default_flag": (rng.random(n) < chance).astype(int), "issued": np.arange(n).astype(float),
                        "split": np.where(np.arange(n) < 600, "train", np.where(np.arange(n) < 800, "val", "test"))})
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.fixture(scope="module")
def frame(sample):
    return models.model_frame(sample[0], ["int_rate", "dti", "noise"], "default_flag", keep=["issued"], balanced=True)


def test_logit_table_matches_newton(sample):
    df, pdf = sample
    found = models.coefficient_table(df, ["int_rate", "dti"], "default_flag")
    x = np.column_stack([pdf.int_rate, pdf.dti, np.ones(len(pdf))])
    y, b = pdf.default_flag.to_numpy(), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    rows = {r["variable"]: r for r in found.table.collect()}
    for i, name in enumerate(["int_rate", "dti", "const"]):
        assert rows[name]["coefficient"] == pytest.approx(b[i], abs=1e-5)
        assert rows[name]["std_error"] == pytest.approx(se[i], rel=1e-3)
        assert rows[name]["odds_ratio"] == pytest.approx(np.exp(b[i]), rel=1e-4)
    p = 1 / (1 + np.exp(-x @ b))
    llf = np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    stats = {r["statistic"]: r["value"] for r in found.summary.collect()}
    assert stats["log_likelihood"] == pytest.approx(llf, abs=1e-4)
    assert stats["aic"] == pytest.approx(-2 * llf + 6, abs=1e-3)
    assert stats["llr_pvalue"] < 1e-6


def test_ols_table_matches_least_squares(sample):
    df, pdf = sample
    found = models.coefficient_table(df, ["int_rate", "noise"], "copy", "ols")
    x = np.column_stack([pdf.int_rate, pdf.noise, np.ones(len(pdf))])
    b, ssr, *_ = np.linalg.lstsq(x, pdf["copy"], rcond=None)
    rows = {r["variable"]: r for r in found.table.collect()}
    se = np.sqrt(ssr[0] / (len(pdf) - 3) * np.diag(np.linalg.inv(x.T @ x)))
    for i, name in enumerate(["int_rate", "noise", "const"]):
        assert rows[name]["coefficient"] == pytest.approx(b[i], abs=1e-6)
        assert rows[name]["ci_upper"] == pytest.approx(b[i] + 1.9623 * se[i], abs=1e-4)


def test_penalties_are_on_the_absolute_scale(spark):
    """Ridge and elastic net against their closed forms on one centred feature."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = 3 * x + 5 * rng.normal(size=400)
    x, y = x - x.mean(), y - y.mean()
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "split": "train", "x": x, "y": y}))
    built = models.model_frame(df, ["x"], "y")
    z = x / x.std(ddof=1)
    for name, alpha, mix in (("Ridge", 50.0, None), ("ElasticNet", 0.5, 0.5), ("Lasso", 0.7, 1.0)):
        made = next(c for c in candidates.EAD_CANDIDATES if c.name == name).with_params(alpha=alpha)
        got = models.fit(built, made).model.coefficients[0]
        n = len(z)
        if mix is None:
            want = (z @ y) / (z @ z + alpha)
        else:
            want = np.sign(z @ y) * max(abs(z @ y) / n - alpha * mix, 0) / (z @ z / n + alpha * (1 - mix))
        assert got == pytest.approx(want, rel=5e-3), name


def test_failed_candidate_is_kept(frame):
    broken = candidates.PD_CANDIDATES[3].with_params(max_depth=99)
    found = models.fit_all(frame, [broken, candidates.PD_CANDIDATES[0].with_params(max_iter=20)])
    entries = {r["model"]: r for r in models.classification_entries(frame, found, calibrated=False).collect()}
    assert entries["Decision Tree"]["status"] == "failed" and entries["Decision Tree"]["error"]
    assert entries["Logistic Regression L2"]["auc"] > 0.65


def test_tournament_refines_and_chooses(frame):
    pool = [candidates.PD_CANDIDATES[0].with_params(max_iter=20), candidates.PD_CANDIDATES[3].with_params(min_samples_leaf=20),
            candidates.PD_CANDIDATES[10]]
    found = models.pd_tournament(frame, pool, models.Settings(top_k=2, rounds=2, folds=2, draws=2), order="issued")
    board = found.leaderboard.orderBy("rank").collect()
    assert found.champion.name == board[0]["model"] and board[0]["auc"] > 0.65
    assert found.tiers.where("tier = 1").collect()[0]["feature"] == "int_rate"
    rounds = [r["round"] for r in found.trace.collect()]
    assert min(rounds) == 1 and max(rounds) <= 2


def test_halving_finds_what_the_full_search_finds(frame):
    base = next(c for c in candidates.PD_CANDIDATES if c.name == "Decision Tree")
    draws = [{"max_depth": d, "min_samples_leaf": leaf} for d, leaf in ((1, 250), (4, 10), (2, 240), (1, 200), (3, 20), (5, 150), (1, 100))]
    folded = models.pin(models.time_folds(frame, "issued", 4))
    plans = [models.SearchPlan("tree", base, frame.features, draws), models.SearchPlan("fixed", candidates.PD_CANDIDATES[10], frame.features, [{}])]
    best, rows = models.search_all(frame, folded, plans, models.Settings(folds=4), 1)
    full, every = models.search_all(frame, folded, plans, models.Settings(folds=4, halving=1), 1)
    assert best["tree"].params == full["tree"].params and best["fixed"] is not None
    assert len(every) == 4 * len(draws) and {r[1] for r in every} == {"tree"}
    # A draw that reaches a fold was judged on all earlier ones, and the race narrows by half.
    seen = {}
    for _, _, draw, fold, auc, _, _, _ in rows:
        seen.setdefault(draw, []).append(fold)
        assert 0 <= auc <= 1
    assert all(folds == list(range(1, len(folds) + 1)) for folds in seen.values())
    assert [sum(r[3] == f for r in rows) for f in (1, 2, 3, 4)] == [7, 4, 2, 2]
    assert [r[2] for r in rows if r[6]] == [draws.index({k: best["tree"].params[k] for k in draws[0]})]
    same = {(r[2], r[3]): r[4] for r in every}
    assert all(r[4] == same[r[2], r[3]] for r in rows)


def test_column_auc_equals_discrimination(spark):
    """Ties, nulls, NaN, a shared value and a model of one class, with and without pieces; a model without scores has no row."""
    rng = np.random.default_rng(5)
    n = 3000
    score = rng.normal(size=n)
    pdf = pd.DataFrame({"label": (rng.random(n) < 0.2).astype(float), "a": score.round(1), "b": np.where(rng.random(n) < 0.3, 0.5, score), "c": score})
    odd = F.when(F.col("c") > 1.5, float("nan")).when(F.col("c") > -1.5, F.col("c"))
    df = spark.createDataFrame(pdf).select("label", "a", "b", odd.alias("c"), F.lit(None).cast("double").alias("d")).repartition(5)
    for label in (F.col("label"), F.when(F.col("label") == 1, 1.0), F.when(F.col("a") > 0, F.col("label"))):
        rows = df.withColumn("label", label)
        long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(f"m#{c}").alias("model"), F.col(c).alias("score")) for c in "abcd"])).alias("_m"))
        want = {r["model"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in metrics.discrimination(long.select("label", "_m.*"), ["model"]).collect()}
        assert set(want) == {"m#a", "m#b", "m#c"}
        for task_rows, known in ((100_000, None), (170, None), (170, n)):
            got = metrics.column_auc(rows, {c: f"m#{c}" for c in "abcd"}, task_rows, known).collect()
            assert {r["model"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in got} == want
    assert metrics.column_auc(df.limit(0), {"a": "m"}).collect() == []


def test_judging_computes_each_score_once(spark, frame, monkeypatch):
    """Whatever the number of pieces, the models run once over the rows, and a limited score calls the vector function once."""
    made = [models.fit(frame, candidates.PD_CANDIDATES[0].with_params(max_iter=5), name=f"m{i}") for i in range(3)]
    plan = models.score(frame, made, 0.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(")[1]") == len(made)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = frame.data.where("split = 'val'")
    n = rows.count()
    monkeypatch.setattr(models.metrics, "column_auc", lambda scored, names, rows=None, real=metrics.column_auc: real(scored, names, 50, rows))
    got = models.judged(frame, made, rows.select("label", "features").mapInArrow(counted, rows.select("label", "features").schema), 2, n)
    assert read.value == n and set(got) == {"m0", "m1", "m2"}
    want = metrics.discrimination(models.score(frame, made, 0.0, 1.0, rows), ["model"]).collect()
    assert got == {r["model"]: r["auc"] for r in want}


def test_boosting_stops_early(frame):
    asked = next(c for c in candidates.PD_CANDIDATES if c.name.startswith("Gradient")).with_params(n_estimators=60, learning_rate=0.5)
    held, full = models.fit(frame, asked, stop_on="val"), models.fit(frame, asked)
    assert full.rounds == 60 and 1 <= held.rounds < 60
    part = models.fit(frame, asked, stop_on="stop")
    assert part.error is None and 1 <= part.rounds <= 60
    row = models.fit_table([held], frame.data.sparkSession).collect()[0]
    assert (row["trees_asked"], row["trees_kept"]) == (60, held.rounds)
    # The kept trees are those with the least validation error among the ones tried.
    loss = full.model.evaluateEachIteration(frame.data.where("split = 'val'"))
    assert loss[held.rounds - 1] == min(loss[:held.rounds])


def test_a_slow_fit_is_cancelled_and_the_others_go_on(frame):
    slow = next(c for c in candidates.PD_CANDIDATES if c.name.startswith("Gradient")).with_params(n_estimators=2000)
    quick = candidates.PD_CANDIDATES[0].with_params(max_iter=5)
    found = models.fit_all(frame, [slow, quick], workers=2, limit_s=8.0)
    assert [f.status for f in found] == ["failed", "trained"] and found[0].seconds < 30
    assert "cancel" in found[0].error.lower()
    assert models.fit(frame, quick).status == "trained"


def test_fits_run_in_pools_of_their_own(spark):
    seen = models.side_by_side(spark, lambda _: spark.sparkContext.getLocalProperty("spark.scheduler.pool"), list(range(4)), 2)
    assert all(p.startswith("fits-") for p in seen) and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_models_score_after_an_observed_query(spark, frame):
    from pyspark.sql import Observation
    seen = Observation()
    assert spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count() == 5 and seen.get == {"n": 5}
    small = lambda c: c.with_params(**{k: v for k, v in (("n_estimators", 3), ("max_iter", 5)) if k in c.params})
    fitted = models.fit_all(frame, [small(c) for c in candidates.PD_CANDIDATES], 8)
    assert {f.status for f in fitted} == {"trained"}
    assert models.score(frame, fitted).groupBy("model").count().count() == len(candidates.PD_CANDIDATES)
    fitted = models.fit_all(frame, [small(c) for c in candidates.EAD_CANDIDATES], 8)
    assert {f.status for f in fitted} == {"trained"}
    assert models.score(frame, fitted).groupBy("model").count().count() == len(candidates.EAD_CANDIDATES)


def test_time_folds_expand_in_order(frame):
    rows = models.time_folds(frame, "issued", 5).groupBy("fold").agg(
        F.min("issued").alias("lo"), F.max("issued").alias("hi"), F.count("*").alias("n")).orderBy("fold").collect()
    assert [r["n"] for r in rows] == [100] * 6
    assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))


def test_permutation_importance_finds_the_signal(frame, sample):
    fitted = models.fit(frame, candidates.PD_CANDIDATES[0].with_params(max_iter=50))
    rows = sample[0].where("split = 'test'").withColumn("label", F.col("default_flag"))
    found = {r["feature"]: r["importance"] for r in robustness.permutation_importance(frame, fitted, rows).collect()}
    assert found["int_rate"] > 0.1 > found["noise"] >= 0
    same = {r["feature"]: r["importance"] for r in robustness.permutation_importance(frame, fitted, rows).collect()}
    assert same == found


def test_partial_dependence_rises_with_the_rate(frame, sample):
    fitted = models.fit(frame, candidates.PD_CANDIDATES[0].with_params(max_iter=50))
    rows = sample[0].where("split = 'test'")
    trend = {r["feature"]: r["trend"] for r in robustness.dependence_trend(
        robustness.partial_dependence(frame, fitted, rows, ["int_rate"])).collect()}
    assert trend == {"int_rate": "increasing"}


def test_noise_zero_leaves_scores(frame, sample):
    fitted = models.fit(frame, candidates.PD_CANDIDATES[0].with_params(max_iter=50))
    rows = sample[0].where("split = 'test'")
    found = {r["level"]: r for r in robustness.noise_volatility(frame, fitted, rows, [0.0, 0.1]).collect()}
    plain = models.add_score(rows, frame, fitted).agg(F.avg("score").alias("m")).collect()[0]["m"]
    assert found[0.0]["mean_score"] == pytest.approx(plain, abs=1e-12)
    assert found[0.1]["mean_score"] != pytest.approx(plain, abs=1e-12)


def test_hashed_noise_is_standard_normal(spark):
    one = spark.range(20000).select(robustness.hashed_normal(F.col("id"), "a").alias("z")).agg(
        F.avg("z").alias("m"), F.stddev("z").alias("s")).collect()[0]
    assert abs(one["m"]) < 0.03 and abs(one["s"] - 1) < 0.03


def test_neighbours_match_brute_force_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    want = np.argsort(gap, axis=1)[:, :4]
    got = robustness.nearest_neighbours(df, ["a", "b", "c"], 4).toPandas()
    assert len(got) == 480
    for i, part in got.groupby("id"):
        assert list(part.sort_values("rank")["neighbour"]) == list(want[i])
    # Many small leaves: still k each, most of them the nearest.
    got = robustness.nearest_neighbours(df, ["a", "b", "c"], 4, 30, 12).toPandas()
    assert len(got) == 480
    hits = sum(len(set(part["neighbour"]) & set(want[i])) for i, part in got.groupby("id"))
    assert hits / 480 > 0.85


def test_smote_balances_between_neighbours(spark):
    rng = np.random.default_rng(9)
    n, m = 400, 15
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "y": np.arange(n) < m})
    pdf["y"] = pdf["y"].astype(int)
    df = spark.createDataFrame(pdf)
    out = robustness.smote(df, ["x"], "y", enabled=True).toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == n - m
    rare = pdf[pdf.y == 1].x
    made = out[out.synthetic]
    assert made.x.between(rare.min(), rare.max()).all()
    assert out.id.is_unique
    per = made.groupby("parent_id").size()
    assert len(per) == m and per.max() - per.min() <= 1
    assert robustness.smote(df, ["x"], "y", enabled=False).count() == n
    assert robustness.smote(df, ["x"], "y", enabled=True, below=0.01).count() == n


def test_selection_drops_the_weak_and_the_copy(sample):
    df, _ = sample
    found = features.select_features(df, ["int_rate", "copy", "dti", "noise"], "default_flag", threshold=0.05)
    stages = {r["feature"]: r["stage"] for r in found.log.collect()}
    assert ("int_rate" in found.selected) != ("copy" in found.selected)
    assert {"iv_filter", "correlation_filter"} >= set(stages.values())
    assert "noise" not in found.selected


def test_monotone_bins_are_monotone(sample):
    df, _ = sample
    cuts = features.monotone_cuts(df, ["int_rate", "dti"], "default_flag")
    rows = features.woe_rows(features.binned_events(df, "default_flag", cuts)).orderBy("feature", "bin").collect()
    for name in cuts:
        rates = [r["event_rate"] for r in rows if r["feature"] == name]
        assert rates in (sorted(rates), sorted(rates, reverse=True))
        assert min(r["count_pct"] for r in rows if r["feature"] == name) >= 0.05
    assert len(cuts["int_rate"]) >= 2


def best_grouping(counts, min_share):
    """The greatest information value over all ways to join neighbours."""
    total, bad = (sum(c[i] for c in counts) for i in (0, 1))
    best = (0.0, [len(counts) - 1])
    for mask in range(1, 1 << (len(counts) - 1)):
        ends = [i for i in range(len(counts) - 1) if mask >> i & 1] + [len(counts) - 1]
        groups = [[sum(c[i] for c in counts[a + 1:b + 1]) for i in (0, 1)] for a, b in zip([-1, *ends], ends)]
        rates = [e / n for n, e in groups]
        steps = {np.sign(b - a) for a, b in zip(rates, rates[1:])}
        if steps in ({1}, {-1}) and all(n >= min_share * total and 0 < e < n for n, e in groups):
            value = sum(((n - e) / (total - bad) - e / bad) * np.log((n - e) / (total - bad) / (e / bad)) for n, e in groups)
            best = max(best, (value, ends), key=lambda b: b[0])
    return best


def test_best_bins_match_a_search_over_all_groupings():
    rng = np.random.default_rng(11)
    for trial in range(60):
        n = rng.integers(1 if trial % 5 else 5, 40, 8)
        counts = [(int(a), int(rng.binomial(a, min(0.9, max(0.03, 0.3 + 0.04 * k * (trial % 3 - 1)))))) for k, a in enumerate(n)]
        for share in (0.05, 0.15):
            want, got = best_grouping(counts, share), features.best_bins(counts, share)
            total, bad = (sum(c[i] for c in counts) for i in (0, 1))
            value = 0.0
            for a, b in zip([-1, *got], got):
                m, e = (sum(c[i] for c in counts[a + 1:b + 1]) for i in (0, 1))
                if len(got) > 1:
                    value += ((m - e) / (total - bad) - e / bad) * np.log((m - e) / (total - bad) / (e / bad))
            assert got[-1] == 7 and value == pytest.approx(want[0], abs=1e-12), (counts, got, want)
    assert features.best_bins([], 0.05) == [] and features.best_bins([(5, 0), (4, 0)], 0.05) == [1]


def test_optimal_bins_are_monotone_and_never_below_the_greedy_ones(sample):
    df, _ = sample
    names = ["int_rate", "dti", "noise"]
    value = lambda cuts: {r["feature"]: r["iv"] for r in features.information_values(features.binned_events(df, "default_flag", cuts)).collect()}
    best, greedy = features.optimal_cuts(df, names, "default_flag", 20), features.monotone_cuts(df, names, "default_flag", 20)
    high, low = value(best), value(greedy)
    assert all(high[n] >= low[n] - 1e-12 for n in names) and any(high[n] > low[n] + 1e-6 for n in names)
    rows = features.woe_rows(features.binned_events(df, "default_flag", best)).orderBy("feature", "bin").collect()
    for name in names:
        rates = [r["event_rate"] for r in rows if r["feature"] == name]
        assert rates in (sorted(set(rates)), sorted(set(rates), reverse=True))
        assert min(r["count_pct"] for r in rows if r["feature"] == name) >= 0.05


def test_vif_matches_regressions(sample):
    df, pdf = sample
    cols = ["int_rate", "dti", "noise"]
    x = pdf[cols].to_numpy()
    got = {r["feature"]: r["vif"] for r in features.variance_inflation(df, cols).collect()}
    for i, c in enumerate(cols):
        rest = np.delete(x, i, axis=1)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[c] == pytest.approx((x[:, i] @ x[:, i]) / ((x[:, i] - fit) @ (x[:, i] - fit)), rel=1e-6)


def test_many_correlations_take_the_matrix_path(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 22))
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(22)])
    pdf.loc[::7, "c3"] = None
    got = features.correlation_pairs(spark.createDataFrame(pdf), list(pdf.columns)).toPandas()
    want = pdf.corr()
    assert len(got) == 22 * 21 // 2
    assert all(abs(r.r - want.loc[r.feature_1, r.feature_2]) < 1e-9 for r in got.itertuples())


def test_null_features_are_filled_at_fit_and_score(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "split": np.where(np.arange(n) < 200, "train", "test"), "x": x, "y": (x > 0).astype(int)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("id") % 10 != 3, F.col("x")))
    frame = models.model_frame(df, ["x"], "y")
    assert frame.data.count() == n and frame.train_rows == 200
    fitted = models.fit(frame, candidates.PD_CANDIDATES[0])
    assert fitted.error is None
    scored = models.add_score(df, frame, fitted)
    assert scored.columns == [*df.columns, "score"] and scored.where("score IS NULL").count() == 0
