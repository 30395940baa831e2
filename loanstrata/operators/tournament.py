"""Ranking of candidate models from result tables.

Inputs are result tables: one row per candidate (or per candidate and feature, metric or round), so their size is the
number of candidates tried. Windows over the whole table therefore sort a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanstrata.functions.text import clip
from loanstrata.operators.metrics import rank_correlation
from loanstrata.operators.profile import struct_rows
from loanstrata.session import attach

# The weight of each metric under every named rubric.
RUBRICS = {
    "pd_regulatory": {"auc": 0.20, "gini": 0.15, "ks": 0.15, "brier": 0.10, "hl_pvalue": 0.10, "psi": 0.10,
                      "interpretability": 0.10, "generalization": 0.05, "efficiency": 0.05},
    "pd_performance": {"auc": 0.35, "gini": 0.20, "ks": 0.15, "brier": 0.05, "hl_pvalue": 0.00, "psi": 0.05,
                       "interpretability": 0.00, "generalization": 0.10, "efficiency": 0.10},
    "engine_performance": {"auc": 0.35, "gini": 0.20, "ks": 0.15, "brier": 0.10, "generalization": 0.10,
                           "efficiency": 0.10},
    "regression": {"rmse": 0.30, "mae": 0.15, "r2": 0.20, "psi": 0.10, "decile": 0.10, "generalization": 0.10,
                   "efficiency": 0.05},
    "mode_regulatory": {"auc": 0.15, "accuracy": 0.10, "interpretability": 0.25, "stability": 0.15,
                        "regulatory_compliance": 0.20, "gini": 0.10, "psi": 0.05},
    "mode_performance": {"auc": 0.30, "accuracy": 0.20, "precision": 0.15, "recall": 0.15, "f1": 0.10,
                         "interpretability": 0.05, "stability": 0.05},
}
RANGED = ("auc", "gini", "ks", "brier", "hl_pvalue", "rmse", "mae", "r2")
LOWER_BETTER = ("brier", "rmse", "mae")
LINEAR_LIBRARIES = ("sklearn", "statsmodels")
RADAR_METRICS = ("auc", "accuracy", "precision", "recall", "f1")
# Settings of the refinement: candidates kept, rounds, smallest useful gain, largest gap to the leader.
TOP_K, MAX_ROUNDS, MIN_GAIN, PRUNE_GAP = 5, 5, 0.002, 0.03


def over_all(value: Column) -> Column:
    """An aggregate over the whole result table, next to every row."""
    return value.over(Window.partitionBy())


def leaderboard(entries: DataFrame, metric: str = "auc", lower_better: bool = False) -> DataFrame:
    """Best first; failed candidates stay in the table without a rank."""
    trained = F.col("status") == "trained"
    value = F.col(metric) * (-1 if lower_better else 1)
    order = Window.partitionBy().orderBy(trained.desc(), value.desc_nulls_last(), "model")
    return entries.withColumn("rank", F.when(trained, F.row_number().over(order)))


def normalized_importance(importances: DataFrame) -> DataFrame:
    """Importances of each model made to sum to one, equal where all are zero."""
    per = Window.partitionBy("model")
    total = F.sum(F.greatest("importance", F.lit(0.0))).over(per)
    share = F.when(total > 0, F.greatest("importance", F.lit(0.0)) / total).otherwise(1.0 / F.count(F.lit(1)).over(per))
    return importances.withColumn("importance", share)


def consensus(importances: DataFrame, weight: str = "weight", inverse: bool = False) -> DataFrame:
    """Weighted mean importance per feature, made to sum to one.

    A weight below 1e-8 counts as 1e-8, so negative error scores weigh all models alike; `inverse` weighs by
    one over the error instead.
    """
    w = 1 / F.greatest(F.col(weight), F.lit(1e-8)) if inverse else F.greatest(F.col(weight), F.lit(1e-8))
    mean = importances.groupBy("feature").agg((F.sum(w * F.col("importance")) / F.sum(w)).alias("_c"))
    return mean.select("feature", F.coalesce(
        F.try_divide("_c", over_all(F.sum("_c"))), 1.0 / over_all(F.count(F.lit(1)))).alias("consensus"))


def tiers_by_rank(scores: DataFrame) -> DataFrame:
    """Tier 1 to the first fifth by rank, 2 to a half, 3 to four fifths, 4 to the rest; borders rounded up."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("consensus"), "feature"))
    n = over_all(F.count(F.lit(1)))
    # Tenths keep the border exact: ceil(n * 2 / 10) instead of ceil(n * 0.2).
    border = lambda tenths: F.ceil(n * tenths / 10)
    tier = F.when(rank <= border(2), 1).when(rank <= border(5), 2).when(rank <= border(8), 3).otherwise(4)
    return scores.withColumns({"rank": rank, "tier": tier})


def tiers_by_score(scores: DataFrame) -> DataFrame:
    """Tiers by the 80th, 50th and 20th percentile of the consensus."""
    at = lambda p: over_all(F.percentile("consensus", p))
    marked = scores.withColumns({"_80": at(0.8), "_50": at(0.5), "_20": at(0.2)})
    c = F.col("consensus")
    tier = F.when(c >= F.col("_80"), 1).when(c >= F.col("_50"), 2).when(c >= F.col("_20"), 3).otherwise(4)
    return marked.withColumn("tier", tier).drop("_80", "_50", "_20")


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("features"))


def feature_sets(tiers: DataFrame) -> DataFrame:
    """Feature lists of tier 1-2, tier 1-3 and all; empty lists and repeats of an earlier list are left out."""
    pick = lambda limit: F.sort_array(F.collect_list(F.when(F.col("tier") <= limit, F.col("feature"))))
    one = tiers.agg(pick(2).alias("a"), pick(3).alias("b"), pick(4).alias("c"))
    rows = struct_rows(one, [], [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("variant"), F.col(c).alias("features"))
        for i, (n, c) in enumerate((("tier12", "a"), ("tier123", "b"), ("full", "c")))])
    first = F.row_number().over(Window.partitionBy("features").orderBy("position"))
    return rows.where(F.size("features") > 0).withColumn("_n", first).where("_n = 1").drop("_n")


def refinement_trace(trace: DataFrame, min_gain: float = MIN_GAIN, prune_gap: float = PRUNE_GAP,
                     max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Per round of `(round, model, score)`: best model, gain over the previous round, pruned models and status.

    The loop ends with the first round whose gain is below `min_gain`, or with `max_rounds`; later rounds are dropped.
    """
    per = Window.partitionBy("round")
    marked = trace.where(F.col("round") <= max_rounds).withColumn("_gap", F.max("score").over(per) - F.col("score"))
    rounds = marked.groupBy("round").agg(
        F.count(F.lit(1)).alias("models_evaluated"),
        F.min_by("model", F.struct((-F.col("score")).alias("s"), "model")).alias("best_model"),
        F.max("score").alias("best_score"),
        F.count(F.when(F.col("_gap") > prune_gap, 1)).alias("models_pruned"))
    by_round = Window.partitionBy().orderBy("round")
    gain = rounds.withColumn("improvement", F.col("best_score") - F.lag("best_score").over(by_round))
    stop = F.coalesce(F.abs("improvement") < min_gain, F.lit(False))
    before = by_round.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))
    out = gain.withColumns({"converged": stop, "_ended": ended}).where("_ended = 0").drop("_ended")
    return out.withColumn("status", F.when(F.col("converged"), "Converged").when(
        F.col("round") == max_rounds, "Round limit").otherwise("Continuing"))


def pruned_models(trace: DataFrame, prune_gap: float = PRUNE_GAP) -> DataFrame:
    """Distance of each model to the leader of its round and whether it is dropped."""
    gap = F.max("score").over(Window.partitionBy("round")) - F.col("score")
    return trace.withColumn("gap", gap).withColumn("pruned", F.col("gap") > prune_gap)


def _ranged(metric: str) -> Column:
    low, high = over_all(F.min(metric)), over_all(F.max(metric))
    part = (F.col(metric) - low) / (high - low)
    scaled = F.when(high - low < 1e-12, 1.0).otherwise(1 - part if metric in LOWER_BETTER else part)
    return F.when(F.col(metric).isNotNull(), scaled).otherwise(0.5)


def rubric_parts(entries: DataFrame, metrics: list[str]) -> DataFrame:
    """Every metric on 0..1, higher better. Ranged metrics by their spread over the candidates, the rest absolutely.

    A metric that a candidate lacks counts as 0.5. Needs, for the parts asked for: psi, gap (validation to test), training_time_s, feature_count and library.
    """
    made = {
        "psi": lambda: clip(1 - F.col("psi") / 0.25, 0, 1),
        "generalization": lambda: clip(1 - F.col("gap") / 0.10, 0, 1),
        "efficiency": lambda: clip(1 - F.col("training_time_s") / over_all(F.max("training_time_s")), 0, 1),
        "interpretability": lambda: clip(
            0.7 * (1 - F.col("feature_count") / over_all(F.max("feature_count")))
            + F.when(F.col("library").isin(*LINEAR_LIBRARIES), 0.3).otherwise(0.0), 0, 1),
        "decile": lambda: clip(F.col("decile_score"), 0, 1),
    }
    return entries.withColumns({
        f"{m}_part": _ranged(m) if m in RANGED else F.coalesce(made[m](), F.lit(0.5)) for m in metrics})


def rubric_scores(entries: DataFrame, rubric: str = "pd_regulatory") -> DataFrame:
    """Weighted score of every trained candidate, best first by rank."""
    weights = RUBRICS[rubric]
    parts = rubric_parts(entries.where(F.col("status") == "trained"), list(weights))
    total = sum((F.col(f"{m}_part") * w for m, w in weights.items()), F.lit(0.0))
    scored = parts.withColumn("rubric_score", total)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("rubric_score"), "model")))


def podium(scored: DataFrame) -> DataFrame:
    """Champion and runner-up."""
    return scored.where(F.col("rank") <= 2).withColumn("role", F.when(F.col("rank") == 1, "champion").otherwise("runner_up"))


def composite_score(entries: DataFrame, rubric: str = "pd_regulatory") -> DataFrame:
    """The absolute score: metrics on their own scale, no stability or calibration term, gap and minutes cut at zero."""
    w = RUBRICS[rubric]
    total = (w["auc"] * F.col("auc") + w["gini"] * (F.col("gini") + 1) / 2 + w["ks"] * F.least("ks", F.lit(1.0))
             + w["brier"] * (1 - F.col("brier")) + w["interpretability"] * F.col("interpretable").cast("int")
             + w["generalization"] * F.greatest(F.lit(0.0), 1 - F.col("gap") * 10)
             + w["efficiency"] * F.greatest(F.lit(0.0), 1 - F.col("training_time_s") / 60))
    return entries.withColumn("composite_score", total)


def rubric_table(spark: SparkSession) -> DataFrame:
    """All rubrics as `(rubric, metric, weight)`."""
    rows = [(r, m, float(w)) for r, weights in RUBRICS.items() for m, w in weights.items()]
    return spark.createDataFrame(rows, "rubric string, metric string, weight double")


def weight_validity(weights: DataFrame) -> DataFrame:
    """A rubric is valid when its weights sum to one and each lies in 0..1."""
    total = F.sum("weight")
    outside = F.count(F.when(~F.col("weight").between(0, 1), 1))
    return weights.groupBy("rubric").agg(total.alias("total"), outside.alias("outside"), (
        (F.abs(total - 1) <= 1e-6) & (outside == 0)).alias("valid"))


def mode_scores(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Score per candidate and rubric from `(model, metric, value)`: values held in 0..1, missing metrics left out."""
    both = metrics.where(F.col("value").isNotNull()).join(weights, "metric")
    return both.groupBy("model", "rubric").agg(
        (F.try_divide(F.sum(F.col("weight") * clip(F.col("value"), 0, 1)), F.sum("weight"))).alias("score"))


def mode_advantage(scores: DataFrame, left: str = "mode_regulatory", right: str = "mode_performance") -> DataFrame:
    """Score under both modes and the advantage of the first."""
    at = lambda r: F.max(F.when(F.col("rubric") == r, F.col("score")))
    return scores.groupBy("model").agg(at(left).alias("regulatory_score"), at(right).alias("performance_score")).withColumn(
        "regulatory_advantage", F.col("regulatory_score") - F.col("performance_score"))


def best_candidates(scores: DataFrame) -> DataFrame:
    """Best candidate of each rubric, the first by name on ties."""
    return scores.groupBy("rubric").agg(
        F.min_by("model", F.struct((-F.col("score")).alias("s"), "model")).alias("model"), F.max("score").alias("score"))


def importance_matrix(importances: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One row per feature and one column per model, 0 where a model lacks the feature."""
    pivoted = importances.groupBy("feature").pivot("model", models) if models else importances.groupBy("feature").pivot("model")
    return pivoted.agg(F.first("importance")).na.fill(0.0)


def radar_rows(entries: DataFrame, metric: str = "score", top: int = 5) -> DataFrame:
    """The comparison metrics of the best candidates, long, 0 where missing."""
    best = entries.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(F.desc(metric), "model"))).where(
        F.col("_r") <= top)
    return struct_rows(best, ["model"], [
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).alias("value")) for m in RADAR_METRICS])


def metric_statistics(entries: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, population deviation, range and median of each metric over the candidates."""
    one = entries.agg(*[
        f.alias(f"{n}_{m}") for m in metrics for n, f in (
            ("mean", F.avg(m)), ("std", F.stddev_pop(m)), ("min", F.min(m)), ("max", F.max(m)),
            ("median", F.percentile(m, 0.5)))])
    return struct_rows(one, [], [
        F.struct(F.lit(m).alias("metric"), *[
            F.coalesce(F.col(f"{n}_{m}"), F.lit(0.0)).alias(n) for n in ("mean", "std", "min", "max", "median")])
        for m in metrics])


def tournament_summary(first: DataFrame, refined: DataFrame) -> DataFrame:
    """Champion, runner-up, candidates per phase and the gain of refinement, from two `(model, score)` tables."""
    top = lambda df: df.agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "model"))), 1, 2).alias("top"),
        F.count(F.lit(1)).alias("n"))
    a = top(first).select(F.col("n").alias("phase1_count"), F.get("top", F.lit(0)).alias("p1"),
                          F.get("top", F.lit(1)).alias("p2"))
    b = top(refined).select(F.col("n").alias("phase3_count"), F.get("top", F.lit(0))["s"].alias("_rs"),
                            F.get("top", F.lit(0))["model"].alias("_rm"))
    before, after = -F.col("p1.s"), -F.col("_rs")
    return attach(a, b).select(
        F.when(after > before, F.col("_rm")).otherwise(F.col("p1.model")).alias("champion"),
        F.coalesce("p2.model", F.lit("N/A")).alias("runner_up"), "phase1_count", "phase3_count",
        before.alias("phase1_best_score"), after.alias("phase3_best_score"),
        F.when(before > 0, after - before).otherwise(0.0).alias("improvement_from_refinement"))


def export_leaderboard(first: DataFrame, refined: DataFrame) -> DataFrame:
    """First-phase rows and those refined rows whose model is new, with all metrics of both as columns."""
    fresh = refined.join(first.select("model"), "model", "left_anti")
    both = first.withColumn("phase", F.lit(1)).unionByName(fresh.withColumn("phase", F.lit(3)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy().orderBy("phase", F.desc("score"), "model"))
    metrics = sorted(c for c in both.columns if c not in ("model", "phase"))
    return both.withColumn("rank", rank).select("rank", "phase", "model", *metrics)


def early_stop(history: DataFrame, keys: list[str], patience: int = 50, min_delta: float = 0.0) -> DataFrame:
    """Where training would have stopped on `(keys, iteration, metric)` and the share of iterations saved.

    Stops at the first iteration that lies `patience` after the last improvement.
    """
    by = Window.partitionBy(*keys).orderBy("iteration")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("metric").over(before)
    better = history.withColumn("_b", best.isNull() | (F.col("metric") > best + min_delta))
    last = F.max(F.when(F.col("_b"), F.col("iteration"))).over(by)
    marked = better.withColumn("_since", F.col("iteration") - last)
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"), F.min("iteration").alias("_first"),
        F.min(F.when(F.col("_since") >= patience, F.col("iteration"))).alias("stopped_at"),
        F.max("metric").alias("best_metric"))
    saved = F.when(F.col("stopped_at").isNotNull() & (F.col("iterations") > patience),
                   F.greatest(F.lit(0.0), 1 - (F.col("stopped_at") - F.col("_first")) / F.col("iterations")))
    return out.withColumn("saved_share", F.coalesce(saved, F.lit(0.0))).drop("_first")


def importance_agreement(importances: DataFrame, left: str, right: str) -> DataFrame:
    """Spearman correlation of the importances two models give the same features."""
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("importance")))
    wide = importances.groupBy("feature").agg(at(left).alias("a"), at(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    keyed = wide.withColumns({"model_1": F.lit(left), "model_2": F.lit(right)})
    return rank_correlation(keyed, ["model_1", "model_2"], "a", "b").withColumnRenamed("groups", "features")
