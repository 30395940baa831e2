"""Evaluation of scores: discrimination, calibration, classification and regression metrics.

Input is long: key columns (by default split and model), a 0/1 `label` and a `score`, or `actual` and `predicted`.
Every function handles all groups in the same job. Rank-based results come from `functions.ordered`, so no task
ever holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.functions.ordered import TASK_ROWS, long_values, quantiles, ranked_groups, value_totals
from loanstrata.functions.stats import (
    bias_corrected_kurtosis, bias_corrected_skew, chi2_tail_even, kolmogorov_tail,
)
from loanstrata.operators.profile import struct_rows
from loanstrata.session import attach, join_lookup, pin

KEYS = ["split", "model"]
# Rows whose scores a task sorts and folds together before it sends them on.
FOLDED_ROWS = 200_000

# Green and yellow limits per metric and whether higher is better.
TRAFFIC_LIMITS = {
    "auc": (0.75, 0.65, True),
    "gini": (0.50, 0.30, True),
    "ks": (0.35, 0.20, True),
    "brier": (0.15, 0.25, False),
    "hl_pvalue": (0.10, 0.05, True),
    "psi": (0.10, 0.25, False),
}


def score_curve(scores: DataFrame, keys: list[str] | None = None, task_rows: int = TASK_ROWS,
                rows: int | None = None) -> DataFrame:
    """Positives and negatives at and below every distinct score."""
    keys = KEYS if keys is None else keys
    known = scores.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    return value_totals(known, keys, "score", {
        "pos": F.sum(F.col("label").cast("long")), "neg": F.sum(1 - F.col("label").cast("long"))}, task_rows, rows)


def discrimination(scores: DataFrame, keys: list[str] | None = None, task_rows: int = TASK_ROWS,
                   rows: int | None = None) -> DataFrame:
    """AUC with ties counted half, Gini, and the Kolmogorov-Smirnov distance with its asymptotic p-value.

    A group with one class only gets AUC 0.5 and KS 0.
    """
    keys = KEYS if keys is None else keys
    curve = score_curve(scores, keys, task_rows, rows)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    gap = F.abs(F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_all"))
                - F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_all")))
    out = curve.groupBy(*keys).agg(
        F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"), F.sum(wins).alias("_w"),
        F.max(gap).alias("_ks"))
    auc = F.coalesce(F.try_divide(F.col("_w"), F.col("n_pos").cast("double") * F.col("n_neg")), F.lit(0.5))
    out = out.withColumn("auc", auc).withColumn("gini", 2 * F.col("auc") - 1)
    out = out.withColumn("ks", F.coalesce("_ks", F.lit(0.0)))
    return out.withColumn(
        "ks_pvalue", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), kolmogorov_tail(
            F.col("ks"), F.col("n_pos").cast("double"), F.col("n_neg").cast("double")))).drop("_w", "_ks")


def _folded(values: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order with the sums of both counts; all NaN are one value, the last."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    other = (values[1:] != values[:-1]) & ~(np.isnan(values[1:]) & np.isnan(values[:-1]))
    first = np.flatnonzero(np.concatenate([[True], other]))
    return values[first], np.add.reduceat(pos[order], first), np.add.reduceat(n[order], first)


def column_auc(scored: DataFrame, columns: dict[str, str], task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """`(model, n_pos, n_neg, auc)` for models whose scores are columns of one frame, model name by column.

    The AUC is that of `discrimination`. Tasks fold equal scores and send them on in arrays, cut by a sketch into ordered
    pieces of a size one task can sort; a value a third of the rows share costs a few entries per task. Beyond one piece
    the scores are written, so that they are computed once. `rows` saves the count where the caller knows it.
    """
    named = list(columns)
    known = scored.where(F.col("label").isNotNull()).select(F.col("label").cast("long").alias("label"), *named)
    pieces = math.ceil((known.count() if rows is None else rows) / task_rows)
    cuts: list[list[float]] = [[] for _ in named]
    if pieces > 1:
        known = pin(known)
        probs = [i / pieces for i in range(1, pieces)]
        found = known.agg(*[F.percentile_approx(c, probs, 20 * pieces).alias(c) for c in named]).collect()[0]
        cuts = [found[c] or [] for c in named]

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        label = table["label"].to_numpy()
        for k, name in enumerate(named):
            there = table[name].is_valid().to_numpy()
            if not there.any():
                continue
            pos = label[there]
            parts = _folded(table[name].drop_null().to_numpy(), pos, np.ones_like(pos))
            ends = [0, *np.searchsorted(parts[0], cuts[k]), len(parts[0])]
            spans = [(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(spans), pa.int32()), pa.array([i for i, _, _ in spans], pa.int32()),
                 *[pa.array([part[a:b].tobytes() for _, a, b in spans], pa.binary()) for part in parts]],
                ["model", "piece", "scores", "pos", "n"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= FOLDED_ROWS:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        whole = lambda c, kind: np.frombuffer(b"".join(part[c]), kind)
        _, pos, n = _folded(whole("scores", np.float64), whole("pos", np.int64), whole("n", np.int64))
        neg = n - pos
        wins = (pos * (np.cumsum(neg) - neg + neg / 2)).sum()
        return pd.DataFrame({"model": part["model"][:1], "piece": part["piece"][:1], "pos": pos.sum(), "neg": neg.sum(), "wins": wins})

    parts = known.mapInArrow(fold, "model int, piece int, scores binary, pos binary, n binary").groupBy("model", "piece").applyInPandas(
        rank, "model int, piece int, pos long, neg long, wins double")
    below = Window.partitionBy("model").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0)).cast("double")
    totals = parts.withColumn("wins", wins).groupBy("model").agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("_w"))
    auc = F.coalesce(F.try_divide(F.col("_w"), F.col("n_pos").cast("double") * F.col("n_neg")), F.lit(0.5))
    return totals.select(F.get(F.array(*[F.lit(columns[c]) for c in named]), F.col("model")).alias("model"), "n_pos", "n_neg", auc.alias("auc"))


def classification_counts(scores: DataFrame, keys: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Brier score, confusion matrix at a cut, accuracy, precision, recall and F1 (0 where undefined). One pass."""
    keys = KEYS if keys is None else keys
    hit, real = F.col("score") >= cut, F.col("label") == 1
    n = lambda test: F.count(F.when(test, 1))
    out = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"),
        n(hit & real).alias("tp"), n(hit & ~real).alias("fp"), n(~hit & real).alias("fn"), n(~hit & ~real).alias("tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({
        "accuracy": part(tp + F.col("tn"), F.col("n")), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn),
        "f1": part(2 * tp, 2 * tp + fp + fn),
    })


def calibration_table(scores: DataFrame, keys: list[str] | None = None, groups: int = 10, tie: str = "id",
                      task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """Observed and expected events per equal-count score group; also the points of a calibration curve."""
    keys = KEYS if keys is None else keys
    return ranked_groups(scores, keys, "score", tie, groups, task_rows, rows).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("observed"),
        F.sum("score").alias("expected"), F.avg("score").alias("mean_score"),
        F.avg(F.col("label").cast("double")).alias("observed_rate"))


def hosmer_lemeshow(scores: DataFrame, keys: list[str] | None = None, groups: int = 10, tie: str = "id",
                    task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """Chi-square of observed against expected events over the score groups, with groups - 2 degrees of freedom."""
    keys = KEYS if keys is None else keys
    table = calibration_table(scores, keys, groups, tie, task_rows, rows)
    diff = (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected"))
    rest = F.col("n") - F.col("expected")
    term = F.when(F.col("expected") > 0, diff / F.col("expected")).otherwise(0.0) + F.when(
        rest > 0, diff / rest).otherwise(0.0)
    stat = table.groupBy(*keys).agg(F.sum(term).alias("hl_statistic"))
    return stat.withColumn("hl_pvalue", chi2_tail_even(F.col("hl_statistic"), groups - 2))


def classification_report(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All classification metrics, one row per group."""
    keys = KEYS if keys is None else keys
    rows = scores.count()
    # Three aggregates of one row per group each: the joins move a handful of rows.
    return discrimination(scores, keys, rows=rows).join(classification_counts(scores, keys), keys).join(
        hosmer_lemeshow(scores, keys, rows=rows), keys)


def light(metric: str, value: Column) -> Column:
    """GREEN, YELLOW or RED of a value against the fixed limits."""
    green, yellow, up = TRAFFIC_LIMITS[metric]
    if up:
        return F.when(value > green, "GREEN").when(value >= yellow, "YELLOW").otherwise("RED")
    return F.when(value < green, "GREEN").when(value <= yellow, "YELLOW").otherwise("RED")


def traffic_lights(report: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Adds a status per metric, the count of each colour and the worst one as the overall status."""
    metrics = [m for m in (metrics or list(TRAFFIC_LIMITS)) if m in report.columns]
    out = report.withColumns({f"{m}_status": light(m, F.col(m)) for m in metrics})
    held = F.array(*[F.col(f"{m}_status") for m in metrics])
    count = lambda colour: F.size(F.filter(held, lambda s: s == colour))
    out = out.withColumns({"red_count": count("RED"), "yellow_count": count("YELLOW"), "green_count": count("GREEN")})
    return out.withColumn("overall_status", F.when(F.col("red_count") > 0, "RED").when(
        F.col("yellow_count") > 0, "YELLOW").otherwise("GREEN"))


def roc_points(scores: DataFrame, keys: list[str] | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """False and true positive rate when everything at or above a score is called positive."""
    keys = KEYS if keys is None else keys
    return score_curve(scores, keys, task_rows).select(
        *keys, F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_all") - F.col("neg_before"), F.col("neg_all")).alias("fpr"),
        F.try_divide(F.col("pos_all") - F.col("pos_before"), F.col("pos_all")).alias("tpr"))


def histogram(df: DataFrame, value: str, bins: int = 30, keys: list[str] | None = None) -> DataFrame:
    """Counts in equal-width bins over the range of each group, empty bins included, the last one closed."""
    if not keys:
        return histogram(df.withColumn("_one", F.lit(0)), value, bins, ["_one"]).drop("_one")
    known = df.select(*keys, value).where(F.col(value).isNotNull())
    limits = known.groupBy(*keys).agg(
        F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width) + 1, F.lit(bins)))
    counts = join_lookup(known, limits, keys, "inner").groupBy(*keys, at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("_lo") + width * F.col("bin")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def regression_report(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R-squared, MAPE over non-zero actuals, RMSE relative to the mean, and residual moments. One pass."""
    keys = KEYS if keys is None else keys
    e = F.col("actual") - F.col("predicted")
    out = frame.withColumn("_e", e).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("actual") * F.count("actual"))).alias("r2"),
        F.avg(F.when(F.col("actual") != 0, F.abs(e / F.nullif(F.col("actual"), F.lit(0.0))))).alias("mape"),
        F.try_divide(F.sqrt(F.avg(e * e)), F.avg("actual")).alias("relative_rmse"),
        F.avg("_e").alias("residual_mean"), F.stddev_pop("_e").alias("residual_std"),
        bias_corrected_skew(F.col("_e")).alias("residual_skew"),
        bias_corrected_kurtosis(F.col("_e")).alias("residual_kurtosis"))
    return out


def decile_table(frame: DataFrame, keys: list[str] | None = None, groups: int = 10, tie: str = "id",
                 task_rows: int = TASK_ROWS) -> DataFrame:
    """Mean actual and predicted per equal-count group of the prediction."""
    keys = KEYS if keys is None else keys
    return ranked_groups(frame, keys, "predicted", tie, groups, task_rows).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"),
    ).withColumn("abs_deviation", F.abs(F.col("mean_actual") - F.col("mean_predicted")))


def average_rank(order: Column | str, keys: list[str]) -> Column:
    """Rank with ties averaged; for frames of a few rows per group."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*keys, order)) - 1) / 2


def rank_correlation(frame: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Spearman correlation per group of a small table."""
    ranked = frame.withColumns({"_l": average_rank(left, keys), "_r": average_rank(right, keys)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.corr("_l", "_r").alias("spearman"))


def decile_correlation(frame: DataFrame, keys: list[str] | None = None, groups: int = 10, tie: str = "id") -> DataFrame:
    """Mean decile deviation, and the rank correlation of decile means mapped to 0..1 (0.5 when undefined)."""
    keys = KEYS if keys is None else keys
    table = decile_table(frame, keys, groups, tie)
    rank = rank_correlation(table, keys, "mean_predicted", "mean_actual")
    mean = table.groupBy(*keys).agg(F.avg("abs_deviation").alias("mean_abs_decile_deviation"))
    usable = (F.col("groups") >= 3) & F.col("spearman").isNotNull() & ~F.isnan("spearman")
    score = F.when(usable, (F.col("spearman") + 1) / 2).otherwise(0.5)
    return mean.join(rank, keys).select(*keys, "mean_abs_decile_deviation", score.alias("decile_score"))


def generalization_gap(metrics: DataFrame, metric: str, left: str = "train", right: str = "val") -> DataFrame:
    """Absolute difference of a metric between two splits, per model."""
    at = lambda split: F.max(F.when(F.col("split") == split, F.col(metric)))
    return metrics.groupBy("model").agg(at(left).alias(f"{left}_{metric}"), at(right).alias(f"{right}_{metric}")).withColumn(
        "gap", F.abs(F.col(f"{left}_{metric}") - F.col(f"{right}_{metric}")))


def conversion_factor_check(frame: DataFrame, column: str = "ccf") -> DataFrame:
    """Mean, median and implausible shares of predicted conversion factors; plausible when the mean is in 0..1.2."""
    known = frame.where(F.col(column).isNotNull())
    median = quantiles(known, [column], [0.5]).select(F.col("q")[0].alias("median_ccf"))
    one = known.agg(
        F.avg(column).alias("mean_ccf"), (F.avg((F.col(column) > 1).cast("int")) * 100).alias("pct_above_one"),
        (F.avg((F.col(column) < 0).cast("int")) * 100).alias("pct_negative"))
    return attach(one, median).withColumn(
        "reasonable", F.col("mean_ccf").between(0, 1.2))


def feature_auc(df: DataFrame, features: list[str], label: str, warn: float = 0.90, flag: float = 0.99,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """AUC of every feature alone, direction ignored: the leakage scan and single-feature strength in one job."""
    rows = long_values(df, features, [label]).select(
        "feature", F.col(label).alias("label"), F.col("value").alias("score"))
    found = discrimination(rows, ["feature"], task_rows)
    strength = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return found.select("feature", strength.alias("auc"), (2 * strength - 1).alias("gini"), "ks").withColumn(
        "leakage", F.when(F.col("auc") > flag, "flag").when(F.col("auc") > warn, "warn").otherwise("none"))


def monotonic_breaks(df: DataFrame, order: str, target: str) -> DataFrame:
    """Times the mean target falls from one ordinal level to the next (levels are few: one row each)."""
    rates = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.avg(F.col(target).cast("double")).alias("rate"))
    step = F.col("rate") - F.lag("rate").over(Window.partitionBy().orderBy(order))
    return rates.withColumn("_s", step).agg(
        F.count(F.lit(1)).alias("levels"), F.count(F.when(F.col("_s") < 0, 1)).alias("inversions"))


def report_long(report: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics to `(keys, metric, value)`."""
    return struct_rows(report, keys, [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
