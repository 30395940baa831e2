"""Evaluation queries on deterministic scores, which need no training and so have an exact SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import clean, metrics
from loanstrata.plans.tape import deterministic_scores, resolved_loans
from loanstrata.registered import register
from loanstrata.registered.profiling import TARGET_INPUTS, TARGETS_SQL, rounded
from loanstrata.registered.sql import unpivot, with_scores, with_tape
from loanstrata.session import pin


def scores(spark, folder):
    return deterministic_scores(resolved_loans(spark, folder, []))


CURVE = """, curve AS (
  SELECT split, model, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL), run AS (
  SELECT *, sum(pos) OVER w - pos AS pos_before, sum(neg) OVER w - neg AS neg_before,
    sum(pos) OVER (PARTITION BY split, model) AS pos_all, sum(neg) OVER (PARTITION BY split, model) AS neg_all
  FROM curve WINDOW w AS (PARTITION BY split, model ORDER BY score)) """


@register("auc_gini", with_scores(CURVE +
    "SELECT split, model, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM (SELECT split, model, "
    "sum(pos * (neg_before + neg / 2)) / (max(pos_all) * max(neg_all)) AS auc FROM run GROUP BY 1, 2)"))
def auc_gini(spark, folder):
    return rounded(metrics.discrimination(scores(spark, folder)).select("split", "model", "auc", "gini"), auc=6, gini=6)


@register("ks_stat", with_scores(CURVE +
    "SELECT split, model, CAST(max(pos_all) AS BIGINT) AS n_pos, CAST(max(neg_all) AS BIGINT) AS n_neg, "
    "round(max(abs((pos_before + pos) / pos_all - (neg_before + neg) / neg_all)), 6) AS ks FROM run GROUP BY 1, 2"))
def ks_stat(spark, folder):
    return rounded(metrics.discrimination(scores(spark, folder)).select("split", "model", "n_pos", "n_neg", "ks"), ks=6)


@register("brier_confusion", with_scores(
    "SELECT split, model, n, round(brier, 6) AS brier, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, "
    "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, "
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, "
    "round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM ("
    "SELECT split, model, count(*) AS n, avg((score - label) ** 2) AS brier, "
    "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, "
    "count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn "
    "FROM scores GROUP BY 1, 2)"))
def brier_confusion(spark, folder):
    out = metrics.classification_counts(scores(spark, folder))
    return rounded(out, brier=6, accuracy=6, precision=6, recall=6, f1=6)


DECILES = """, deciles AS (
  SELECT split, model, bucket, count(*) AS n, sum(label) AS observed, sum(score) AS expected, avg(score) AS mean_score,
    avg(label) AS observed_rate FROM (SELECT *, CAST(ntile(10) OVER (PARTITION BY split, model ORDER BY score, id)
    AS INTEGER) AS bucket FROM scores) GROUP BY ALL) """


@register("hosmer_lemeshow", with_scores(DECILES +
    "SELECT split, model, round(x, 4) AS hl_statistic, round(exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + "
    "(x / 2) ** 3 / 6), 6) AS hl_pvalue FROM (SELECT split, model, sum((observed - expected) ** 2 / expected + "
    "(observed - expected) ** 2 / (n - expected)) AS x FROM deciles GROUP BY 1, 2)"))
def hosmer_lemeshow(spark, folder):
    return rounded(metrics.hosmer_lemeshow(scores(spark, folder)), hl_statistic=4, hl_pvalue=6)


@register("calibration_curve", with_scores(DECILES +
    "SELECT split, model, bucket, n, CAST(observed AS BIGINT) AS observed, round(expected, 4) AS expected, "
    "round(mean_score, 6) AS mean_score, round(observed_rate, 6) AS observed_rate FROM deciles"))
def calibration_curve(spark, folder):
    return rounded(metrics.calibration_table(scores(spark, folder)), expected=4, mean_score=6, observed_rate=6)


@register("roc_points", with_scores(CURVE +
    "SELECT split, model, round(score, 6) AS threshold, round((neg_all - neg_before) / neg_all, 6) AS fpr, "
    "round((pos_all - pos_before) / pos_all, 6) AS tpr FROM run"))
def roc_points(spark, folder):
    return rounded(metrics.roc_points(scores(spark, folder)), threshold=6, fpr=6, tpr=6)


@register("score_histogram", with_scores(
    ", lim AS (SELECT split, model, min(score) AS lo, max(score) AS hi FROM scores GROUP BY 1, 2), cnt AS ("
    "SELECT split, model, CAST(least(floor((score - lo) / ((hi - lo) / 30)) + 1, 30) AS INTEGER) AS bin, count(*) AS n "
    "FROM scores JOIN lim USING (split, model) GROUP BY 1, 2, 3) SELECT split, model, CAST(b AS INTEGER) AS bin, "
    "round(lo + (hi - lo) / 30 * (b - 1), 6) AS lower, round(lo + (hi - lo) / 30 * b, 6) AS upper, coalesce(n, 0) AS n "
    "FROM lim CROSS JOIN generate_series(1, 30) g(b) LEFT JOIN (SELECT split, model, bin AS b, n FROM cnt) "
    "USING (split, model, b)"))
def score_histogram(spark, folder):
    return rounded(metrics.histogram(scores(spark, folder), "score", 30, ["split", "model"]), lower=6, upper=6)


@register("traffic_lights", with_scores(CURVE + DECILES +
    ", a AS (SELECT split, model, sum(pos * (neg_before + neg / 2)) / (max(pos_all) * max(neg_all)) AS auc, "
    "max(abs((pos_before + pos) / pos_all - (neg_before + neg) / neg_all)) AS ks FROM run GROUP BY 1, 2), "
    "b AS (SELECT split, model, avg((score - label) ** 2) AS brier FROM scores GROUP BY 1, 2), "
    "h AS (SELECT split, model, exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6) AS hl FROM ("
    "SELECT split, model, sum((observed - expected) ** 2 / expected + (observed - expected) ** 2 / (n - expected)) AS x "
    "FROM deciles GROUP BY 1, 2)), s AS (SELECT split, model, "
    "CASE WHEN auc > 0.75 THEN 'GREEN' WHEN auc >= 0.65 THEN 'YELLOW' ELSE 'RED' END AS auc_status, "
    "CASE WHEN 2 * auc - 1 > 0.5 THEN 'GREEN' WHEN 2 * auc - 1 >= 0.3 THEN 'YELLOW' ELSE 'RED' END AS gini_status, "
    "CASE WHEN ks > 0.35 THEN 'GREEN' WHEN ks >= 0.2 THEN 'YELLOW' ELSE 'RED' END AS ks_status, "
    "CASE WHEN brier < 0.15 THEN 'GREEN' WHEN brier <= 0.25 THEN 'YELLOW' ELSE 'RED' END AS brier_status, "
    "CASE WHEN hl > 0.1 THEN 'GREEN' WHEN hl >= 0.05 THEN 'YELLOW' ELSE 'RED' END AS hl_pvalue_status "
    "FROM a JOIN b USING (split, model) JOIN h USING (split, model)), l AS (SELECT *, "
    "[auc_status, gini_status, ks_status, brier_status, hl_pvalue_status] AS v FROM s) "
    "SELECT * EXCLUDE (v), CAST(len(list_filter(v, lambda x: x = 'RED')) AS INTEGER) AS red_count, "
    "CASE WHEN list_contains(v, 'RED') THEN 'RED' WHEN list_contains(v, 'YELLOW') THEN 'YELLOW' ELSE 'GREEN' END "
    "AS overall_status FROM l"))
def traffic_lights(spark, folder):
    lit = metrics.traffic_lights(metrics.classification_report(scores(spark, folder)))
    return lit.select("split", "model", *[c for c in lit.columns if c.endswith("_status")], "red_count")


PREDICTIONS = TARGETS_SQL + """, predictions AS (
  SELECT id, split, model, lgd AS actual, CASE model WHEN 'flat' THEN 0.5 + CAST((id * 37) % 1000 AS DOUBLE) / 10000
    ELSE 0.5 * lgd + 0.5 * ((id * 61) % 1000 + 0.5) / 1000 END AS predicted
  FROM targets, (VALUES ('flat'), ('half')) m(model) WHERE default_flag = 1 AND lgd IS NOT NULL) """


def predictions(spark, folder):
    loans = clean.loss_stage_targets(clean.with_targets(pin(resolved_loans(spark, folder, TARGET_INPUTS))))
    rows = F.array(
        F.struct(F.lit("flat").alias("model"), (0.5 + (F.col("id") * 37) % 1000 / 10000).alias("predicted")),
        F.struct(F.lit("half").alias("model"),
                 (0.5 * F.col("lgd") + 0.5 * ((F.col("id") * 61) % 1000 + 0.5) / 1000).alias("predicted")))
    return loans.select("id", "split", F.col("lgd").alias("actual"), F.explode(rows).alias("m")).select(
        "id", "split", "m.model", "actual", "m.predicted")


@register("regression_metrics", with_tape(PREDICTIONS +
    "SELECT split, model, count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, "
    "round(avg(abs(actual - predicted)), 6) AS mae, "
    "round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 5) AS r2, "
    "round(avg(abs((actual - predicted) / nullif(actual, 0))), 5) AS mape, "
    "round(sqrt(avg((actual - predicted) ** 2)) / avg(actual), 6) AS relative_rmse, "
    "round(avg(actual - predicted), 6) AS residual_mean, round(stddev_pop(actual - predicted), 6) AS residual_std, "
    "round(skewness(actual - predicted), 5) AS residual_skew, round(kurtosis(actual - predicted), 4) AS residual_kurtosis "
    "FROM predictions GROUP BY 1, 2"))
def regression_metrics(spark, folder):
    out = metrics.regression_report(predictions(spark, folder))
    return rounded(out, rmse=6, mae=6, r2=5, mape=5, relative_rmse=6, residual_mean=6, residual_std=6,
                   residual_skew=5, residual_kurtosis=4)


REG_DECILES = PREDICTIONS + """, deciles AS (
  SELECT split, model, bucket, count(*) AS n, avg(actual) AS mean_actual, avg(predicted) AS mean_predicted,
    abs(avg(actual) - avg(predicted)) AS abs_deviation FROM (SELECT *, CAST(ntile(10) OVER (PARTITION BY split, model
    ORDER BY predicted, id) AS INTEGER) AS bucket FROM predictions) GROUP BY ALL) """


@register("decile_table", with_tape(REG_DECILES +
    "SELECT split, model, bucket, n, round(mean_actual, 6) AS mean_actual, round(mean_predicted, 6) AS mean_predicted, "
    "round(abs_deviation, 6) AS abs_deviation FROM deciles"))
def decile_table(spark, folder):
    out = metrics.decile_table(predictions(spark, folder))
    return rounded(out, mean_actual=6, mean_predicted=6, abs_deviation=6)


@register("decile_rank_correlation", with_tape(REG_DECILES +
    ", r AS (SELECT *, rank() OVER (PARTITION BY split, model ORDER BY mean_predicted) AS a, "
    "rank() OVER (PARTITION BY split, model ORDER BY mean_actual) AS b FROM deciles) SELECT split, model, "
    "round(avg(abs_deviation), 6) AS mean_abs_decile_deviation, round((corr(a, b) + 1) / 2, 6) AS decile_score "
    "FROM r GROUP BY 1, 2"))
def decile_rank_correlation(spark, folder):
    return rounded(metrics.decile_correlation(predictions(spark, folder)), mean_abs_decile_deviation=6, decile_score=6)


@register("train_val_gap", with_scores(CURVE +
    ", a AS (SELECT split, model, sum(pos * (neg_before + neg / 2)) / (max(pos_all) * max(neg_all)) AS auc "
    "FROM run GROUP BY 1, 2) SELECT model, round(max(auc) FILTER (split = 'train'), 6) AS train_auc, "
    "round(max(auc) FILTER (split = 'val'), 6) AS val_auc, round(abs(max(auc) FILTER (split = 'train') - "
    "max(auc) FILTER (split = 'val')), 6) AS gap FROM a GROUP BY model"))
def train_val_gap(spark, folder):
    found = metrics.discrimination(scores(spark, folder))
    return rounded(metrics.generalization_gap(found, "auc"), train_auc=6, val_auc=6, gap=6)


@register("conversion_factor_check", with_tape(TARGETS_SQL +
    "SELECT round(avg(ccf), 6) AS mean_ccf, round(quantile_cont(ccf, 0.5), 6) AS median_ccf, "
    "round(avg(CASE WHEN ccf > 1 THEN 1 ELSE 0 END) * 100, 4) AS pct_above_one, "
    "round(avg(CASE WHEN ccf < 0 THEN 1 ELSE 0 END) * 100, 4) AS pct_negative, avg(ccf) BETWEEN 0 AND 1.2 AS reasonable "
    "FROM targets WHERE ccf IS NOT NULL"))
def conversion_factor_check(spark, folder):
    out = metrics.conversion_factor_check(clean.with_targets(pin(resolved_loans(spark, folder, TARGET_INPUTS))))
    return rounded(out, mean_ccf=6, median_ccf=6, pct_above_one=4, pct_negative=4)


LEAK_FEATURES = ["loan_amnt", "annual_inc", "dti", "revol_bal", "open_acc", "total_acc"]


@register("leakage_scan", with_tape(
    ", v AS (" + unpivot(LEAK_FEATURES, "default_flag AS label", "resolved") + "), curve AS (SELECT feature, value, "
    "sum(label) AS pos, sum(1 - label) AS neg FROM v GROUP BY 1, 2), run AS (SELECT *, sum(neg) OVER (PARTITION BY feature "
    "ORDER BY value) - neg AS neg_before, sum(neg) OVER (PARTITION BY feature ORDER BY value) AS neg_upto, "
    "sum(pos) OVER (PARTITION BY feature ORDER BY value) AS pos_upto, sum(pos) OVER (PARTITION BY feature) AS p, "
    "sum(neg) OVER (PARTITION BY feature) AS n FROM curve), a AS (SELECT feature, sum(pos * (neg_before + neg / 2)) / "
    "(max(p) * max(n)) AS auc, max(abs(pos_upto / p - neg_upto / n)) AS ks FROM run GROUP BY 1) "
    "SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, round(2 * greatest(auc, 1 - auc) - 1, 6) AS gini, "
    "round(ks, 6) AS ks, CASE WHEN greatest(auc, 1 - auc) > 0.99 THEN 'flag' WHEN greatest(auc, 1 - auc) > 0.9 "
    "THEN 'warn' ELSE 'none' END AS leakage FROM a"))
def leakage_scan(spark, folder):
    loans = pin(resolved_loans(spark, folder, LEAK_FEATURES))
    return rounded(metrics.feature_auc(loans, LEAK_FEATURES, "default_flag"), auc=6, gini=6, ks=6)


@register("grade_monotonicity", with_tape(
    ", r AS (SELECT grade, avg(default_flag) AS rate FROM resolved GROUP BY 1), s AS (SELECT rate - lag(rate) OVER "
    "(ORDER BY grade) AS d FROM r) SELECT count(*) AS levels, count(*) FILTER (d < 0) AS inversions FROM s"))
def grade_monotonicity(spark, folder):
    return metrics.monotonic_breaks(resolved_loans(spark, folder, ["grade"]), "grade", "default_flag")
