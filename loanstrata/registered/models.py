"""Training queries over all loans, with the whole pools, trees, folds and draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loanstrata.functions.text import percent_number
from loanstrata.operators import candidates, clean, models, robustness
from loanstrata.plans.tape import resolved_loans
from loanstrata.registered import register
from loanstrata.registered.profiling import TARGET_INPUTS, rounded
from loanstrata.registered.sql import with_tape
from loanstrata.session import attach, pin, spread

FEATURES = ["loan_amnt", "annual_inc", "dti", "int_rate", "revol_bal", "open_acc", "signal"]


def loans(spark, folder):
    """Resolved loans with a planted signal, complete features and the month of issue as a number."""
    rows = resolved_loans(spark, folder, ["loan_amnt", "annual_inc", "dti", "int_rate", "revol_bal", "open_acc", "issue_ts"])
    k = F.col("id")
    typed = rows.withColumns({
        "int_rate": percent_number(F.col("int_rate")),
        "signal": F.col("default_flag") * 0.35 + (k * 37) % 1000 / 1000,
        "issued": F.unix_timestamp(F.col("issue_ts").cast("timestamp")).cast("double"),
    })
    ready = spread(pin(typed.select("id", "split", "default_flag", "issued", *FEATURES)))
    gaps = ["annual_inc", "dti", "revol_bal", "open_acc"]
    return clean.fill_numeric(ready, gaps, fit_on=ready.where("split = 'train'"))


def frame(rows):
    return models.model_frame(rows, FEATURES, "default_flag", keep=["issued"], balanced=True)


@register("logit_coefficients")
def logit_coefficients(spark, folder):
    found = models.coefficient_table(loans(spark, folder).where("split = 'train'"), FEATURES, "default_flag", "logit")
    return models.sign_check(found.table, {f: 1 for f in FEATURES})


@register("ols_coefficients")
def ols_coefficients(spark, folder):
    return models.coefficient_table(loans(spark, folder).where("split = 'train'"), FEATURES[:-1], "signal", "ols").table


@register("ols_slope", with_tape(
    "SELECT round(regr_slope(revol_bal, tot_cur_bal), 6) AS slope, round(regr_intercept(revol_bal, tot_cur_bal), 2) AS intercept, "
    "count(*) AS n FROM resolved WHERE revol_bal IS NOT NULL AND tot_cur_bal IS NOT NULL"))
def ols_slope(spark, folder):
    rows = resolved_loans(spark, folder, ["revol_bal", "tot_cur_bal"])
    found = models.coefficient_table(rows, ["tot_cur_bal"], "revol_bal", "ols")
    at = lambda v: F.max(F.when(F.col("variable") == v, F.col("coefficient")))
    n = found.summary.where("statistic = 'n_observations'").select(F.col("value").cast("bigint").alias("n"))
    one = found.table.agg(at("tot_cur_bal").alias("slope"), at("const").alias("intercept"))
    return rounded(attach(one, n), slope=6, intercept=2)


@register("pd_tournament")
def pd_tournament(spark, folder):
    """The whole pool with all trees; the search is run by `search_trace`, whose fits the full settings multiply."""
    out = models.pd_tournament(frame(loans(spark, folder)), None, models.Settings(draws=0, workers=8))
    return out.leaderboard.select("rank", "model", "status", "auc", "ks", "brier", "psi", "overfit_gap", "trees_asked", "trees_kept", "rubric_score")


@register("random_search")
def random_search(spark, folder):
    built = frame(loans(spark, folder))
    settings = models.Settings(workers=8)
    folded = pin(models.time_folds(built, "issued", settings.folds))
    candidate = candidates.PD_CANDIDATES[0]
    best = models.search(built, folded, candidate, FEATURES, candidates.draw_params(candidate, settings.draws, 42), settings)
    fitted = models.fit(built, best)
    return models.classification_entries(built, [fitted], calibrated=False).select("model", "auc", "overfit_gap")


@register("search_trace", """
WITH RECURSIVE race(fold, n) AS (SELECT 1, 20 UNION ALL SELECT fold + 1, greatest(2, CAST(ceil(n / 2.0) AS INTEGER)) FROM race WHERE fold < 5)
SELECT model, fold, n::BIGINT AS judged, CASE WHEN fold = 5 THEN 1 ELSE greatest(2, ceil(n / 2.0)) END::BIGINT AS go_on, n::BIGINT AS judged_on_all,
  true AS best_go_on, CASE WHEN fold = 5 THEN 1 ELSE 0 END::BIGINT AS chosen
FROM race, (VALUES ('Logistic Regression L2'), ('Decision Tree')) m(model)
""")
def search_trace(spark, folder):
    """Draws judged per fold, how many were judged on every fold before, and whether those with the best mean went on."""
    built = frame(loans(spark, folder))
    settings = models.Settings(workers=8)
    folded = pin(models.time_folds(built, "issued", settings.folds))
    plans = [models.SearchPlan(c.name, c, FEATURES, candidates.draw_params(c, settings.draws, settings.seed))
             for c in candidates.PD_CANDIDATES if c.name in ("Logistic Regression L2", "Decision Tree")]
    trace = models.search_table(models.search_all(built, folded, plans, settings)[1], spark)
    so_far = Window.partitionBy("model", "draw").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    seen = trace.withColumns({"mean": F.avg("auc").over(so_far), "times": F.count(F.lit(1)).over(so_far)})
    limits = seen.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if("goes_on").alias("go_on"), F.count_if(F.col("times") == F.col("fold")).alias("judged_on_all"),
        (F.min(F.when(F.col("goes_on"), F.col("mean"))) >= F.coalesce(F.max(F.when(~F.col("goes_on"), F.col("mean"))), F.lit(0.0))).alias("best_go_on"),
        F.count_if("chosen").alias("chosen"))
    return limits


@register("boosting_rounds", with_tape(
    "SELECT 'Gradient Boosting (GBM)' AS model, 40 AS trees_asked, true AS stopped, true AS within, count(*) FILTER (split = 'train') AS fitted_on, "
    "count(*) FILTER (split = 'val') AS held_back FROM resolved"))
def boosting_rounds(spark, folder):
    """A fast-learning boosted model stops before its last tree, judged on the validation rows."""
    built = frame(loans(spark, folder))
    asked = next(c for c in candidates.PD_CANDIDATES if c.kind == "boost").with_params(n_estimators=40, learning_rate=0.9)
    made = models.fit_table([models.fit(built, asked, stop_on="val")], spark)
    rows = built.data.agg(F.count_if(F.col("split") == "train").alias("fitted_on"), F.count_if(F.col("split") == "val").alias("held_back"))
    return attach(made.select("model", "trees_asked", (F.col("trees_kept") < F.col("trees_asked")).alias("stopped"),
                              F.col("trees_kept").between(1, F.col("trees_asked")).alias("within")), rows)


@register("lgd_two_stage")
def lgd_two_stage(spark, folder):
    rows = resolved_loans(spark, folder, [*TARGET_INPUTS, "loan_amnt", "annual_inc", "dti", "revol_bal"])
    rows = pin(clean.fill_numeric(rows, ["annual_inc", "dti", "revol_bal"], fit_on=rows.where("split = 'train'")))
    # A loss below one half counts as none, so that both classes occur in the tape.
    losses = clean.loss_stage_targets(clean.with_targets(rows)).withColumn(
        "lgd", F.when(F.col("lgd") < 0.5, 0.0).otherwise(F.col("lgd"))).withColumn("any_loss", (F.col("lgd") > 0).cast("int"))
    out = models.lgd_two_stage(losses, ["loan_amnt", "annual_inc", "dti", "revol_bal"], workers=8)
    return out.predict(losses).select("id", "split", F.col("lgd").alias("actual"), "p_any_loss", "severity", "predicted")


@register("ead_tournament")
def ead_tournament(spark, folder):
    rows = resolved_loans(spark, folder, [*TARGET_INPUTS, "loan_amnt", "revol_bal", "open_acc", "total_acc"])
    rows = clean.with_targets(rows).where("ead IS NOT NULL")
    built = models.model_frame(rows, ["loan_amnt", "revol_bal", "open_acc", "total_acc"], "ead")
    out = models.regression_tournament(built, None, 0.0, None, 8)
    return out.entries.select("model", "status", "trees_asked", "trees_kept", "train_rmse", "val_rmse", "val_mae", "val_r2", "test_rmse", "overfit_gap")


def _fitted(spark, folder):
    rows = loans(spark, folder)
    built = frame(rows)
    fitted = models.fit(built, candidates.PD_CANDIDATES[0])
    return built, fitted, rows.where("split = 'test'").withColumn("label", F.col("default_flag"))


@register("feature_shocks")
def feature_shocks(spark, folder):
    return robustness.feature_shocks(*_fitted(spark, folder))


@register("noise_volatility")
def noise_volatility(spark, folder):
    return robustness.noise_volatility(*_fitted(spark, folder))


@register("partial_dependence")
def partial_dependence(spark, folder):
    return robustness.partial_dependence(*_fitted(spark, folder))


@register("dependence_trend")
def dependence_trend(spark, folder):
    return robustness.dependence_trend(robustness.partial_dependence(*_fitted(spark, folder)))


@register("permutation_importance")
def permutation_importance(spark, folder):
    return robustness.permutation_importance(*_fitted(spark, folder))


@register("feature_dropout")
def feature_dropout(spark, folder):
    return robustness.feature_dropout(frame(loans(spark, folder)), candidates.PD_CANDIDATES[0])


@register("importance_stability")
def importance_stability(spark, folder):
    return robustness.importance_stability(frame(loans(spark, folder)), candidates.PD_CANDIDATES[0])


@register("smote")
def smote(spark, folder):
    rows = resolved_loans(spark, folder, ["loan_amnt", "open_acc"]).where("open_acc IS NOT NULL")
    rare = rows.withColumn("rare", ((F.col("id") % 29 == 0) & (F.col("default_flag") == 1)).cast("int"))
    return robustness.smote(rare, ["loan_amnt", "open_acc"], "rare", enabled=True)


@register("smote_counts", with_tape(
    ", r AS (SELECT CASE WHEN id % 29 = 0 AND default_flag = 1 THEN 1 ELSE 0 END AS rare FROM resolved), n AS (SELECT count(*) FILTER (rare = 0) AS n0, "
    "count(*) FILTER (rare = 1) AS n1 FROM r) SELECT 0 AS rare, false AS synthetic, n0 AS n, n0 AS ids, CAST(0 AS BIGINT) AS outside FROM n UNION ALL "
    "SELECT 1, false, n1, n1, 0 FROM n UNION ALL SELECT 1, true, n0 - n1, n0 - n1, 0 FROM n"))
def smote_counts(spark, folder):
    """Rows and distinct ids per class, and synthetic rows outside the range of their class."""
    rows = resolved_loans(spark, folder, ["loan_amnt", "dti"]).select("id", "default_flag", "loan_amnt", F.coalesce("dti", F.lit(0.0)).alias("dti"))
    rare = rows.withColumn("rare", ((F.col("id") % 29 == 0) & (F.col("default_flag") == 1)).cast("int"))
    limits = rare.where("rare = 1").agg(F.min("loan_amnt").alias("lo"), F.max("loan_amnt").alias("hi"))
    out = attach(robustness.smote(rare, ["loan_amnt", "dti"], "rare", enabled=True), limits)
    return out.groupBy("rare", "synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
        F.count(F.when(F.col("synthetic") & ~F.col("loan_amnt").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9), 1)).alias("outside"))


@register("additive_contributions", with_tape(
    ", m AS (SELECT avg(loan_amnt) AS a, avg(dti) AS d FROM resolved WHERE split = 'train') SELECT id, "
    "round((loan_amnt - a) * 0.75, 4) AS loan_amnt_contribution, round((dti - d) * 0.25, 4) AS dti_contribution, "
    "round((coalesce((loan_amnt - a) * 0.75, 0) + coalesce((dti - d) * 0.25, 0)) / 1.0, 4) AS total_contribution FROM resolved, m"))
def additive_contributions(spark, folder):
    rows = resolved_loans(spark, folder, ["loan_amnt", "dti"])
    out = robustness.additive_contributions(rows, {"loan_amnt": 0.75, "dti": 0.25}, rows.where("split = 'train'"))
    return rounded(out, loan_amnt_contribution=4, dti_contribution=4, total_contribution=4)
