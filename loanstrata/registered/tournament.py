"""Tournament queries. Candidates are the deterministic scores, measured on the loans of each split."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import drift, metrics, tournament
from loanstrata.operators.profile import struct_rows
from loanstrata.plans.tape import NUMERIC_COLUMNS, deterministic_scores, resolved_loans, with_scores
from loanstrata.registered import register
from loanstrata.registered.metrics import CURVE, DECILES, scores
from loanstrata.registered.profiling import rounded
from loanstrata.registered.sql import with_scores as scores_sql
from loanstrata.session import small_table

LIBRARY = {"uniform": "sklearn", "tied": "sklearn", "second": "xgboost", "informed": "statsmodels", "sharp": "lightgbm"}
MODELS = list(LIBRARY)
IMPORTANCE_FEATURES = [c for c in NUMERIC_COLUMNS if c != "installment"]


def entries(spark, folder):
    """One row per candidate: validation metrics, stability and gap to the test loans, and its cost."""
    rows = scores(spark, folder)
    report = metrics.classification_report(rows)
    test = report.where("split = 'test'").select("model", F.col("auc").alias("test_auc"))
    wide = with_scores(resolved_loans(spark, folder, []))
    edges = drift.quantile_edges(wide.where("split = 'val'"), MODELS)
    stable = drift.psi(wide, "split", "val", "test", edges, drift.QUANTILE_CLOSED).select(
        F.col("feature").alias("model"), "psi")
    library = F.create_map(*[F.lit(x) for pair in LIBRARY.items() for x in pair])
    held = report.where("split = 'val'").drop("split").join(test, "model").join(stable, "model")
    return held.withColumns({
        "gap": F.abs(F.col("auc") - F.col("test_auc")), "library": F.get(F.array(library), F.lit(0))[F.col("model")],
        "feature_count": F.length("model") * 2, "training_time_s": F.length("model") * F.col("n") / 1000,
        "interpretable": F.get(F.array(library), F.lit(0))[F.col("model")].isin("sklearn", "statsmodels"),
        "status": F.lit("trained"),
    })


ENTRIES = CURVE + DECILES + """, a AS (SELECT split, model, sum(pos * (neg_before + neg / 2)) / (max(pos_all) * max(neg_all)) AS auc,
  max(abs((pos_before + pos) / pos_all - (neg_before + neg) / neg_all)) AS ks FROM run GROUP BY 1, 2),
b AS (SELECT split, model, count(*) AS n, avg((score - label) ** 2) AS brier,
  count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn
  FROM scores GROUP BY 1, 2),
h AS (SELECT split, model, exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6) AS hl_pvalue FROM (
  SELECT split, model, sum((observed - expected) ** 2 / expected + (observed - expected) ** 2 / (n - expected)) AS x
  FROM deciles GROUP BY 1, 2)),
ed AS (SELECT model, quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM scores
  WHERE split = 'val' GROUP BY 1),
pc AS (SELECT model, len(list_filter(q[2:10], lambda x: score >= x)) AS bin, count(*) FILTER (split = 'val') AS r,
  count(*) FILTER (split = 'test') AS o FROM scores JOIN ed USING (model) WHERE score >= q[1] AND score <= q[11]
  AND split IN ('val', 'test') GROUP BY 1, 2),
ps AS (SELECT model, greatest(r / sum(r) OVER w, 1e-8) AS rs, greatest(o / sum(o) OVER w, 1e-8) AS os FROM pc
  WINDOW w AS (PARTITION BY model)),
p AS (SELECT model, sum((os - rs) * ln(os / rs)) AS psi FROM ps GROUP BY 1),
entries AS (SELECT v.model, v.auc, 2 * v.auc - 1 AS gini, v.ks, b.brier, h.hl_pvalue, p.psi, abs(v.auc - t.auc) AS gap, n,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + tn) / n AS accuracy,
  length(v.model) * 2 AS feature_count, length(v.model) * n / 1000 AS training_time_s,
  v.model IN ('uniform', 'tied', 'informed') AS interpretable
  FROM a v JOIN a t ON v.model = t.model AND v.split = 'val' AND t.split = 'test'
  JOIN b ON b.model = v.model AND b.split = 'val' JOIN h ON h.model = v.model AND h.split = 'val' JOIN p ON p.model = v.model) """


@register("leaderboard", scores_sql(ENTRIES +
    "SELECT model, CAST(row_number() OVER (ORDER BY auc DESC, model) AS INTEGER) AS rank, round(auc, 6) AS auc, "
    "round(gap, 6) AS gap, round(psi, 6) AS psi FROM entries"))
def leaderboard(spark, folder):
    board = tournament.leaderboard(entries(spark, folder))
    return rounded(board.select("model", "rank", "auc", "gap", "psi"), auc=6, gap=6, psi=6)


RANGED = lambda m, up: (
    f"CASE WHEN max({m}) OVER () - min({m}) OVER () < 1e-12 THEN 1 ELSE "
    + ("" if up else "1 - ") + f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) END")
_RUBRIC = (", scored AS (SELECT model, 0.20 * (" + RANGED("auc", True) + ") + 0.15 * (" + RANGED("gini", True) + ") + 0.15 * ("
           + RANGED("ks", True) + ") + 0.10 * (" + RANGED("brier", False) + ") + 0.10 * (" + RANGED("hl_pvalue", True)
           + ") + 0.10 * greatest(0, least(1, 1 - psi / 0.25)) + 0.10 * greatest(0, least(1, 0.7 * (1 - feature_count / "
           "max(feature_count) OVER ()) + CASE WHEN interpretable THEN 0.3 ELSE 0 END)) + 0.05 * greatest(0, least(1, 1 - gap / 0.1)) "
           "+ 0.05 * (1 - training_time_s / max(training_time_s) OVER ()) AS rubric_score FROM entries) ")


@register("rubric_minmax", scores_sql(ENTRIES + _RUBRIC +
    "SELECT model, round(rubric_score, 6) AS rubric_score, CAST(row_number() OVER (ORDER BY rubric_score DESC, model) AS INTEGER) "
    "AS rank FROM scored"))
def rubric_minmax(spark, folder):
    out = tournament.rubric_scores(entries(spark, folder))
    return rounded(out.select("model", "rubric_score", "rank"), rubric_score=6)


@register("champion_runner_up", scores_sql(ENTRIES + _RUBRIC +
    "SELECT model, round(rubric_score, 6) AS rubric_score, CASE r WHEN 1 THEN 'champion' ELSE 'runner_up' END AS role FROM ("
    "SELECT *, row_number() OVER (ORDER BY rubric_score DESC, model) AS r FROM scored) WHERE r <= 2"))
def champion_runner_up(spark, folder):
    out = tournament.podium(tournament.rubric_scores(entries(spark, folder)))
    return rounded(out.select("model", "rubric_score", "role"), rubric_score=6)


@register("composite_score", scores_sql(ENTRIES +
    "SELECT model, round(0.20 * auc + 0.15 * (gini + 1) / 2 + 0.15 * least(ks, 1) + 0.10 * (1 - brier) + 0.10 * "
    "CASE WHEN interpretable THEN 1 ELSE 0 END + 0.05 * greatest(0, 1 - gap * 10) + 0.05 * greatest(0, 1 - training_time_s / 60), 6) "
    "AS composite_score FROM entries"))
def composite_score(spark, folder):
    out = tournament.composite_score(entries(spark, folder))
    return rounded(out.select("model", "composite_score"), composite_score=6)


MODE_METRICS = ["auc", "accuracy", "precision", "recall", "f1", "gini", "psi"]
_MODES = (", long AS (" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {m} AS value FROM entries" for m in MODE_METRICS)
    + "), weights(rubric, metric, weight) AS (VALUES ('mode_regulatory', 'auc', 0.15), ('mode_regulatory', 'accuracy', 0.10), "
    "('mode_regulatory', 'gini', 0.10), ('mode_regulatory', 'psi', 0.05), ('mode_performance', 'auc', 0.30), "
    "('mode_performance', 'accuracy', 0.20), ('mode_performance', 'precision', 0.15), ('mode_performance', 'recall', 0.15), "
    "('mode_performance', 'f1', 0.10)), modes AS (SELECT model, rubric, CAST(sum(weight * greatest(0, least(1, value))) AS DOUBLE) "
    "/ CAST(sum(weight) AS DOUBLE) AS score FROM long JOIN weights USING (metric) GROUP BY 1, 2) ")


def mode_scores(spark, folder):
    long = metrics.report_long(entries(spark, folder), ["model"], MODE_METRICS)
    weights = tournament.rubric_table(spark).where(F.col("rubric").startswith("mode_"))
    return tournament.mode_scores(long, weights)


@register("rubric_scoring_mode", scores_sql(ENTRIES + _MODES +
    "SELECT model, round(max(score) FILTER (rubric = 'mode_regulatory'), 6) AS regulatory_score, "
    "round(max(score) FILTER (rubric = 'mode_performance'), 6) AS performance_score, "
    "round(max(score) FILTER (rubric = 'mode_regulatory') - max(score) FILTER (rubric = 'mode_performance'), 6) "
    "AS regulatory_advantage FROM modes GROUP BY model"))
def rubric_scoring_mode(spark, folder):
    out = tournament.mode_advantage(mode_scores(spark, folder))
    return rounded(out, regulatory_score=6, performance_score=6, regulatory_advantage=6)


@register("best_candidates", scores_sql(ENTRIES + _MODES +
    "SELECT rubric, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rubric ORDER BY score DESC, "
    "model) AS r FROM modes) WHERE r = 1"))
def best_candidates(spark, folder):
    return rounded(tournament.best_candidates(mode_scores(spark, folder)), score=6)


@register("metric_statistics", scores_sql(ENTRIES + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, round(min({m}), 6) AS min, "
    f"round(max({m}), 6) AS max, round(quantile_cont({m}, 0.5), 6) AS median FROM entries" for m in ("auc", "ks", "brier", "f1")) + ")"))
def metric_statistics(spark, folder):
    out = tournament.metric_statistics(entries(spark, folder), ["auc", "ks", "brier", "f1"])
    return rounded(out, mean=6, std=6, min=6, max=6, median=6)


@register("radar_rows", scores_sql(ENTRIES + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, round({m}, 6) AS value FROM entries" for m in tournament.RADAR_METRICS) + ")"))
def radar_rows(spark, folder):
    return rounded(tournament.radar_rows(entries(spark, folder), "auc"), value=6)


def importances(spark, folder):
    """Absolute correlation of each candidate's score with every feature, weighted by the candidate's AUC."""
    loans = resolved_loans(spark, folder, IMPORTANCE_FEATURES)
    scored = deterministic_scores(loans)
    one = with_scores(loans).agg(*[
        F.abs(F.corr(F.col(m), F.col(f).cast("double"))).alias(f"{m}|{f}") for m in MODELS for f in IMPORTANCE_FEATURES])
    rows = struct_rows(one, [], [
        F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.col(f"{m}|{f}").alias("importance"))
        for m in MODELS for f in IMPORTANCE_FEATURES])
    weight = metrics.discrimination(scored.where("split = 'val'"), ["model"]).select("model", F.col("auc").alias("weight"))
    return tournament.normalized_importance(rows).join(weight, "model")


IMPORTANCE = CURVE + ", raw AS (" + " UNION ALL ".join(
    f"SELECT model, '{f}' AS feature, abs(corr(score, {f})) AS importance FROM scores JOIN resolved USING (id) GROUP BY 1"
    for f in IMPORTANCE_FEATURES) + """), wt AS (SELECT model, sum(pos * (neg_before + neg / 2)) / (max(pos_all) * max(neg_all))
  AS weight FROM run WHERE split = 'val' GROUP BY 1), imp AS (SELECT model, feature, importance / sum(importance) OVER
  (PARTITION BY model) AS importance, weight FROM raw JOIN wt USING (model)), cons0 AS (SELECT feature, sum(weight * importance) /
  sum(weight) AS c FROM imp GROUP BY 1), cons AS (SELECT feature, c / sum(c) OVER () AS consensus FROM cons0) """


@register("consensus_tiers", scores_sql(IMPORTANCE +
    ", r AS (SELECT *, CAST(row_number() OVER (ORDER BY consensus DESC, feature) AS INTEGER) AS rank, count(*) OVER () AS n FROM cons) "
    "SELECT feature, round(consensus, 6) AS consensus, rank, CASE WHEN rank <= ceil(n * 2 / 10) THEN 1 WHEN rank <= ceil(n * 5 / 10) "
    "THEN 2 WHEN rank <= ceil(n * 8 / 10) THEN 3 ELSE 4 END AS tier FROM r"))
def consensus_tiers(spark, folder):
    return rounded(tournament.tiers_by_rank(tournament.consensus(importances(spark, folder))), consensus=6)


@register("consensus_tiers_score", scores_sql(IMPORTANCE +
    ", q AS (SELECT quantile_cont(consensus, 0.8) AS a, quantile_cont(consensus, 0.5) AS b, quantile_cont(consensus, 0.2) AS c "
    "FROM cons) SELECT feature, round(consensus, 6) AS consensus, CASE WHEN consensus >= a THEN 1 WHEN consensus >= b THEN 2 "
    "WHEN consensus >= c THEN 3 ELSE 4 END AS tier FROM cons, q"))
def consensus_tiers_score(spark, folder):
    return rounded(tournament.tiers_by_score(tournament.consensus(importances(spark, folder))), consensus=6)


@register("feature_sets", scores_sql(IMPORTANCE +
    ", r AS (SELECT *, row_number() OVER (ORDER BY consensus DESC, feature) AS rank, count(*) OVER () AS n FROM cons), "
    "t AS (SELECT feature, CASE WHEN rank <= ceil(n * 2 / 10) THEN 1 WHEN rank <= ceil(n * 5 / 10) THEN 2 WHEN rank <= ceil(n * 8 / 10) "
    "THEN 3 ELSE 4 END AS tier FROM r), s AS (SELECT position, variant, string_agg(feature, ',' ORDER BY feature) AS features FROM t "
    "JOIN (VALUES (0, 'tier12', 2), (1, 'tier123', 3), (2, 'full', 4)) v(position, variant, top) ON tier <= top GROUP BY 1, 2) "
    "SELECT variant, features FROM (SELECT *, row_number() OVER (PARTITION BY features ORDER BY position) AS k FROM s) WHERE k = 1"))
def feature_sets(spark, folder):
    tiers = tournament.tiers_by_rank(tournament.consensus(importances(spark, folder)))
    return tournament.feature_sets(tiers).select("variant", F.concat_ws(",", "features").alias("features"))


@register("importance_matrix", scores_sql(IMPORTANCE + "SELECT feature, " + ", ".join(
    f"round(max(importance) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS) + " FROM imp GROUP BY feature"))
def importance_matrix(spark, folder):
    return rounded(tournament.importance_matrix(importances(spark, folder), MODELS), **{m: 6 for m in MODELS})


@register("importance_agreement", scores_sql(IMPORTANCE +
    ", x AS (SELECT feature, max(importance) FILTER (model = 'informed') AS a, max(importance) FILTER (model = 'sharp') AS b FROM imp "
    "GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM x) SELECT 'informed' AS model_1, "
    "'sharp' AS model_2, count(*) AS features, round(corr(ra, rb), 6) AS spearman FROM r"))
def importance_agreement(spark, folder):
    return rounded(tournament.importance_agreement(importances(spark, folder), "informed", "sharp"), spearman=6)


@register("refinement_trace", scores_sql(
    ", y AS (SELECT s.model, CAST(issue_year - 1994 AS INTEGER) AS round, avg(s.label) * 0.9 + avg(score) * 0.1 AS score FROM scores s "
    "JOIN resolved USING (id) GROUP BY 1, 2), r AS (SELECT round, count(*) AS models_evaluated, max(score) AS best_score, "
    "arg_min(model, struct_pack(s := -score, m := model)) AS best_model FROM y WHERE round <= 5 GROUP BY 1), p AS (SELECT round, "
    "count(*) FILTER (best_score - score > 0.03) AS models_pruned FROM y JOIN r USING (round) GROUP BY 1), g AS (SELECT *, "
    "best_score - lag(best_score) OVER (ORDER BY round) AS improvement FROM r JOIN p USING (round)), e AS (SELECT *, coalesce(abs(improvement) "
    "< 0.002, false) AS converged FROM g), f AS (SELECT *, coalesce(max(CAST(converged AS INTEGER)) OVER (ORDER BY round ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e) SELECT round, models_evaluated, best_model, round(best_score, 6) AS best_score, "
    "models_pruned, round(improvement, 6) AS improvement, converged, CASE WHEN converged THEN 'Converged' WHEN round = 5 THEN "
    "'Round limit' ELSE 'Continuing' END AS status FROM f WHERE ended = 0"))
def refinement_trace(spark, folder):
    per_year = with_scores(resolved_loans(spark, folder, [])).groupBy((F.col("issue_year") - 1994).alias("round")).agg(
        F.avg(F.col("default_flag").cast("double")).alias("rate"), *[F.avg(m).alias(m) for m in MODELS])
    trace = struct_rows(per_year, ["round"], [
        F.struct(F.lit(m).alias("model"), (F.col("rate") * 0.9 + F.col(m) * 0.1).alias("score")) for m in MODELS])
    return rounded(tournament.refinement_trace(trace), best_score=6, improvement=6)


@register("early_stopping",
    "WITH h AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY d) AS iteration, metric FROM (SELECT event_type, "
    "CAST(ts AS DATE) AS d, avg(value) AS metric FROM events GROUP BY 1, 2)), b AS (SELECT *, max(metric) OVER (PARTITION BY event_type "
    "ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h), s AS (SELECT *, iteration - max(CASE WHEN prev "
    "IS NULL OR metric > prev THEN iteration END) OVER (PARTITION BY event_type ORDER BY iteration) AS since FROM b) SELECT event_type, "
    "count(*) AS iterations, CAST(min(iteration) FILTER (since >= 5) AS INTEGER) AS stopped_at, round(max(metric), 6) AS best_metric, "
    "round(CASE WHEN min(iteration) FILTER (since >= 5) IS NOT NULL AND count(*) > 5 THEN greatest(0, 1 - (min(iteration) FILTER "
    "(since >= 5) - 1) / count(*)) ELSE 0 END, 6) AS saved_share FROM s GROUP BY 1")
def early_stopping(spark, folder):
    from pyspark.sql import Window

    from loanstrata.plans.tape import table
    daily = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("metric"))
    # One row per type and day: the window sorts days, not events.
    history = daily.withColumn("iteration", F.row_number().over(Window.partitionBy("event_type").orderBy("d")))
    out = tournament.early_stop(history, ["event_type"], patience=5)
    return rounded(out, best_metric=6, saved_share=6)


def _phases(spark, folder):
    made = entries(spark, folder).select("model", F.col("auc").alias("score"), "ks", "accuracy")
    found = small_table(made) or made
    refined = found.where("score > 0.5").select(
        F.when(F.col("score") > 0.8, F.concat("model", F.lit("|full|iter1"))).otherwise(F.col("model")).alias("model"),
        (F.col("score") + 0.01).alias("score"), F.col("ks").alias("refined_ks"))
    return found, refined


_REFINED = (", ref AS (SELECT CASE WHEN auc > 0.8 THEN concat(model, '|full|iter1') ELSE model END AS model, auc + 0.01 AS score, "
            "ks AS refined_ks FROM entries WHERE auc > 0.5) ")


@register("leaderboard_union", scores_sql(ENTRIES + _REFINED +
    ", u AS (SELECT 1 AS phase, model, accuracy, ks, CAST(NULL AS DOUBLE) AS refined_ks, auc AS score FROM entries UNION ALL SELECT 3, "
    "model, NULL, NULL, refined_ks, score FROM ref WHERE model NOT IN (SELECT model FROM entries)) SELECT CAST(row_number() OVER (ORDER BY "
    "phase, score DESC, model) AS INTEGER) AS rank, phase, model, round(accuracy, 6) AS accuracy, round(ks, 6) AS ks, "
    "round(refined_ks, 6) AS refined_ks, round(score, 6) AS score FROM u"))
def leaderboard_union(spark, folder):
    return rounded(tournament.export_leaderboard(*_phases(spark, folder)), accuracy=6, ks=6, refined_ks=6, score=6)


@register("tournament_summary", scores_sql(ENTRIES + _REFINED +
    ", f AS (SELECT model, auc AS score, row_number() OVER (ORDER BY auc DESC, model) AS r FROM entries), g AS (SELECT model, score, "
    "row_number() OVER (ORDER BY score DESC, model) AS r FROM ref) SELECT CASE WHEN y.score > x.score THEN y.model ELSE x.model END AS champion, "
    "z.model AS runner_up, (SELECT count(*) FROM f) AS phase1_count, (SELECT count(*) FROM g) AS phase3_count, "
    "round(x.score, 6) AS phase1_best_score, round(y.score, 6) AS phase3_best_score, round(y.score - x.score, 6) AS "
    "improvement_from_refinement FROM f x, f z, g y WHERE x.r = 1 AND z.r = 2 AND y.r = 1"))
def tournament_summary(spark, folder):
    out = tournament.tournament_summary(*_phases(spark, folder))
    return rounded(out, phase1_best_score=6, phase3_best_score=6, improvement_from_refinement=6)


@register("weight_validity", scores_sql(
    ", p(m, rubric, weight) AS (SELECT model, 'by_count', count(*) FROM scores WHERE label = 1 GROUP BY 1 UNION ALL SELECT model, "
    "'by_score', sum(score) FROM scores GROUP BY 1), s AS (SELECT rubric, weight / sum(weight) OVER (PARTITION BY rubric) AS weight FROM p "
    "UNION ALL SELECT 'unscaled', weight FROM p WHERE rubric = 'by_score') SELECT rubric, round(sum(weight), 6) AS total, count(*) FILTER "
    "(weight < 0 OR weight > 1) AS outside, abs(sum(weight) - 1) <= 1e-6 AND count(*) FILTER (weight < 0 OR weight > 1) = 0 AS valid FROM s "
    "GROUP BY 1"))
def weight_validity(spark, folder):
    from pyspark.sql import Window
    per = scores(spark, folder).groupBy("model").agg(
        F.sum("label").cast("double").alias("by_count"), F.sum("score").alias("by_score"))
    long = struct_rows(per, ["model"], [
        F.struct(F.lit(c).alias("rubric"), F.col(c).alias("w")) for c in ("by_count", "by_score")])
    weights = long.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("rubric")))
    unscaled = long.where("rubric = 'by_score'").select(F.lit("unscaled").alias("rubric"), F.col("w").alias("weight"))
    return rounded(tournament.weight_validity(weights.select("rubric", "weight").unionByName(unscaled)), total=6)
