"""Feature engineering and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import clean, features, profile
from loanstrata.plans.tape import NUMERIC_COLUMNS, resolved_loans
from loanstrata.registered import register
from loanstrata.registered.profiling import rounded
from loanstrata.registered.sql import unpivot, with_tape
from loanstrata.session import pin

RATIO_INPUTS = ["loan_amnt", "annual_inc", "installment", "revol_bal", "tot_cur_bal", "total_rev_hi_lim", "open_acc",
                "total_acc"]
RATIOS_SQL = """, ratios AS (SELECT id, default_flag, split, coalesce(loan_amnt / nullif(annual_inc, 0), 0) AS loan_to_income,
  coalesce(installment / nullif(annual_inc / 12, 0), 0) AS installment_to_income,
  coalesce(revol_bal / nullif(tot_cur_bal + 1, 0), 0) AS revol_to_total,
  coalesce(revol_bal / nullif(total_rev_hi_lim + 1, 0), 0) AS credit_utilization,
  coalesce(open_acc / nullif(total_acc + 1, 0), 0) AS open_acc_ratio FROM resolved) """
RATIO_NAMES = list(features.RATIOS)


def ratios(spark, folder):
    return features.ratio_features(resolved_loans(spark, folder, RATIO_INPUTS))


@register("ratio_features", with_tape(RATIOS_SQL + "SELECT id, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in RATIO_NAMES) + " FROM ratios"))
def ratio_features(spark, folder):
    return rounded(ratios(spark, folder).select("id", *RATIO_NAMES), **{c: 6 for c in RATIO_NAMES})


@register("ratio_summary", with_tape(RATIOS_SQL +
    "SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, "
    "round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.01), 6) AS p01, "
    "round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM ("
    + unpivot(RATIO_NAMES, source="ratios") + ") GROUP BY feature"))
def ratio_summary(spark, folder):
    out = profile.numeric_summary(pin(ratios(spark, folder)), RATIO_NAMES, [0.01, 0.5, 0.99])
    return rounded(out, **{c: 6 for c in out.columns if c not in ("feature", "n")})


WOE_FEATURES = ["loan_amnt", "annual_inc", "dti", "revol_bal", "open_acc"]


def _binned(bins: int) -> str:
    """Right-closed quantile bins; repeated edges once; then event counts per bin."""
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return (", v AS (" + unpivot(WOE_FEATURES, "default_flag AS y", "resolved") + "), e AS (SELECT feature, "
            f"quantile_cont(value, [{probs}]) AS q FROM v GROUP BY 1), c AS (SELECT feature, list_sort(list_distinct("
            f"list_filter(q[2:{bins}], lambda x: x > q[1] AND x < q[{bins + 1}]))) AS cuts FROM e), counts AS (SELECT feature, "
            "CAST(len(list_filter(cuts, lambda x: value > x)) AS INTEGER) AS bin, count(*) AS n, sum(y) AS events "
            "FROM v JOIN c USING (feature) GROUP BY 1, 2), s AS (SELECT *, events / sum(events) OVER w AS ev, "
            "(n - events) / sum(n - events) OVER w AS ne, n / sum(n) OVER w AS count_pct FROM counts "
            "WINDOW w AS (PARTITION BY feature)), f AS (SELECT *, CASE WHEN ev > 0 THEN ev ELSE 0.0001 END AS fe, "
            "CASE WHEN ne > 0 THEN ne ELSE 0.0001 END AS fn FROM s), woe AS (SELECT feature, bin, n, count_pct, "
            "events / n AS event_rate, ln(fn / fe) AS woe, (fn - fe) * ln(fn / fe) AS iv FROM f) ")


@register("woe_iv_quantile", with_tape(_binned(10) +
    "SELECT feature, bin, n, round(count_pct, 6) AS count_pct, round(event_rate, 6) AS event_rate, round(woe, 6) AS woe, "
    "round(iv, 7) AS iv FROM woe"))
def woe_iv_quantile(spark, folder):
    loans = pin(resolved_loans(spark, folder, WOE_FEATURES))
    counts = features.binned_events(loans, "default_flag", features.quantile_cuts(loans, WOE_FEATURES, 10))
    return rounded(features.woe_rows(counts), count_pct=6, event_rate=6, woe=6, iv=7)


@register("quintile_iv", with_tape(_binned(5) +
    "SELECT feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS bins, round(sum(iv), 7) AS iv, CASE WHEN sum(iv) < 0.02 "
    "THEN 'not useful' WHEN sum(iv) < 0.1 THEN 'weak' WHEN sum(iv) < 0.3 THEN 'medium' WHEN sum(iv) < 0.5 THEN 'strong' "
    "ELSE 'suspicious' END AS band FROM woe GROUP BY feature"))
def quintile_iv(spark, folder):
    loans = pin(resolved_loans(spark, folder, WOE_FEATURES))
    counts = features.binned_events(loans, "default_flag", features.quantile_cuts(loans, WOE_FEATURES, 5))
    return rounded(features.information_values(counts), iv=7)


@register("woe_monotone")
def woe_monotone(spark, folder):
    loans = pin(resolved_loans(spark, folder, WOE_FEATURES))
    cuts = features.monotone_cuts(loans, WOE_FEATURES, "default_flag")
    return features.woe_rows(features.binned_events(loans, "default_flag", cuts))


def _optimal(source: str) -> str:
    """The best monotone grouping of ten quantile bins, found by trying every way to join neighbours."""
    probs = ", ".join(str(i / 10) for i in range(11))
    return (", v AS (" + unpivot(WOE_FEATURES, "default_flag AS y", source) + "), e AS (SELECT feature, "
            f"quantile_cont(value, [{probs}]) AS q FROM v GROUP BY 1), c AS (SELECT feature, list_sort(list_distinct("
            "list_filter(q[2:10], lambda x: x > q[1] AND x < q[11]))) AS cuts FROM e), fine AS (SELECT feature, "
            "CAST(len(list_filter(cuts, lambda x: value > x)) AS INTEGER) AS b, count(*) AS n, sum(y)::BIGINT AS e "
            "FROM v JOIN c USING (feature) GROUP BY 1, 2), ix AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY b) - 1 AS i, "
            "count(*) OVER (PARTITION BY feature) AS m, sum(n) OVER (PARTITION BY feature) AS tn, sum(e) OVER (PARTITION BY feature) AS te FROM fine), "
            "ways AS (SELECT feature, mask, bit_count((mask & ((1 << i::INTEGER) - 1))::INTEGER) AS g, max(b) AS last, sum(n) AS n, sum(e) AS e, "
            "any_value(tn) AS tn, any_value(te) AS te FROM ix, generate_series(0, 511) t(mask) WHERE mask < (1 << (m - 1)::INTEGER) GROUP BY ALL), "
            "runs AS (SELECT *, ((n - e) / (tn - te) - e / te) * ln(((n - e) / (tn - te)) / (e / te)) AS iv, "
            "e / n - lag(e / n) OVER (PARTITION BY feature, mask ORDER BY g) AS up FROM ways), "
            "fit AS (SELECT feature, mask, sum(iv) AS iv, count(*) AS k, list(last ORDER BY g) AS lasts FROM runs GROUP BY feature, mask, tn "
            "HAVING k = 1 OR (min(n) >= 0.05 * tn AND min(e) > 0 AND min(n - e) > 0 AND (count(*) FILTER (up > 0) = k - 1 OR count(*) FILTER (up < 0) = k - 1))), "
            "pick AS (SELECT feature, list_transform(lasts[:-2], lambda b: cuts[b + 1]) AS best FROM fit JOIN c USING (feature) "
            "QUALIFY row_number() OVER (PARTITION BY feature ORDER BY iv DESC, k) = 1), "
            "all_v AS (" + unpivot(WOE_FEATURES, "id, default_flag AS y", "resolved") + "), placed AS (SELECT id, feature, y, "
            "CAST(len(list_filter(best, lambda x: value > x)) AS INTEGER) AS bin FROM all_v JOIN pick USING (feature)), "
            "counts AS (SELECT feature, bin, count(*) AS n, sum(y) AS events FROM placed GROUP BY 1, 2), s AS (SELECT *, "
            "events / sum(events) OVER w AS ev, (n - events) / sum(n - events) OVER w AS ne, n / sum(n) OVER w AS count_pct FROM counts "
            "WINDOW w AS (PARTITION BY feature)), f AS (SELECT *, CASE WHEN ev > 0 THEN ev ELSE 0.0001 END AS fe, "
            "CASE WHEN ne > 0 THEN ne ELSE 0.0001 END AS fn FROM s), woe AS (SELECT feature, bin, n, count_pct, "
            "events / n AS event_rate, ln(fn / fe) AS woe, (fn - fe) * ln(fn / fe) AS iv FROM f) ")


@register("woe_optimal", with_tape(_optimal("resolved") +
    "SELECT feature, bin, n, round(count_pct, 6) AS count_pct, round(event_rate, 6) AS event_rate, round(woe, 6) AS woe, round(iv, 7) AS iv FROM woe"))
def woe_optimal(spark, folder):
    loans = pin(resolved_loans(spark, folder, WOE_FEATURES))
    cuts = features.optimal_cuts(loans, WOE_FEATURES, "default_flag", 10)
    return rounded(features.woe_rows(features.binned_events(loans, "default_flag", cuts)), count_pct=6, event_rate=6, woe=6, iv=7)


@register("woe_transform", with_tape(_optimal("(SELECT * FROM resolved WHERE split = 'train')") +
    "SELECT id, " + ", ".join(f"round(max(woe) FILTER (feature = '{c}'), 6) AS {c}_woe" for c in WOE_FEATURES)
    + " FROM resolved LEFT JOIN placed USING (id) LEFT JOIN woe USING (feature, bin) GROUP BY id"))
def woe_transform(spark, folder):
    loans = pin(resolved_loans(spark, folder, WOE_FEATURES))
    cuts = features.optimal_cuts(loans.where("split = 'train'"), WOE_FEATURES, "default_flag", 10)
    out = features.woe_transform(loans, "default_flag", cuts)
    return rounded(out.select("id", *[f"{c}_woe" for c in WOE_FEATURES]), **{f"{c}_woe": 6 for c in WOE_FEATURES})


PAIRS = [(a, b) for i, a in enumerate(NUMERIC_COLUMNS) for b in NUMERIC_COLUMNS[i + 1:]]
CORR = ", c AS (SELECT " + ", ".join(f"corr({a}, {b}) AS \"{a}|{b}\"" for a, b in PAIRS) + " FROM resolved), pairs AS (" \
    + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, \"{a}|{b}\" AS r FROM c" for a, b in PAIRS) + ") "


@register("corr_pairs", with_tape(CORR + "SELECT feature_1, feature_2, round(r, 6) AS r FROM pairs"))
def corr_pairs(spark, folder):
    return rounded(features.correlation_pairs(resolved_loans(spark, folder, NUMERIC_COLUMNS), NUMERIC_COLUMNS), r=6)


@register("corr_summary", with_tape(CORR +
    "SELECT count(*) AS pairs, round(avg(abs(r)), 6) AS mean_abs_r, round(quantile_cont(abs(r), 0.5), 6) AS median_abs_r, "
    "round(max(abs(r)), 6) AS max_abs_r, round(avg(CASE WHEN abs(r) > 0.5 THEN 1 ELSE 0 END) * 100, 4) AS pct_above_half, "
    "round(avg(CASE WHEN abs(r) > 0.85 THEN 1 ELSE 0 END) * 100, 4) AS pct_above_threshold FROM pairs"))
def corr_summary(spark, folder):
    pairs = features.correlation_pairs(resolved_loans(spark, folder, NUMERIC_COLUMNS), NUMERIC_COLUMNS)
    return rounded(features.correlation_summary(pairs), mean_abs_r=6, median_abs_r=6, max_abs_r=6, pct_above_half=4,
                   pct_above_threshold=4)


@register("corr_flagged", with_tape(CORR +
    "SELECT feature_1, feature_2, round(r, 6) AS r FROM pairs WHERE abs(r) > 0.85"))
def corr_flagged(spark, folder):
    pairs = features.correlation_pairs(resolved_loans(spark, folder, NUMERIC_COLUMNS), NUMERIC_COLUMNS)
    return rounded(features.flagged_pairs(pairs), r=6)


@register("vif_two", with_tape(
    ", g AS (SELECT sum(loan_amnt * loan_amnt) AS a, sum(annual_inc * annual_inc) AS b, sum(loan_amnt * annual_inc) AS c "
    "FROM resolved WHERE loan_amnt IS NOT NULL AND annual_inc IS NOT NULL) SELECT f AS feature, "
    "round(1 / (1 - c * c / (a * b)), 5) AS vif, 1 / (1 - c * c / (a * b)) > 10 AS flagged "
    "FROM g, (VALUES ('loan_amnt'), ('annual_inc')) v(f)"))
def vif_two(spark, folder):
    loans = resolved_loans(spark, folder, ["loan_amnt", "annual_inc"])
    return rounded(features.variance_inflation(loans, ["loan_amnt", "annual_inc"]), vif=5)


@register("vif_two_centered", with_tape(
    ", g AS (SELECT corr(loan_amnt, annual_inc) AS r FROM resolved) SELECT f AS feature, round(1 / (1 - r * r), 5) AS vif, "
    "1 / (1 - r * r) > 10 AS flagged FROM g, (VALUES ('loan_amnt'), ('annual_inc')) v(f)"))
def vif_two_centered(spark, folder):
    loans = resolved_loans(spark, folder, ["loan_amnt", "annual_inc"])
    return rounded(features.variance_inflation(loans, ["loan_amnt", "annual_inc"], centered=True), vif=5)


@register("vif_all")
def vif_all(spark, folder):
    return features.variance_inflation(pin(resolved_loans(spark, folder, NUMERIC_COLUMNS)), NUMERIC_COLUMNS)


@register("select_features")
def select_features(spark, folder):
    # Written once: medians, fill and selection all read the joined loans.
    loans = clean.numeric_only(pin(resolved_loans(spark, folder, NUMERIC_COLUMNS)), ["id", "default_flag", "issue_year"])
    signal = loans.withColumn("planted", F.col("default_flag") * 0.5 + (F.col("id") * 37) % 1000 / 1000)
    found = features.select_features(signal, [*NUMERIC_COLUMNS, "planted"], "default_flag", threshold=0.0005)
    return found.log


@register("feature_matrix_stats", with_tape(
    "SELECT feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, "
    "round(min(value), 4) AS min, round(max(value), 4) AS max, count(DISTINCT value) AS unique_count FROM ("
    + unpivot(["loan_amnt", "dti", "open_acc"], source="resolved") + ") GROUP BY feature"))
def feature_matrix_stats(spark, folder):
    columns = ["loan_amnt", "dti", "open_acc"]
    matrix = features.feature_matrix(pin(resolved_loans(spark, folder, columns)), columns)
    stats = profile.numeric_summary(matrix, columns, [0.5]).drop("p50")
    kinds = profile.column_overview(matrix, columns).select(F.col("column").alias("feature"), "unique_count")
    return rounded(stats.join(kinds, "feature"), mean=4, std=4, min=4, max=4)


@register("z_scale", with_tape(
    ", s AS (SELECT avg(loan_amnt) AS m, stddev_pop(loan_amnt) AS d FROM resolved WHERE split = 'train') "
    "SELECT id, round((loan_amnt - m) / d, 6) AS loan_amnt FROM resolved, s"))
def z_scale(spark, folder):
    loans = resolved_loans(spark, folder, ["loan_amnt"])
    out = features.z_scale(loans, ["loan_amnt"], fit_on=loans.where("split = 'train'"))
    return rounded(out.select("id", "loan_amnt"), loan_amnt=6)
