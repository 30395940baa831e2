"""Profiling, missing-value and target-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import clean, profile, quality
from loanstrata.plans.tape import NUMERIC_COLUMNS, loan_tape, resolved_loans, table
from loanstrata.registered import register
from loanstrata.registered.sql import unpivot, with_tape
from loanstrata.sources import tables
from loanstrata.session import pin

NULLABLE = ["annual_inc", "dti", "emp_length", "purpose", "revol_bal", "total_acc"]
TEXTS = ["loan_status", "grade", "purpose", "home_ownership"]


def rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def digits(columns: list[str]) -> dict[str, int]:
    """Moments to four decimals; values of the data and interpolations between them exactly."""
    return {c: 4 if c in ("mean", "std") else 7 for c in columns if c not in ("feature", "n")}


@register("key_report", "SELECT count(*) AS row_count, count(*) FILTER (l_orderkey IS NULL) AS null_key_count, "
          "count(DISTINCT l_orderkey) AS distinct_keys, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem "
          "GROUP BY 1 HAVING count(*) > 1)) AS duplicate_key_count FROM lineitem")
def key_report(spark, folder):
    return profile.key_report(table(spark, folder, "lineitem"), "l_orderkey")


@register("duplicate_keys", "SELECT l_orderkey, count(*) AS cnt FROM lineitem GROUP BY 1 HAVING count(*) > 1 "
          "ORDER BY cnt DESC, l_orderkey LIMIT 50")
def duplicate_keys(spark, folder):
    return profile.duplicate_keys(table(spark, folder, "lineitem"), "l_orderkey")


@register("vintage_coverage", "SELECT strftime(o_orderdate, '%b-%Y') AS issue_d, count(*) AS cnt FROM orders "
          "GROUP BY 1, date_trunc('month', o_orderdate) ORDER BY date_trunc('month', o_orderdate) DESC LIMIT 48")
def vintage_coverage(spark, folder):
    return profile.vintage_coverage(loan_tape(spark, folder, ["issue_d"]))


@register("core_ranges", with_tape(
    "SELECT 'loan_amnt' AS \"column\", round(min(loan_amnt), 4) AS min_value, round(max(loan_amnt), 4) AS max_value "
    "FROM tape UNION ALL SELECT 'annual_inc', round(min(annual_inc), 4), round(max(annual_inc), 4) FROM tape "
    "UNION ALL SELECT 'dti', round(min(dti), 4), round(max(dti), 4) FROM tape"))
def core_ranges(spark, folder):
    tape = loan_tape(spark, folder, ["loan_amnt", "annual_inc", "dti"])
    ranges = profile.column_ranges(tape, profile.core_numeric_columns(tape))
    return ranges.select("column", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("min_value", "max_value")])


@register("baseline_scan", with_tape(
    "SELECT 'row_count' AS section, '' AS item, count(*) AS n FROM tape UNION ALL "
    "SELECT 'null_key', '', count(*) FILTER (id IS NULL) FROM tape UNION ALL "
    "SELECT 'loan_status', loan_status, count(*) FROM tape GROUP BY loan_status UNION ALL "
    "SELECT 'grade', grade, count(*) FROM tape GROUP BY grade UNION ALL "
    "SELECT 'purpose', coalesce(purpose, ''), count(*) FROM tape GROUP BY purpose UNION ALL "
    "SELECT 'home_ownership', home_ownership, count(*) FROM tape GROUP BY home_ownership"))
def baseline_scan(spark, folder):
    return quality.baseline_scan(loan_tape(spark, folder, ["id", *TEXTS]), "id")


@register("profile_overview", with_tape(
    "SELECT \"column\", count(*) AS rows, count(*) - count(value) AS null_count, "
    "round((count(*) - count(value)) / count(*), 6) AS null_rate, count(DISTINCT value) AS unique_count, "
    "CASE WHEN \"column\" = 'id' THEN 'identifier' WHEN \"column\" = 'issue_d' THEN 'date' "
    "WHEN count(DISTINCT value) <= 2 THEN 'binary' WHEN \"column\" IN ('grade', 'purpose', 'term', 'emp_length') "
    "THEN 'nominal' WHEN count(DISTINCT value) <= 20 THEN 'ordinal' ELSE 'continuous' END AS feature_type FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM tape" for c in
                         ["id", "issue_d", "loan_amnt", "grade", "purpose", "term", "emp_length", "open_acc", "dti"])
    + ") GROUP BY \"column\""))
def profile_overview(spark, folder):
    tape = loan_tape(spark, folder, ["id", "issue_d", "loan_amnt", "grade", "purpose", "term", "emp_length",
                                     "open_acc", "dti"])
    wide = profile.column_overview(tape)
    return wide.select("column", "rows", "null_count", F.round("null_rate", 6).alias("null_rate"), "unique_count",
                       "feature_type")


@register("profile_numeric", with_tape(
    "SELECT feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, "
    "round(min(value), 7) AS min, round(max(value), 7) AS max, round(quantile_cont(value, 0.01), 7) AS p01, "
    "round(quantile_cont(value, 0.25), 7) AS p25, round(quantile_cont(value, 0.5), 7) AS p50, "
    "round(quantile_cont(value, 0.75), 7) AS p75, round(quantile_cont(value, 0.99), 7) AS p99 FROM ("
    + unpivot(NUMERIC_COLUMNS) + ") GROUP BY feature"))
def profile_numeric(spark, folder):
    summary = profile.numeric_summary(pin(loan_tape(spark, folder, NUMERIC_COLUMNS)), NUMERIC_COLUMNS)
    return rounded(summary, **digits(summary.columns))


@register("profile_topk", with_tape(
    "SELECT \"column\", value, n, rank FROM (SELECT \"column\", value, n, CAST(row_number() OVER (PARTITION BY "
    "\"column\" ORDER BY n DESC, value) AS INTEGER) AS rank FROM (SELECT \"column\", value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM tape"
                         for c in ["sub_grade", "purpose", "int_rate", "emp_length", "issue_d"])
    + ") WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 10"))
def profile_topk(spark, folder):
    columns = ["sub_grade", "purpose", "int_rate", "emp_length", "issue_d"]
    return profile.top_values(loan_tape(spark, folder, columns), columns)


@register("category_shares", with_tape(
    "SELECT home_ownership, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tape GROUP BY 1"))
def category_shares(spark, folder):
    return rounded(profile.share_distribution(loan_tape(spark, folder, ["home_ownership"]), "home_ownership"), share=6)


@register("missing_patterns", with_tape(
    "SELECT pattern, count(*) AS row_count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM ("
    "SELECT concat_ws('|', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in sorted(NULLABLE))
    + ") AS pattern FROM tape) GROUP BY pattern ORDER BY row_count DESC, pattern LIMIT 20"))
def missing_patterns(spark, folder):
    return rounded(profile.missing_patterns(loan_tape(spark, folder, NULLABLE), NULLABLE), pct=6)


@register("comissing_pairs", with_tape(
    ", f AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}" for c in NULLABLE) + " FROM tape) "
    "SELECT col_a, col_b, round(correlation, 6) AS correlation FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS correlation FROM f"
        for i, a in enumerate(NULLABLE) for b in NULLABLE[i + 1:])
    + ") WHERE abs(correlation) > 0.3 ORDER BY abs(correlation) DESC LIMIT 20"))
def comissing_pairs(spark, folder):
    return rounded(profile.co_missing_pairs(loan_tape(spark, folder, NULLABLE), NULLABLE), correlation=6)


@register("segmented_null_rates", with_tape(
    "SELECT segment, \"column\", round(avg(missing), 6) AS null_rate FROM (" + " UNION ALL ".join(
        f"SELECT grade AS segment, '{c}' AS \"column\", CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS missing FROM tape"
        for c in NULLABLE) + ") GROUP BY 1, 2"))
def segmented_null_rates(spark, folder):
    tape = loan_tape(spark, folder, ["grade", *NULLABLE])
    return rounded(profile.segmented_null_rates(tape, "grade", NULLABLE), null_rate=6)


MCAR_NULL, MCAR_TEST = ["annual_inc", "dti", "revol_bal"], ["loan_amnt", "annual_inc", "dti", "installment"]
_WELCH = " UNION ALL ".join(
    f"SELECT '{a}' AS null_column, '{b}' AS test_column, count({b}) FILTER ({a} IS NOT NULL) AS n_present, "
    f"count({b}) FILTER ({a} IS NULL) AS n_missing, avg({b}) FILTER ({a} IS NOT NULL) AS ap, "
    f"avg({b}) FILTER ({a} IS NULL) AS am, var_samp({b}) FILTER ({a} IS NOT NULL) AS vp, "
    f"var_samp({b}) FILTER ({a} IS NULL) AS vm FROM tape"
    for a in MCAR_NULL for b in MCAR_TEST if a != b)


@register("mcar_welch_t", with_tape(
    f"SELECT null_column, test_column, n_present, n_missing, round((ap - am) / sqrt(vp / n_present + vm / n_missing), 5) "
    "AS t_statistic, round((vp / n_present + vm / n_missing) ** 2 / ((vp / n_present) ** 2 / (n_present - 1) + "
    f"(vm / n_missing) ** 2 / (n_missing - 1)), 3) AS welch_df FROM ({_WELCH}) WHERE n_present >= 10 AND n_missing >= 10"))
def mcar_welch_t(spark, folder):
    tape = loan_tape(spark, folder, list(dict.fromkeys(MCAR_NULL + MCAR_TEST)))
    return rounded(profile.welch_by_missingness(tape, MCAR_NULL, MCAR_TEST), t_statistic=5, welch_df=3)


@register("mcar_flags")
def mcar_flags(spark, folder):
    tape = loan_tape(spark, folder, ["id", *dict.fromkeys(MCAR_NULL + MCAR_TEST)])
    # Large loans lose a seventh of their dti, so that one gap is not random.
    gaps = tape.withColumn("dti", F.when(~((F.col("loan_amnt") > 25000) & (F.col("id") % 7 == 0)), F.col("dti")))
    return profile.mcar_flags(gaps, MCAR_NULL, MCAR_TEST)


@register("class_balance", with_tape(
    "SELECT total, positives, negatives, round(m / total, 6) AS minority_ratio, CASE WHEN m / total < 0.05 THEN 'severe' "
    "WHEN m / total < 0.15 THEN 'moderate' WHEN m / total < 0.30 THEN 'mild' ELSE 'balanced' END AS severity, "
    "m / total < 0.05 AS imbalanced, round(total / (2 * positives), 6) AS weight_positive, "
    "round(total / (2 * negatives), 6) AS weight_negative, "
    "CAST(greatest(0, floor(greatest(positives, negatives) * 0.5) - m) AS BIGINT) AS synthetic_rows_needed, "
    "round(negatives / greatest(positives, 1), 6) AS scale_pos_weight FROM (SELECT total, positives, "
    "total - positives AS negatives, least(positives, total - positives) AS m FROM (SELECT count(*) AS total, "
    "CAST(sum(default_flag) AS BIGINT) AS positives FROM resolved))"))
def class_balance(spark, folder):
    return rounded(profile.class_balance(resolved_loans(spark, folder, []), "default_flag"), minority_ratio=6,
                   weight_positive=6, weight_negative=6, scale_pos_weight=6)


@register("vintage_default_rate", with_tape(
    "SELECT issue_d, count(*) AS total, CAST(sum(default_flag) AS BIGINT) AS defaults, "
    "round(avg(default_flag), 6) AS default_rate FROM resolved GROUP BY issue_d"))
def vintage_default_rate(spark, folder):
    return rounded(profile.vintage_default_rate(resolved_loans(spark, folder, [])), default_rate=6)


@register("default_rate_by_year", with_tape(
    "SELECT issue_year, count(*) AS total, CAST(sum(default_flag) AS BIGINT) AS defaults, "
    "round(avg(default_flag), 6) AS default_rate FROM resolved GROUP BY issue_year"))
def default_rate_by_year(spark, folder):
    return rounded(profile.vintage_default_rate(resolved_loans(spark, folder, []), "issue_year"), default_rate=6)


@register("default_target_report", with_tape(
    "SELECT count(*) AS total, CAST(sum(default_flag) AS BIGINT) AS defaults, round(avg(default_flag), 6) AS default_rate, "
    "round(least(avg(default_flag), 1 - avg(default_flag)) * 100, 4) AS minority_pct, "
    "least(avg(default_flag), 1 - avg(default_flag)) * 100 >= 5 AS minority_adequate, "
    "CASE WHEN avg(default_flag) < 0.01 THEN 'very low' WHEN avg(default_flag) > 0.5 THEN 'very high' ELSE 'normal' END "
    "AS assessment FROM resolved"))
def default_target_report(spark, folder):
    return rounded(profile.default_target_report(resolved_loans(spark, folder, [])), default_rate=6, minority_pct=4)


TARGETS_SQL = """, targets AS (
  SELECT id, default_flag, grade, purpose, issue_year, split, funded_amnt, CASE WHEN funded_amnt <> 0 THEN greatest(0, least(1, 1 - (coalesce(recoveries, 0)
    - coalesce(collection_recovery_fee, 0)) / funded_amnt)) END AS lgd, coalesce(out_prncp, 0) AS ead,
    CASE WHEN funded_amnt <> 0 THEN coalesce(out_prncp, 0) / funded_amnt END AS ccf FROM resolved) """
TARGET_INPUTS = ["funded_amnt", "recoveries", "collection_recovery_fee", "out_prncp"]


@register("loss_target_report", with_tape(TARGETS_SQL +
    "SELECT count(*) AS n_default, count(*) FILTER (lgd > 0) AS n_loss, count(*) FILTER (lgd <= 0) AS n_no_loss, "
    "round(count(*) FILTER (lgd > 0) / count(*), 6) AS loss_share, round(avg(lgd) FILTER (lgd > 0), 6) AS severity_mean, "
    "round(quantile_cont(lgd, 0.5) FILTER (lgd > 0), 6) AS severity_median, "
    "round(stddev_samp(lgd) FILTER (lgd > 0), 6) AS severity_std, round(min(lgd) FILTER (lgd > 0), 6) AS severity_min, "
    "round(max(lgd), 6) AS severity_max, round(quantile_cont(lgd, 0.25) FILTER (lgd > 0), 6) AS severity_p25, "
    "round(quantile_cont(lgd, 0.75) FILTER (lgd > 0), 6) AS severity_p75 FROM targets WHERE default_flag = 1"))
def loss_target_report(spark, folder):
    loans = clean.with_targets(pin(resolved_loans(spark, folder, TARGET_INPUTS))).where("default_flag = 1")
    out = profile.loss_target_report(loans)
    return rounded(out, **{c: 6 for c in out.columns if not c.startswith("n_")})


@register("exposure_target_report", with_tape(TARGETS_SQL +
    "SELECT feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, "
    "round(min(value), 7) AS min, round(max(value), 7) AS max, round(quantile_cont(value, 0.05), 7) AS p05, "
    "round(quantile_cont(value, 0.25), 7) AS p25, round(quantile_cont(value, 0.5), 7) AS p50, "
    "round(quantile_cont(value, 0.75), 7) AS p75, round(quantile_cont(value, 0.95), 7) AS p95 FROM ("
    + unpivot(["ead", "ccf"], source="targets") + ") GROUP BY feature"))
def exposure_target_report(spark, folder):
    out = profile.exposure_target_report(clean.with_targets(pin(resolved_loans(spark, folder, TARGET_INPUTS))))
    return rounded(out, **digits(out.columns))


@register("conversion_factor_shares", with_tape(TARGETS_SQL +
    "SELECT default_flag, count(*) AS n, round(avg(ead), 4) AS ead_mean, round(avg(ccf), 6) AS ccf_mean, "
    "round(avg(CASE WHEN ccf > 1 THEN 1 ELSE 0 END) * 100, 4) AS pct_above_one, "
    "round(avg(CASE WHEN ccf = 1 THEN 1 ELSE 0 END) * 100, 4) AS pct_equal_one, "
    "round(avg(CASE WHEN ccf < 0.5 THEN 1 ELSE 0 END) * 100, 4) AS pct_below_half "
    "FROM targets WHERE ccf IS NOT NULL GROUP BY default_flag"))
def conversion_factor_shares(spark, folder):
    out = profile.conversion_factor_shares(clean.with_targets(resolved_loans(spark, folder, TARGET_INPUTS)))
    return rounded(out, ead_mean=4, ccf_mean=6, pct_above_one=4, pct_equal_one=4, pct_below_half=4)


@register("outliers_z_iqr", with_tape(
    ", v AS (" + unpivot(NUMERIC_COLUMNS) + "), s AS (SELECT feature, count(*) AS n, avg(value) AS m, "
    "stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1) "
    "SELECT feature, n, count(*) FILTER (abs(value - m) / nullif(sd, 0) > 4) AS z_outliers, "
    "round(count(*) FILTER (abs(value - m) / nullif(sd, 0) > 4) / n, 6) AS z_rate, "
    "count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS iqr_outliers, "
    "round(count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) / n, 6) AS iqr_rate, "
    "round(q1 - 3 * (q3 - q1), 7) AS iqr_lower, round(q3 + 3 * (q3 - q1), 7) AS iqr_upper "
    "FROM v JOIN s USING (feature) GROUP BY feature, n, q1, q3"))
def outliers_z_iqr(spark, folder):
    out = quality.outliers(pin(loan_tape(spark, folder, NUMERIC_COLUMNS)), NUMERIC_COLUMNS)
    return rounded(out, z_rate=6, iqr_rate=6, iqr_lower=7, iqr_upper=7)


@register("outliers_iqr_15", with_tape(
    ", v AS (" + unpivot(NUMERIC_COLUMNS) + "), s AS (SELECT feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1) SELECT feature, "
    "round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / n, 6) AS outlier_pct, "
    "count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / n < 10 AS passed "
    "FROM v JOIN s USING (feature) GROUP BY feature, n"))
def outliers_iqr_15(spark, folder):
    return rounded(quality.iqr_screen(pin(loan_tape(spark, folder, NUMERIC_COLUMNS)), NUMERIC_COLUMNS), outlier_pct=6)


@register("outliers_percentile", with_tape(
    ", v AS (" + unpivot(NUMERIC_COLUMNS) + "), s AS (SELECT feature, quantile_cont(value, 0.01) AS lo, "
    "quantile_cont(value, 0.99) AS hi FROM v GROUP BY 1) SELECT feature, count(*) FILTER (value < lo) AS below, "
    "count(*) FILTER (value > hi) AS above FROM v JOIN s USING (feature) GROUP BY feature"))
def outliers_percentile(spark, folder):
    return quality.percentile_outliers(pin(loan_tape(spark, folder, NUMERIC_COLUMNS)), NUMERIC_COLUMNS)


@register("completeness", with_tape(
    "SELECT round((" + " + ".join(f"count({c})" for c in NULLABLE) + f") / (count(*) * {len(NULLABLE)}), 6) AS completeness, "
    "(" + " + ".join(f"count({c})" for c in NULLABLE) + f") / (count(*) * {len(NULLABLE)}) >= 0.95 AS passed FROM tape"))
def completeness(spark, folder):
    return rounded(quality.completeness(loan_tape(spark, folder, NULLABLE)), completeness=6)


@register("range_rules", with_tape(
    "SELECT feature, count(*) FILTER (value < lo) AS below, count(*) FILTER (value > hi) AS above, "
    "count(*) FILTER (value < lo OR value > hi) = 0 AS passed FROM ("
    + unpivot(["loan_amnt", "annual_inc", "dti"]) + ") JOIN (VALUES ('loan_amnt', 100, 100000), "
    "('annual_inc', 0, 10000000), ('dti', 0, 100)) r(feature, lo, hi) USING (feature) GROUP BY feature"))
def range_rules(spark, folder):
    return quality.range_rules(loan_tape(spark, folder, ["loan_amnt", "annual_inc", "dti"]))


@register("temporal_order", "SELECT count(*) AS checked, count(*) FILTER (l_shipdate < o_orderdate) AS violations, "
          "count(*) FILTER (l_shipdate < o_orderdate) = 0 AS passed FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def temporal_order(spark, folder):
    both = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.expr("l_orderkey = o_orderkey"))
    return quality.temporal_order(both, "o_orderdate", "l_shipdate")


@register("data_appropriateness", with_tape(
    "SELECT t.*, round(s.top, 6) AS top_status_share, t.span_years >= 5 AND t.defaults >= 100 AND t.grades >= 5 "
    "AND t.terms >= 2 AND s.top < 0.95 AS passed FROM (SELECT CAST(max(issue_year) - min(issue_year) + 1 AS INTEGER) "
    "AS span_years, CAST(sum(default_flag) AS BIGINT) AS defaults, count(DISTINCT grade) AS grades, "
    "count(DISTINCT term) AS terms FROM tape) t, (SELECT max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM tape "
    "GROUP BY loan_status)) s"))
def data_appropriateness(spark, folder):
    tape = loan_tape(spark, folder, ["issue_d", "loan_status", "grade", "term"])
    return rounded(quality.appropriateness(tape), top_status_share=6)


@register("numeric_text_share", with_tape(
    "SELECT \"column\", round(avg(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END), 6) AS numeric_share, "
    "avg(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) > 0.9 AS coerce FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} AS value FROM tape" for c, e in
                         [("int_rate", "replace(int_rate, '%', '')"), ("grade", "grade"), ("purpose", "purpose")])
    + ") WHERE value IS NOT NULL GROUP BY 1"))
def numeric_text_share(spark, folder):
    tape = loan_tape(spark, folder, ["int_rate", "grade", "purpose"])
    bare = tape.withColumn("int_rate", F.replace("int_rate", F.lit("%"), F.lit("")))
    return rounded(quality.numeric_text_share(bare, bare.columns), numeric_share=6)


@register("non_negative_encodings", with_tape(
    "SELECT feature, round(min(value), 4) AS lowest, min(value) >= 0 AS passed FROM ("
    + unpivot(["open_acc", "total_acc", "dti"]) + ") GROUP BY feature"))
def non_negative_encodings(spark, folder):
    columns = ["open_acc", "total_acc", "dti"]
    return rounded(quality.non_negative(loan_tape(spark, folder, columns), columns), lowest=4)


@register("hash_sample", "SELECT o_orderkey AS id, round(o_totalprice / 10, 4) AS loan_amnt FROM orders "
          "ORDER BY md5(concat(o_orderkey, '-42')), o_orderkey LIMIT 1000")
def hash_sample(spark, folder):
    return rounded(tables.random_sample(loan_tape(spark, folder, ["id", "loan_amnt"]), "id", 1000, seed=42), loan_amnt=4)


@register("read_only_sql", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
          "GROUP BY o_orderstatus")
def read_only_sql(spark, folder):
    return tables.run_sql(
        spark, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} "
        "GROUP BY o_orderstatus", limit=200, orders=table(spark, folder, "orders"))


@register("preview", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark, folder):
    return tables.preview(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@register("alignment_check", "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(DISTINCT l_orderkey) "
          "FROM lineitem) AS right_rows, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM "
          "lineitem)) AS only_left, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN "
          "(SELECT o_orderkey FROM orders)) AS only_right")
def alignment_check(spark, folder):
    left = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    right = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return tables.alignment(left, right, "id")
