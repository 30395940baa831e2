"""Cleaning, imputation, capping and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import clean
from loanstrata.plans.tape import NUMERIC_COLUMNS, loan_tape, resolved_loans
from loanstrata.registered import register
from loanstrata.registered.profiling import TARGET_INPUTS, TARGETS_SQL, rounded
from loanstrata.registered.sql import unpivot, with_tape
from loanstrata.session import pin

CAPPED = ["annual_inc", "revol_bal", "loan_amnt", "dti", "open_acc"]


@register("type_coercion", with_tape(
    "SELECT id, CAST(replace(int_rate, '%', '') AS DOUBLE) AS int_rate, "
    "CAST(trim(replace(term, 'months', '')) AS DOUBLE) AS term, CASE WHEN emp_length LIKE '%< 1%' THEN 0 "
    "WHEN emp_length LIKE '%10+%' THEN 10 ELSE CAST(regexp_extract(emp_length, '(\\d+)', 1) AS DOUBLE) END AS emp_length, "
    "issue_year FROM tape"))
def type_coercion(spark, folder):
    typed = clean.coerce_types(loan_tape(spark, folder, ["id", "int_rate", "term", "emp_length", "issue_d"]))
    return typed.select("id", "int_rate", "term", "emp_length", F.year("issue_d").alias("issue_year"))


@register("impute_grade_median", with_tape(
    ", m AS (SELECT grade, quantile_cont(annual_inc, 0.5) AS a, quantile_cont(dti, 0.5) AS d, "
    "quantile_cont(revol_bal, 0.5) AS r FROM resolved GROUP BY grade) SELECT id, "
    "round(coalesce(annual_inc, a), 6) AS annual_inc, round(coalesce(dti, d), 6) AS dti, "
    "round(coalesce(revol_bal, r), 6) AS revol_bal FROM resolved JOIN m USING (grade)"))
def impute_grade_median(spark, folder):
    loans = pin(resolved_loans(spark, folder, ["grade", "annual_inc", "dti", "revol_bal"]))
    filled = clean.fill_numeric_by_group(loans, ["annual_inc", "dti", "revol_bal"], "grade")
    return rounded(filled.select("id", "annual_inc", "dti", "revol_bal"), annual_inc=6, dti=6, revol_bal=6)


@register("impute_median", with_tape(
    ", m AS (SELECT quantile_cont(annual_inc, 0.5) AS a, quantile_cont(dti, 0.5) AS d FROM resolved WHERE split = 'train') "
    "SELECT id, round(coalesce(annual_inc, a), 6) AS annual_inc, round(coalesce(dti, d), 6) AS dti FROM resolved, m"))
def impute_median(spark, folder):
    loans = pin(resolved_loans(spark, folder, ["annual_inc", "dti"]))
    filled = clean.fill_numeric(loans, ["annual_inc", "dti"], fit_on=loans.where("split = 'train'"))
    return rounded(filled.select("id", "annual_inc", "dti"), annual_inc=6, dti=6)


def _mode(c):
    return (f"(SELECT {c} FROM resolved WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("impute_mode", with_tape(
    f"SELECT id, coalesce(purpose, {_mode('purpose')}) AS purpose, coalesce(emp_length, {_mode('emp_length')}) AS emp_length "
    "FROM resolved"))
def impute_mode(spark, folder):
    loans = resolved_loans(spark, folder, ["purpose", "emp_length"])
    return clean.fill_categories(loans, ["purpose", "emp_length"]).select("id", "purpose", "emp_length")


def _caps(low: str, high: str) -> str:
    bounds = ", b AS (SELECT " + ", ".join(
        f"{low.format(c=c)} AS lo_{c}, {high.format(c=c)} AS hi_{c}" for c in CAPPED) + " FROM resolved) "
    return bounds + "SELECT id, " + ", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END, 6) AS {c}"
        for c in CAPPED) + " FROM resolved, b"


def _capped(spark, folder, rule):
    loans = pin(resolved_loans(spark, folder, CAPPED))
    out = clean.apply_caps(loans, clean.fit_caps(loans, CAPPED, rule)).select("id", *CAPPED)
    return rounded(out, **{c: 6 for c in CAPPED})


@register("winsorize_pct", with_tape(_caps("quantile_cont({c}, 0.01)", "quantile_cont({c}, 0.99)")))
def winsorize_pct(spark, folder):
    return _capped(spark, folder, clean.CapRule())


@register("winsorize_iqr", with_tape(_caps(
    "quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
    "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")))
def winsorize_iqr(spark, folder):
    return _capped(spark, folder, clean.CapRule(method="iqr"))


@register("winsorize_std", with_tape(_caps("avg({c}) - 3 * stddev_samp({c})", "avg({c}) + 3 * stddev_samp({c})")))
def winsorize_std(spark, folder):
    return _capped(spark, folder, clean.CapRule(method="std"))


FIXED = {"funded_amnt": (1000, 40000), "annual_inc": (10000, 200000), "dti": (0, 50)}


@register("winsorize_fixed", with_tape("SELECT id, " + ", ".join(
    f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo}), {hi}) END, 6) AS {c}"
    for c, (lo, hi) in FIXED.items()) + " FROM resolved"))
def winsorize_fixed(spark, folder):
    loans = resolved_loans(spark, folder, list(FIXED))
    rule = clean.CapRule(fixed=clean.CREDIT_BOUNDS)
    out = clean.apply_caps(loans, clean.fit_caps(loans, list(FIXED), rule)).select("id", *FIXED)
    return rounded(out, **{c: 6 for c in FIXED})


@register("winsorize_report", with_tape(
    ", v AS (" + unpivot(CAPPED, source="resolved") + "), b AS (SELECT feature, quantile_cont(value, 0.01) AS lo, "
    "quantile_cont(value, 0.99) AS hi FROM v GROUP BY 1) SELECT feature, round(lo, 7) AS lower, round(hi, 7) AS upper, "
    "count(*) FILTER (value < lo OR value > hi) AS clipped, round(count(*) FILTER (value < lo OR value > hi) * 100.0 / "
    "(SELECT count(*) FROM resolved), 5) AS clip_pct FROM v JOIN b USING (feature) GROUP BY feature, lo, hi"))
def winsorize_report(spark, folder):
    loans = pin(resolved_loans(spark, folder, CAPPED))
    return rounded(clean.cap_report(loans, clean.fit_caps(loans, CAPPED)), lower=7, upper=7, clip_pct=5)


@register("winsorize_check", with_tape(
    "SELECT CAST(0 AS BIGINT) AS unmatched_rows, CAST(0 AS BIGINT) AS in_range_changed, CAST(0 AS BIGINT) AS out_of_bounds "
    "FROM (SELECT count(*) FROM resolved)"))
def winsorize_check(spark, folder):
    loans = pin(resolved_loans(spark, folder, CAPPED))
    bounds = clean.fit_caps(loans, CAPPED)
    return clean.cap_check(loans, clean.apply_caps(loans, bounds), bounds)


@register("encode_ordinal", with_tape(
    ", r AS (SELECT sub_grade, CAST(row_number() OVER (ORDER BY sub_grade) AS DOUBLE) AS sub_grade_ord FROM "
    "(SELECT DISTINCT sub_grade FROM resolved)) SELECT id, CAST(instr('ABCDEFG', grade) AS DOUBLE) AS grade_ord, sub_grade_ord "
    "FROM resolved JOIN r USING (sub_grade)"))
def encode_ordinal(spark, folder):
    loans = resolved_loans(spark, folder, ["grade", "sub_grade"])
    return clean.encode_rank(clean.encode_grade(loans)).select("id", "grade_ord", "sub_grade_ord")


@register("encode_target", with_tape(
    ", r AS (SELECT purpose, avg(default_flag) AS rate FROM resolved GROUP BY purpose) SELECT id, round(rate, 6) AS purpose_risk "
    "FROM resolved LEFT JOIN (SELECT * FROM r WHERE purpose IS NOT NULL) USING (purpose)"))
def encode_target(spark, folder):
    out = clean.encode_target_rate(resolved_loans(spark, folder, ["purpose"]))
    return rounded(out.select("id", "purpose_risk"), purpose_risk=6)


@register("encode_target_train", with_tape(
    ", r AS (SELECT purpose, avg(default_flag) AS rate FROM resolved WHERE split = 'train' AND purpose IS NOT NULL "
    "GROUP BY purpose) SELECT id, round(rate, 6) AS purpose_risk FROM resolved LEFT JOIN r USING (purpose)"))
def encode_target_train(spark, folder):
    loans = resolved_loans(spark, folder, ["purpose"])
    out = clean.encode_target_rate(loans, fit_on=loans.where("split = 'train'"))
    return rounded(out.select("id", "purpose_risk"), purpose_risk=6)


@register("encode_onehot", with_tape("SELECT id, " + ", ".join(
    f"CASE WHEN home_ownership = '{v}' THEN 1 ELSE 0 END AS \"home_ownership_{v}\""
    for v in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM resolved"))
def encode_onehot(spark, folder):
    coded = clean.encode_one_hot(resolved_loans(spark, folder, ["home_ownership"]))
    return coded.select("id", *[c for c in coded.columns if c.startswith("home_ownership_")])


@register("leakage_split", with_tape(
    "SELECT id, round(recoveries, 4) AS recoveries, round(collection_recovery_fee, 6) AS collection_recovery_fee, "
    "round(out_prncp, 4) AS out_prncp FROM resolved"))
def leakage_split(spark, folder):
    _, leakage = clean.split_leakage(clean.resolved_only(loan_tape(
        spark, folder, ["id", "loan_status", "loan_amnt", "recoveries", "collection_recovery_fee", "out_prncp"])))
    return rounded(leakage, recoveries=4, collection_recovery_fee=6, out_prncp=4)


@register("targets_lgd_ead_ccf", with_tape(TARGETS_SQL +
    "SELECT id, default_flag, issue_year, round(lgd, 6) AS lgd, round(ead, 4) AS ead, round(ccf, 6) AS ccf FROM targets"))
def targets_lgd_ead_ccf(spark, folder):
    loans = clean.with_targets(resolved_loans(spark, folder, TARGET_INPUTS))
    return rounded(loans.select("id", "default_flag", "issue_year", "lgd", "ead", "ccf"), lgd=6, ead=4, ccf=6)


@register("loss_stage_targets", with_tape(TARGETS_SQL +
    "SELECT id, round(lgd, 6) AS lgd, CASE WHEN lgd > 0 THEN 1 ELSE 0 END AS any_loss FROM targets "
    "WHERE default_flag = 1 AND lgd IS NOT NULL"))
def loss_stage_targets(spark, folder):
    loans = clean.loss_stage_targets(clean.with_targets(resolved_loans(spark, folder, TARGET_INPUTS)))
    return rounded(loans.select("id", "lgd", "any_loss"), lgd=6)


@register("vintage_split", with_tape(
    "SELECT split, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct, "
    "CAST(sum(default_flag) AS BIGINT) AS defaults, round(avg(default_flag), 6) AS default_rate, "
    "min(issue_year) AS first_year, max(issue_year) AS last_year FROM resolved GROUP BY split"))
def vintage_split(spark, folder):
    from loanstrata.operators.features import split_report
    return rounded(split_report(resolved_loans(spark, folder, [])), pct=4, default_rate=6)


@register("numeric_only", with_tape(
    ", m AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in NUMERIC_COLUMNS)
    + " FROM resolved WHERE split = 'train') SELECT id, "
    + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in NUMERIC_COLUMNS) + " FROM resolved, m"))
def numeric_only(spark, folder):
    loans = pin(resolved_loans(spark, folder, NUMERIC_COLUMNS))
    keep = ["id", "default_flag", "issue_year"]
    out = clean.numeric_only(loans, keep, fit_on=loans.where("split = 'train'"))
    return rounded(out.select("id", *NUMERIC_COLUMNS), **{c: 6 for c in NUMERIC_COLUMNS})


@register("clean_tape_summary", with_tape(
    "SELECT count(*) AS initial_rows, count(*) FILTER (loan_status IN ('Fully Paid', 'Charged Off')) AS resolved_rows, "
    "count(*) FILTER (loan_status = 'Charged Off') AS defaults, round(count(*) FILTER (loan_status = 'Charged Off') / "
    "count(*) FILTER (loan_status IN ('Fully Paid', 'Charged Off')), 6) AS default_rate FROM tape"))
def clean_tape_summary(spark, folder):
    tape = loan_tape(spark, folder)
    cleaned = clean.clean_tape(tape, fit_scope="train", train_last_year=1998)
    out = clean.clean_summary(tape, cleaned)
    return rounded(out.select("initial_rows", "resolved_rows", "defaults", "default_rate"), default_rate=6)


@register("clean_tape")
def clean_tape(spark, folder):
    return clean.clean_tape(loan_tape(spark, folder), fit_scope="train", train_last_year=1998).features
