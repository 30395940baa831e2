"""Expected loss, rollup, stress and amortization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.functions.text import percent_number, term_months
from loanstrata.operators import loss
from loanstrata.plans.tape import loan_tape, resolved_loans
from loanstrata.registered import register
from loanstrata.registered.profiling import rounded
from loanstrata.registered.sql import with_tape

EL = """, el AS (
  SELECT *, pd * lgd * ead AS expected_loss FROM (SELECT id, grade, purpose, issue_year, default_flag,
    least(1, greatest(0, CAST(0.05 + 0.1 * default_flag AS DOUBLE) + ((id * 17) % 1000) / 2003)) AS pd,
    least(1, greatest(0, CAST(((id * 13) % 800) AS DOUBLE) / 1013 + 0.1)) AS lgd, greatest(0, loan_amnt) AS ead
  FROM resolved WHERE split = 'test')) """


def el(spark, folder):
    """Loan-level losses of the test vintages with deterministic PD and LGD."""
    loans = resolved_loans(spark, folder, ["grade", "purpose", "loan_amnt"]).where("split = 'test'")
    return loss.expected_loss(loans.select(
        "id", "grade", "purpose", "issue_year", "default_flag",
        (0.05 + 0.1 * F.col("default_flag") + (F.col("id") * 17) % 1000 / 2003).alias("pd"),
        ((F.col("id") * 13) % 800 / 1013 + 0.1).alias("lgd"), F.col("loan_amnt").alias("ead")))


@register("expected_loss", with_tape(EL +
    "SELECT id, round(pd, 6) AS pd, round(lgd, 6) AS lgd, round(ead, 4) AS ead, round(expected_loss, 6) AS expected_loss FROM el"))
def expected_loss(spark, folder):
    return rounded(el(spark, folder).select("id", "pd", "lgd", "ead", "expected_loss"), pd=6, lgd=6, ead=4,
                   expected_loss=6)


_P = [0.05, 0.25, 0.5, 0.75, 0.95]


@register("loss_summary", with_tape(EL +
    "SELECT count(*) AS total_loans, round(sum(expected_loss), 2) AS portfolio_el, round(avg(expected_loss), 4) AS mean_el, "
    "round(sum(ead), 3) AS total_ead, round(sum(expected_loss) / greatest(sum(ead), 1), 6) AS el_rate, "
    "round(avg(pd), 6) AS mean_pd, round(avg(lgd), 6) AS mean_lgd, round(avg(ead), 4) AS mean_ead, "
    "round(quantile_cont(expected_loss, 0.5), 4) AS median_el, "
    + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_p{round(p * 100):02d}" for c in ("pd", "lgd") for p in _P)
    + " FROM el"))
def loss_summary(spark, folder):
    out = loss.loss_summary(el(spark, folder))
    digits = {c: 6 for c in out.columns if c != "total_loans"}
    digits.update(portfolio_el=2, total_ead=3, mean_el=4, mean_ead=4, median_el=4)
    return rounded(out, **digits)


@register("el_rollup", with_tape(EL +
    "SELECT grade, count(*) AS loan_count, round(sum(expected_loss), 2) AS total_el, round(avg(expected_loss), 4) AS mean_el, "
    "round(sum(ead), 3) AS total_ead, round(avg(pd), 6) AS mean_pd, round(avg(lgd), 6) AS mean_lgd, "
    "round(avg(ead), 4) AS mean_ead, round(quantile_cont(expected_loss, 0.5), 4) AS median_el, "
    "round(sum(expected_loss) / sum(ead), 6) AS el_rate, "
    "round(sum(expected_loss) / greatest(sum(sum(expected_loss)) OVER (), 1) * 100, 4) AS el_share_pct FROM el GROUP BY grade"))
def el_rollup(spark, folder):
    return rounded(loss.rollup(el(spark, folder), "grade"), total_el=2, mean_el=4, total_ead=3, mean_pd=6, mean_lgd=6,
                   mean_ead=4, median_el=4, el_rate=6, el_share_pct=4)


@register("el_grouping_sets", with_tape(EL +
    "SELECT CASE WHEN grouping(grade, issue_year, purpose) = 7 THEN 'portfolio' WHEN grouping(grade) = 0 THEN 'grade' "
    "WHEN grouping(issue_year) = 0 THEN 'issue_year' ELSE 'purpose' END AS dimension, "
    "CASE WHEN grouping(grade, issue_year, purpose) = 7 THEN 'all' WHEN grouping(grade) = 0 THEN grade "
    "WHEN grouping(issue_year) = 0 THEN CAST(issue_year AS VARCHAR) ELSE purpose END AS segment, count(*) AS loan_count, "
    "round(sum(expected_loss), 2) AS total_el, round(sum(ead), 3) AS total_ead, "
    "round(sum(expected_loss) / sum(ead), 6) AS el_rate FROM el "
    "GROUP BY GROUPING SETS ((grade), (issue_year), (purpose), ())"))
def el_grouping_sets(spark, folder):
    return rounded(loss.multi_rollup(el(spark, folder), ["grade", "issue_year", "purpose"]), total_el=2, total_ead=3,
                   el_rate=6)


STRESS = EL + """, stressed AS (
  SELECT el.*, scenario, least(1, greatest(0, pd * f)) AS spd, least(1, greatest(0, greatest(lgd, coalesce(fl, lgd)))) AS slgd
  FROM el, (VALUES ('base', 1.0, NULL), ('adverse', 1.5, 0.45), ('severe', 2.0, 0.60)) s(scenario, f, fl)),
st AS (SELECT *, spd * slgd * ead AS sel FROM stressed) """


@register("stress_scenarios", with_tape(STRESS +
    "SELECT scenario, grade, count(*) AS loan_count, round(sum(expected_loss), 2) AS baseline_el, "
    "round(sum(sel), 2) AS stressed_el, round(sum(ead), 3) AS total_ead, "
    "round((sum(sel) - sum(expected_loss)) * 100 / sum(expected_loss), 4) AS el_change_pct FROM st GROUP BY 1, 2"))
def stress_scenarios(spark, folder):
    return rounded(loss.stressed_rollup(el(spark, folder), "grade"), baseline_el=2, stressed_el=2, total_ead=3,
                   el_change_pct=4)


@register("stress_report", with_tape(STRESS +
    "SELECT scenario, count(*) AS total_loans, round(sum(expected_loss), 2) AS baseline_el, round(sum(sel), 2) AS stressed_el, "
    "round(avg(sel), 4) AS mean_stressed_el, round(avg(pd), 6) AS mean_pd, round(avg(spd), 6) AS mean_stressed_pd, "
    "round(avg(lgd), 6) AS mean_lgd, round(avg(slgd), 6) AS mean_stressed_lgd, round(max(sel), 4) AS max_stressed_el, "
    "round(sum(sel) - sum(expected_loss), 2) AS el_change, "
    "round((sum(sel) - sum(expected_loss)) / greatest(sum(expected_loss), 1) * 100, 4) AS el_change_pct, "
    "round((avg(spd) - avg(pd)) / avg(pd) * 100, 4) AS pd_change_pct, "
    "round((avg(slgd) - avg(lgd)) / avg(lgd) * 100, 4) AS lgd_change_pct FROM st GROUP BY 1"))
def stress_report(spark, folder):
    out = loss.stress_report(el(spark, folder))
    digits = dict(baseline_el=2, stressed_el=2, el_change=2, mean_stressed_el=4, max_stressed_el=4, el_change_pct=4,
                  pd_change_pct=4, lgd_change_pct=4, mean_pd=6, mean_stressed_pd=6, mean_lgd=6, mean_stressed_lgd=6)
    return rounded(out, **digits)


@register("stress_percentiles", with_tape(STRESS + "SELECT scenario, " + ", ".join(
    f"round(quantile_cont(sel, {p}), 4) AS p{round(p * 100):02d}" for p in _P) + " FROM st GROUP BY 1"))
def stress_percentiles(spark, folder):
    return rounded(loss.stress_percentiles(el(spark, folder)), **{f"p{round(p * 100):02d}": 4 for p in _P})


@register("el_invariants", with_tape(EL +
    "SELECT count(*) FILTER (expected_loss < 0) AS negative_el, count(*) FILTER (expected_loss > ead + 1e-9) AS el_above_ead, "
    "count(*) FILTER (least(1, pd * 1.5) * greatest(lgd, 0.45) < pd * lgd - 1e-9) AS adverse_below_base, "
    "count(*) FILTER (least(1, pd * 2.0) * greatest(lgd, 0.6) < least(1, pd * 1.5) * greatest(lgd, 0.45) - 1e-9) "
    "AS severe_below_adverse FROM el"))
def el_invariants(spark, folder):
    return loss.loss_invariants(el(spark, folder))


@register("el_band", with_tape(EL +
    "SELECT portfolio, round(sum(expected_loss) / greatest(sum(ead), 1) * 100, 4) AS el_pct, any_value(lo) AS band_low, "
    "any_value(hi) AS band_high, sum(expected_loss) / greatest(sum(ead), 1) * 100 BETWEEN any_value(lo) AND any_value(hi) "
    "AS inside FROM (SELECT *, CASE WHEN grade = 'A' THEN 'prime' WHEN grade = 'B' THEN 'near_prime' WHEN grade = 'C' THEN "
    "'subprime' ELSE 'non_prime' END AS portfolio FROM el) JOIN (SELECT g AS portfolio, CAST(lo AS DOUBLE) AS lo, "
    "CAST(hi AS DOUBLE) AS hi FROM (VALUES ('prime', 0.5, 2.0), ('near_prime', 1.5, 3.5), ('subprime', 3.0, 6.0), "
    "('non_prime', 4.0, 8.0)) b(g, lo, hi)) USING (portfolio) GROUP BY portfolio"))
def el_band(spark, folder):
    typed = el(spark, folder).withColumn("portfolio", F.expr(
        "case grade when 'A' then 'prime' when 'B' then 'near_prime' when 'C' then 'subprime' else 'non_prime' end"))
    return rounded(loss.loss_band(typed, "portfolio"), el_pct=4)


LOANS = """, loans AS (
  SELECT id, grade, funded_amnt AS p, CAST(replace(int_rate, '%', '') AS DOUBLE) / 1200 AS r,
    CAST(trim(replace(term, 'months', '')) AS INTEGER) AS n FROM tape WHERE funded_amnt > 0),
sched AS (SELECT id, p, n AS term, CAST(m AS INTEGER) AS month, r, p * r * (1 + r) ** n / ((1 + r) ** n - 1) AS payment,
    greatest(0, p * ((1 + r) ** n - (1 + r) ** (m - 1)) / ((1 + r) ** n - 1)) AS opening,
    greatest(0, p * ((1 + r) ** n - (1 + r) ** m) / ((1 + r) ** n - 1)) AS closing
  FROM (SELECT *, unnest(generate_series(1, n)) AS m FROM loans)) """


def schedule(spark, folder):
    tape = loan_tape(spark, folder, ["id", "funded_amnt", "int_rate", "term"])
    typed = tape.select("id", "funded_amnt", percent_number(F.col("int_rate")).alias("int_rate"),
                        term_months(F.col("term")).alias("term"))
    return loss.amortization(typed, "funded_amnt", "int_rate", "term")


@register("amortization_schedule", with_tape(LOANS +
    "SELECT term, month, count(*) AS loans, round(sum(payment), 1) AS payment, round(sum(payment - opening * r), 1) AS principal, "
    "round(sum(opening * r), 1) AS interest, round(sum(closing), 1) AS remaining_balance, "
    "round(avg((1 - closing / p) * 100), 4) AS principal_pct FROM sched GROUP BY 1, 2"))
def amortization_schedule(spark, folder):
    return schedule(spark, folder).groupBy("term", "month").agg(
        F.count(F.lit(1)).alias("loans"), *[F.round(F.sum(c), 1).alias(c) for c in (
            "payment", "principal", "interest", "remaining_balance")],
        F.round(F.avg("cumulative_principal_pct"), 4).alias("principal_pct"))


@register("amortization_milestones", with_tape(LOANS +
    "SELECT id, concat(CAST(q * 100 AS INTEGER), 'pct_term') AS milestone, month, round(closing, 3) AS remaining_balance, "
    "round(closing / p * 100, 5) AS remaining_pct FROM sched, (VALUES (0.25), (0.5), (0.75)) v(q) "
    "WHERE month = floor(term * q)"))
def amortization_milestones(spark, folder):
    out = loss.amortization_milestones(schedule(spark, folder))
    return rounded(out.select("id", "milestone", "month", "remaining_balance", "remaining_pct"), remaining_balance=3,
                   remaining_pct=5)


@register("amortization_totals", with_tape(LOANS +
    "SELECT id, round(max(payment), 3) AS monthly_payment, round(sum(opening * r), 2) AS total_interest, "
    "round(sum(payment), 2) AS total_payments FROM sched GROUP BY id"))
def amortization_totals(spark, folder):
    return rounded(loss.amortization_totals(schedule(spark, folder)), monthly_payment=3, total_interest=2,
                   total_payments=2)


@register("scheduled_exposure", with_tape(LOANS +
    "SELECT id, round(greatest(0, p * ((1 + r) ** n - (1 + r) ** (id % 36)) / ((1 + r) ** n - 1)), 3) AS scheduled_ead FROM loans"))
def scheduled_exposure(spark, folder):
    tape = loan_tape(spark, folder, ["id", "funded_amnt", "int_rate", "term"]).where("funded_amnt > 0")
    typed = tape.select("id", "funded_amnt", percent_number(F.col("int_rate")).alias("int_rate"),
                        term_months(F.col("term")).alias("term"), (F.col("id") % 36).alias("age"))
    return rounded(loss.scheduled_exposure(typed, "funded_amnt", "int_rate", "term", "age"), scheduled_ead=3)
