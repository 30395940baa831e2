"""Drift queries: vintages of the loan tape, and the first against the last ten days of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import drift, scorecard
from loanstrata.plans.tape import resolved_loans, table
from loanstrata.registered import register
from loanstrata.registered.profiling import rounded
from loanstrata.registered.sql import inflation, unpivot, with_tape
from loanstrata.session import pin

DRIFT = ["loan_amnt", "annual_inc", "dti", "revol_bal", "open_acc"]
VALUES = ", v AS (" + unpivot(DRIFT, "split", "resolved") + ") "
_PROBS = ", ".join(str(i / 10) for i in range(11))
EDGES = VALUES + f", e AS (SELECT feature, quantile_cont(value, [{_PROBS}]) AS q FROM v WHERE split = 'train' GROUP BY 1) "


def loans(spark, folder):
    return pin(resolved_loans(spark, folder, DRIFT))


def _psi_sql(other: str, place: str, share: str, where: str = "true", total: str = "n") -> str:
    """Counts per bin of both sides over all ten bins, then the sum of contributions."""
    return (
        f", c AS (SELECT feature, split, {place} AS bin, count(*) AS n FROM v JOIN e USING (feature) "
        f"WHERE split IN ('train', '{other}') AND ({where}) GROUP BY 1, 2, 3), w AS (SELECT feature, bin, "
        f"coalesce(sum(n) FILTER (split = 'train'), 0) AS r, coalesce(sum(n) FILTER (split = '{other}'), 0) AS o FROM c "
        "GROUP BY 1, 2), t AS (SELECT feature, sum(n) FILTER (split = 'train') AS rt, "
        f"sum(n) FILTER (split = '{other}') AS ot FROM {total} GROUP BY 1), s AS (SELECT feature, {share.format(x='r / rt')} AS rs, "
        f"{share.format(x='o / ot')} AS os FROM w JOIN t USING (feature)), p AS (SELECT feature, sum((os - rs) * ln(os / rs)) AS psi "
        "FROM s GROUP BY 1) SELECT feature, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'PASS' WHEN psi < 0.25 THEN 'WARN' "
        "ELSE 'FAIL' END AS status FROM p")


LEFT_CLOSED = "len(list_filter(q[2:10], lambda x: value >= x))"
REPLACE = "CASE WHEN {x} = 0 THEN 0.0001 ELSE {x} END"


@register("psi_quantile", with_tape(EDGES + _psi_sql("test", LEFT_CLOSED, REPLACE, total="c")))
def psi_quantile(spark, folder):
    rows = loans(spark, folder)
    edges = drift.quantile_edges(rows.where("split = 'train'"), DRIFT)
    return rounded(drift.psi(rows, "split", "train", "test", edges), psi=6)


@register("psi_closed", with_tape(EDGES + _psi_sql(
    "test", LEFT_CLOSED, "greatest({x}, 1e-8)", "value >= q[1] AND value <= q[11]", total="c")))
def psi_closed(spark, folder):
    rows = loans(spark, folder)
    edges = drift.quantile_edges(rows.where("split = 'train'"), DRIFT)
    return rounded(drift.psi(rows, "split", "train", "test", edges, drift.QUANTILE_CLOSED), psi=6)


@register("psi_equal_width", with_tape(VALUES +
    ", e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v WHERE split IN ('train', 'test') GROUP BY 1) " + _psi_sql(
        "test", "len(list_filter(list_transform([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: lo + (hi - lo) * i / 10), "
        "lambda x: value >= x))", "({x} + 0.0001)", total="c")))
def psi_equal_width(spark, folder):
    rows = loans(spark, folder)
    edges = drift.equal_width_edges(rows.where("split IN ('train', 'test')"), DRIFT)
    return rounded(drift.psi(rows, "split", "train", "test", edges, drift.EQUAL_WIDTH), psi=6)


@register("csi_features", with_tape(EDGES + _psi_sql(
    "test", LEFT_CLOSED, REPLACE, "value >= q[1] - 0.001 AND value <= q[11] + 0.001",
    total="(SELECT feature, split, count(*) AS n FROM v GROUP BY 1, 2)")))
def csi_features(spark, folder):
    rows = loans(spark, folder)
    edges = drift.quantile_edges(rows.where("split = 'train'"), DRIFT)
    return rounded(drift.psi(rows, "split", "train", "test", edges, drift.CHARACTERISTIC), psi=6)


def _vintage(other: str) -> str:
    return (f"(SELECT feature, sum((os - rs) * ln(os / rs)) AS psi FROM (SELECT feature, CASE WHEN r = 0 THEN 0.0001 ELSE r / rt "
            f"END AS rs, CASE WHEN o = 0 THEN 0.0001 ELSE o / ot END AS os FROM (SELECT feature, bin, "
            f"coalesce(sum(n) FILTER (split = 'train'), 0) AS r, coalesce(sum(n) FILTER (split = '{other}'), 0) AS o, "
            f"sum(r) OVER (PARTITION BY feature) AS rt, sum(o) OVER (PARTITION BY feature) AS ot FROM c GROUP BY 1, 2)) GROUP BY 1)")


@register("vintage_psi", with_tape(EDGES +
    f", c AS (SELECT feature, split, {LEFT_CLOSED} AS bin, count(*) AS n FROM v JOIN e USING (feature) GROUP BY 1, 2, 3) "
    "SELECT feature, round(a.psi, 6) AS psi_train_val, round(b.psi, 6) AS psi_train_test, "
    "CASE WHEN a.psi < 0.1 THEN 'PASS' WHEN a.psi < 0.25 THEN 'WARN' ELSE 'FAIL' END AS status_train_val, "
    "CASE WHEN b.psi < 0.1 THEN 'PASS' WHEN b.psi < 0.25 THEN 'WARN' ELSE 'FAIL' END AS status_train_test "
    f"FROM {_vintage('val')} a JOIN {_vintage('test')} b USING (feature)"))
def vintage_psi(spark, folder):
    return rounded(drift.vintage_psi(loans(spark, folder), DRIFT), psi_train_val=6, psi_train_test=6)


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in DRIFT)


@register("mean_embedding_drift", with_tape(
    f", k AS (SELECT * FROM resolved WHERE {_COMPLETE}) SELECT count(*) FILTER (split = 'train') AS n_reference, "
    "count(*) FILTER (split = 'test') AS n_other, round(sqrt(" + " + ".join(
        f"((avg({c}) FILTER (split = 'train') - avg({c}) FILTER (split = 'test')) / stddev_pop({c}) FILTER (split = 'train')) ** 2"
        for c in DRIFT) + "), 6) AS drift_score FROM k"))
def mean_embedding_drift(spark, folder):
    return rounded(drift.mean_embedding_drift(loans(spark, folder), DRIFT), drift_score=6)


_HEX = lambda text, at: f"CAST(('0x' || substr(md5({text}), {at}, 7)) AS BIGINT)"
_DRAWS = (
    f", k AS (SELECT * FROM resolved WHERE split IN ('train', 'test') AND {_COMPLETE}), f AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in DRIFT) + " FROM k WHERE split = 'train'), "
    "z AS (SELECT id, split = 'train' AS ref, " + ", ".join(f"({c} - m_{c}) / d_{c} AS z_{c}" for c in DRIFT)
    + f", {_HEX("concat(id, '-42')", 1)} AS x, {_HEX("concat(id, '-42')", 8)} AS y FROM k, f), "
    "g AS (SELECT draw, " + ", ".join(f"{_HEX(f"concat('{n}-', draw, '-42')", 1)} + 1 AS {n}" for n in "abc") + " FROM generate_series(1, 100) t(draw)), "
    "tk AS (SELECT z.*, draw, (x * a % 2147483647 + y * b % 2147483647 + c) % 2147483647 AS ticket FROM z, g), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY ticket, id) <= (SELECT count(*) FROM z WHERE ref) AS hit FROM tk "
    "UNION ALL SELECT *, 0, 0, ref FROM z), "
    "st AS (SELECT draw, count(*) FILTER (hit) AS n_reference, count(*) FILTER (NOT hit) AS n_other, sqrt(" + " + ".join(
        f"(avg(z_{c}) FILTER (hit) - avg(z_{c}) FILTER (NOT hit)) ** 2" for c in DRIFT) + ") AS stat FROM rk GROUP BY draw) ")


@register("permutation_drift", with_tape(_DRAWS +
    "SELECT round(o, 6) AS drift_score, round(p, 4) AS p_value, CASE WHEN p < 0.05 THEN 'significant drift' "
    "ELSE 'no significant drift' END AS interpretation FROM (SELECT any_value(o) AS o, avg(CASE WHEN stat >= o THEN 1 ELSE 0 END) "
    "AS p FROM st, (SELECT stat AS o FROM st WHERE draw = 0) WHERE draw > 0)"))
def permutation_drift(spark, folder):
    return rounded(drift.permutation_drift(loans(spark, folder), DRIFT), drift_score=6, p_value=4)


@register("permutation_draws", with_tape(_DRAWS + "SELECT draw, n_reference, n_other, round(stat, 9) AS stat FROM st"))
def permutation_draws(spark, folder):
    """Sizes and distance of every relabelling: each has as many reference rows as there really are."""
    out = rounded(drift.permutation_draws(loans(spark, folder), DRIFT), stat=9)
    return out.withColumn("draw", F.col("draw").cast("long"))


@register("ks_by_feature", with_tape(VALUES +
    ", c AS (SELECT feature, value, count(*) FILTER (split = 'train') AS r, count(*) FILTER (split = 'test') AS o FROM v "
    "WHERE split IN ('train', 'test') GROUP BY 1, 2), s AS (SELECT feature, sum(r) OVER w AS r, sum(o) OVER w AS o, "
    "sum(r) OVER (PARTITION BY feature) AS rt, sum(o) OVER (PARTITION BY feature) AS ot FROM c "
    "WINDOW w AS (PARTITION BY feature ORDER BY value)) SELECT feature, CAST(max(rt) AS BIGINT) AS n_reference, "
    "CAST(max(ot) AS BIGINT) AS n_other, round(max(abs(r / rt - o / ot)), 6) AS ks FROM s GROUP BY 1"))
def ks_by_feature(spark, folder):
    out = drift.ks_by_feature(loans(spark, folder), DRIFT)
    return rounded(out.select("feature", "n_reference", "n_other", "ks"), ks=6)


@register("psi_events",
    "WITH v AS (SELECT event_type AS feature, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN ts >= TIMESTAMP "
    "'2024-01-20' THEN 'test' END AS split, value FROM events), e AS (SELECT quantile_cont(value, ["
    + _PROBS + "]) AS q FROM v WHERE split = 'train')" + _psi_sql("test", LEFT_CLOSED, REPLACE, total="c")
    .replace("v JOIN e USING (feature)", "(SELECT 'value' AS feature, split, value FROM v) JOIN e ON true"))
def psi_events(spark, folder):
    rows = table(spark, folder, "events").select("value", F.expr(
        "case when ts < timestamp_ntz '2024-01-11' then 'train' when ts >= timestamp_ntz '2024-01-20' then 'test' end")
        .alias("split"))
    edges = drift.quantile_edges(rows.where("split = 'train'"), ["value"])
    return rounded(drift.psi(rows, "split", "train", "test", edges), psi=6)


_NUM, _TXT = DRIFT, ["grade", "purpose", "emp_length"]
_AUC = (", fl AS (" + unpivot(DRIFT, "default_flag AS y", "resolved") + "), cu AS (SELECT feature, value, sum(y) AS pos, sum(1 - y) AS neg "
        "FROM fl GROUP BY 1, 2), ru AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY value) - neg AS nb FROM cu), au AS ("
        "SELECT feature, greatest(a, 1 - a) AS auc FROM (SELECT feature, sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) AS a FROM ru "
        "GROUP BY 1)) ")
_SHARES = (", cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS value FROM resolved" for c in _NUM + _TXT)
           + "), cc AS (SELECT c, value, count(*) AS n FROM cells GROUP BY 1, 2), ov AS (SELECT c, sum(n) FILTER (value IS NULL) / sum(n) "
           "AS null_rate, count(value) AS u, max(n) FILTER (value IS NOT NULL) / sum(n) FILTER (value IS NOT NULL) AS top FROM cc GROUP BY 1) ")
_OUT = (", ost AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 "
        "FROM v GROUP BY 1), ou AS (SELECT feature, count(*) FILTER (abs(value - m) / sd > 4 OR value < q1 - 3 * (q3 - q1) OR value > "
        "q3 + 3 * (q3 - q1)) AS n FROM v JOIN ost USING (feature) GROUP BY 1) ")
_PSI = ", psis AS (" + _psi_sql("test", LEFT_CLOSED, REPLACE, total="c").lstrip(", ").replace("c AS (", "SELECT * FROM (WITH c AS (", 1) + ")) "


@register("dq_scorecard", with_tape(EDGES + _AUC + _SHARES + _OUT + _PSI +
    ", r AS (SELECT greatest(" + ", ".join(
        f"abs(corr({a}, {b}))" for i, a in enumerate(DRIFT) for b in DRIFT[i + 1:]) + ") AS r FROM resolved), "
    + inflation(DRIFT) + ", x AS ("
    "SELECT 'DQ-01' AS test_id, max(null_rate) AS value, CASE WHEN max(null_rate) > 0.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM ov "
    "UNION ALL SELECT 'DQ-02', least(avg(default_flag), 1 - avg(default_flag)), CASE WHEN least(avg(default_flag), 1 - avg(default_flag)) < 0.05 "
    "THEN 'FAIL' ELSE 'PASS' END FROM resolved UNION ALL SELECT 'DQ-03', max(u), CASE WHEN max(u) > 50 THEN 'FAIL' ELSE 'PASS' END FROM ov "
    "WHERE c IN ('grade', 'purpose', 'emp_length') UNION ALL SELECT 'DQ-04', max(top), CASE WHEN max(top) > 0.95 THEN 'FAIL' ELSE 'PASS' END FROM ov "
    "UNION ALL SELECT 'DQ-06', max(auc), CASE WHEN max(auc) > 0.95 THEN 'FAIL' ELSE 'PASS' END FROM au UNION ALL SELECT 'DQ-07', max(psi), "
    "CASE WHEN max(psi) > 0.25 THEN 'FAIL' WHEN max(psi) >= 0.1 THEN 'WARN' ELSE 'PASS' END FROM psis UNION ALL SELECT 'DQ-08', "
    "count(*) FILTER (n > 0), CASE WHEN count(*) FILTER (n > 0) > 0 THEN 'WARN' ELSE 'PASS' END FROM ou UNION ALL SELECT 'DQ-09', "
    "count(*) FILTER (2 * auc - 1 < 0.02 OR 2 * auc - 1 > 0.5), CASE WHEN count(*) FILTER (2 * auc - 1 < 0.02 OR 2 * auc - 1 > 0.5) > 0 THEN "
    "'WARN' ELSE 'PASS' END FROM au UNION ALL SELECT 'DQ-10', max(s), CASE WHEN max(s) > 0.9 THEN 'FAIL' ELSE 'PASS' END FROM ("
    + " UNION ALL ".join(f"SELECT avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) FILTER ({c} IS NOT NULL) AS s FROM resolved"
                         for c in _TXT) + ") UNION ALL SELECT 'DQ-05', r, CASE WHEN r > 0.85 OR (SELECT max(vif) FROM vifs) > 10 THEN 'FAIL' ELSE 'PASS' END FROM r) "
    "SELECT test_id, status, round(value, 6) AS value FROM x"))
def dq_scorecard(spark, folder):
    rows = resolved_loans(spark, folder, [*_NUM, *_TXT]).select("id", "split", "default_flag", *_NUM, *_TXT)
    return rounded(scorecard.dq_scorecard(rows).select("test_id", "status", "value"), value=6)
