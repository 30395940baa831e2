"""The ten data-quality tests as one table of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.operators import drift, features, metrics, quality
from loanstrata.operators.profile import class_balance, count_summary, numeric_columns, string_columns
from loanstrata.session import pin

SCORECARD = ("test_id string, test_name string, status string, value double, threshold double, evidence string")
# Limit of every test.
MISSING, MINORITY, CARDINALITY, SAME_VALUE, CORRELATION, VIF = 0.05, 0.05, 50, 0.95, 0.85, 10.0
LEAK_AUC, PSI_WARN, PSI_FAIL, WEAK_GINI, STRONG_GINI, NUMERIC_TEXT = 0.95, 0.10, 0.25, 0.02, 0.50, 0.90


def worst(rows: DataFrame, name: str, value: str) -> tuple[float, str]:
    """Largest value of a per-column table and the column that has it."""
    best = rows.where(F.col(value).isNotNull()).orderBy(F.desc(value), name).limit(1).collect()
    return (float(best[0][value]), best[0][name]) if best else (0.0, "")


def dq_scorecard(df: DataFrame, target: str = "default_flag", skip: tuple[str, ...] = ("id", "issue_year"),
                 use_vif: bool = True) -> DataFrame:
    """Runs all tests on loans with `split`; the frame is written once because every test reads it.

    DQ-05 fails on a correlation or, with `use_vif`, on a variance inflation above its limit; where too few rows are complete
    for it, the evidence says so and the correlation alone decides.
    """
    data = pin(df)
    numbers = [c for c in numeric_columns(data) if c not in (*skip, target)]
    texts = [c for c in string_columns(data) if c not in (*skip, "split", "loan_status", "issue_d")]
    columns = [*numbers, *texts]
    rows: list[tuple] = []

    def add(code: str, name: str, status: str, value: float, limit: float, evidence: str) -> None:
        rows.append((code, name, status, float(value), float(limit), evidence))

    verdict = lambda bad: "FAIL" if bad else "PASS"
    overview = count_summary(data, columns).collect()
    top = max(overview, key=lambda r: (r["null_count"] / r["rows"], r["column"]))
    missing = top["null_count"] / top["rows"]
    add("DQ-01", "Missing value audit", verdict(missing > MISSING), missing, MISSING, top["column"])
    share = class_balance(data, target).collect()[0]["minority_ratio"]
    add("DQ-02", "Class balance", verdict(share < MINORITY), share, MINORITY, target)
    wide = max((r for r in overview if r["column"] in texts), key=lambda r: (r["unique_count"], r["column"]), default=None)
    distinct = wide["unique_count"] if wide else 0
    add("DQ-03", "High cardinality", verdict(distinct > CARDINALITY), distinct, CARDINALITY, wide["column"] if wide else "")
    shares = [(r["top_count"] / (r["rows"] - r["null_count"]), r["column"]) for r in overview if r["top_count"]]
    same, where = min(shares, key=lambda s: (-s[0], s[1]), default=(0.0, ""))
    add("DQ-04", "Near-zero variance", verdict(same > SAME_VALUE), same, SAME_VALUE, where)
    pairs = features.correlation_pairs(data, numbers).select(
        F.concat_ws("|", "feature_1", "feature_2").alias("pair"), F.abs("r").alias("r"))
    r, where = worst(pairs, "pair", "r")
    vif = 0.0
    if use_vif:
        factors = features.gram(data, numbers)
        vif = max(factors.vif(factors.columns).values(), default=0.0) if factors.columns else 0.0
        where = f"{where}; max VIF {vif:.2f}" if factors.columns else f"{where}; no VIF"
    add("DQ-05", "Multicollinearity", verdict(r > CORRELATION or vif > VIF), r, CORRELATION, where)
    strength = metrics.feature_auc(data, numbers, target).collect()
    strong = max(strength, key=lambda s: (s["auc"], s["feature"]))
    add("DQ-06", "Target leakage", verdict(strong["auc"] > LEAK_AUC), strong["auc"], LEAK_AUC, strong["feature"])
    edges = drift.quantile_edges(data.where("split = 'train'"), numbers)
    psi, where = worst(drift.psi(data, "split", "train", "test", edges), "feature", "psi")
    status = "FAIL" if psi > PSI_FAIL else "WARN" if psi >= PSI_WARN else "PASS"
    add("DQ-07", "Distribution stability", status, psi, PSI_FAIL, where)
    found = quality.outliers(data, numbers).where("z_outliers > 0 OR iqr_outliers > 0").select("feature").collect()
    names = sorted(f["feature"] for f in found)
    add("DQ-08", "Outliers", "WARN" if names else "PASS", len(names), 0, ", ".join(names))
    odd = sorted(s["feature"] for s in strength if s["gini"] < WEAK_GINI or s["gini"] > STRONG_GINI)
    add("DQ-09", "Strength of single features", "WARN" if odd else "PASS", len(odd), 0, ", ".join(odd))
    share, where = worst(quality.numeric_text_share(data, texts), "column", "numeric_share") if texts else (0.0, "")
    add("DQ-10", "Type consistency", verdict(share > NUMERIC_TEXT), share, NUMERIC_TEXT, where)
    return df.sparkSession.createDataFrame(rows, SCORECARD)
