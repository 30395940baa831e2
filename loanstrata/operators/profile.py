"""Column profiles, distributions, missing-value analysis and target reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanstrata.functions.ordered import quantiles
from loanstrata.functions.stats import moments, student_p
from loanstrata.functions.text import issue_date
from loanstrata.session import attach, pin, small_table

# Numeric columns reported first when present, and categorical columns whose shares are shown.
CORE_NUMERIC = ["loan_amnt", "int_rate", "annual_inc", "dti", "fico_range_low"]
CORE_CATEGORICAL = ["loan_status", "grade", "purpose", "home_ownership"]
PAIRS_PER_PASS = 200


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def core_numeric_columns(df: DataFrame) -> list[str]:
    """The known core columns that exist, else the first five numeric ones."""
    present = {c.lower(): c for c in df.columns}
    known = [present[c] for c in CORE_NUMERIC if c in present]
    return known or numeric_columns(df)[:5]


def struct_rows(df: DataFrame, keep: list[str], rows: list[Column]) -> DataFrame:
    """One input row to many `struct` rows without a shuffle (used on one-row aggregates and on wide frames)."""
    return df.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Row count, null or blank keys, distinct keys and whether the key is unique."""
    text = F.trim(F.col(key).cast("string"))
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    blank = F.col(key).isNull() | (text == "")
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(blank, F.col("_n"))), F.lit(0)).alias("null_key_count"),
        F.count(F.col(key)).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, 1)), F.lit(0)).cast("bigint").alias("duplicate_key_count"),
    )


def duplicate_keys(df: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The keys held by more than one row, most frequent first."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)
    return counts.orderBy(F.desc("cnt"), key).limit(limit)


def vintage_coverage(df: DataFrame, date_column: str = "issue_d", limit: int = 48) -> DataFrame:
    """Row counts of the latest vintages, by date rather than by text."""
    counts = df.groupBy(date_column).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(issue_date(F.col(date_column)).desc_nulls_last(), date_column).limit(limit)


def column_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest value per column, in one pass; text columns by text order."""
    one = df.agg(*[f(F.col(c)).cast("string").alias(f"{n}_{c}") for c in columns for n, f in
                   (("lo", F.min), ("hi", F.max))])
    return struct_rows(one, [], [
        F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min_value"), F.col(f"hi_{c}").alias("max_value"))
        for c in columns
    ])


def value_counts(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """`(keep..., column, value, n)` for all columns at once; counts are combined before the shuffle."""
    keep = keep or []
    rows = struct_rows(df, keep, [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return rows.groupBy(*keep, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def count_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, distinct values and the rows of the most frequent value of every column, from one grouped job.

    Values count as equal when their texts are, but numbers are grouped as they are: only zero, whose texts differ by
    sign, and types other than numbers are written out.
    """
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        whole, number = types[c] in ("tinyint", "smallint", "int", "bigint"), types[c] == "double"
        text = F.col(c).cast("string")
        return F.struct(
            F.lit(c).alias("column"),
            (F.col(c) if whole else F.lit(None)).cast("bigint").alias("whole"), (F.col(c) if number else F.lit(None)).cast("double").alias("number"),
            F.lit(None).cast("string").alias("text") if whole else (F.when(F.col(c) == 0, text) if number else text).alias("text"),
            F.col(c).isNull().alias("missing"))

    counts = struct_rows(df, [], [cell(c) for c in columns]).groupBy("column", "whole", "number", "text", "missing").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return counts.groupBy("column").agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(F.col("missing"), n)), F.lit(0)).alias("null_count"),
        F.count_if(~F.col("missing")).alias("unique_count"), F.max(F.when(~F.col("missing"), n)).alias("top_count"))


def top_values(df: DataFrame, columns: list[str], k: int = 10, with_null: bool = False) -> DataFrame:
    """The k most frequent values per column. The rank filter is pushed below the shuffle by the optimizer."""
    counts = value_counts(df, columns)
    if not with_null:
        counts = counts.where(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value of a category."""
    # The counts are written, so that the rows are read once for them and for their total.
    counts = pin(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select(column, "n", (F.col("n") / F.lit(total)).alias("share"))


def feature_type(name: str, unique: Column, is_numeric: bool) -> Column:
    """Semantic type by name first, then by number of distinct values."""
    lower = name.lower()
    if lower in ("id", "member_id") or lower.endswith("_id"):
        return F.lit("identifier")
    if "date" in lower or lower.endswith("_d") or lower in ("issue_d", "earliest_cr_line"):
        return F.lit("date")
    rest = F.when(unique <= 20, "ordinal").otherwise("continuous") if is_numeric else F.lit("nominal")
    return F.when(unique <= 2, "binary").otherwise(rest)


def column_overview(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Nulls, distinct values, semantic type and warnings of every column.

    Exact distinct counts come from one grouped job over `(column, value)`; `approximate` replaces them with
    sketches and needs no shuffle of values.
    """
    columns = columns or df.columns
    numeric = set(numeric_columns(df))
    types = dict(df.dtypes)
    if approximate:
        one = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            f.alias(f"{n}_{c}") for c in columns for n, f in
            (("nn", F.count(F.col(c))), ("u", F.approx_count_distinct(c)))
        ])
        base = struct_rows(one, [], [
            F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"),
                     (F.col("_rows") - F.col(f"nn_{c}")).alias("null_count"),
                     F.col(f"u_{c}").alias("unique_count")) for c in columns
        ])
    else:
        base = count_summary(df, columns)
    kind = F.lit(None).cast("string")
    dtype = F.lit(None).cast("string")
    for c in columns:
        kind = F.when(F.col("column") == c, feature_type(c, F.col("unique_count"), c in numeric)).otherwise(kind)
        dtype = F.when(F.col("column") == c, F.lit(types[c])).otherwise(dtype)
    rate = F.col("null_count") / F.col("rows")
    return base.select(
        "column", dtype.alias("dtype"), "rows", "null_count", rate.alias("null_rate"), "unique_count",
        kind.alias("feature_type"), (rate > 0.5).alias("high_null"), (F.col("unique_count") <= 1).alias("zero_variance"),
    )


def numeric_summary(df: DataFrame, columns: list[str], probs: list[float] | None = None) -> DataFrame:
    """Moments and exact quantiles per column: one pass for moments, one job for all quantiles."""
    probs = probs or [0.01, 0.25, 0.5, 0.75, 0.99]
    stats = moments(df, columns)
    base = df.sparkSession.createDataFrame(
        [(c, *[stats[c][n] for n in ("n", "mean", "std", "min", "max")]) for c in columns],
        "feature string, n long, mean double, std double, min double, max double")
    spread = quantiles(df, columns, probs, rows=stats.rows).select("feature", *[
        F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)
    ])
    # Both sides have one row per column of the schema.
    return base.join(F.broadcast(spread), "feature", "left")


def missing_patterns(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """The most frequent sets of null columns; the pattern text joins the sorted names with a bar."""
    pattern = F.concat_ws("|", *[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(columns)])
    counts = pin(df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("row_count")))
    total = counts.agg(F.sum("row_count")).first()[0]
    return counts.orderBy(F.desc("row_count"), "pattern").limit(top).withColumn(
        "pct", F.col("row_count") / F.lit(total) * 100)


def co_missing_pairs(df: DataFrame, columns: list[str], threshold: float = 0.3, top: int = 20) -> DataFrame:
    """Correlation of null indicators over the pairs of columns.

    Rows are first folded to one count per null pattern, so the pair sums run over patterns.
    """
    flags = [F.col(c).isNull().cast("int").alias(c) for c in columns]
    patterns = df.select(*flags).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    held = small_table(patterns)
    patterns = pin(patterns) if held is None else held
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    found = None
    # Blocks of pairs keep the generated code small; each block reads the pattern counts, not the rows.
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = _null_correlations(patterns, pairs[start:start + PAIRS_PER_PASS])
        found = part if found is None else found.unionByName(part)
    out = found.where(F.abs("correlation") > threshold)
    return out.orderBy(F.desc(F.abs("correlation")), "col_a", "col_b").limit(top)


def _null_correlations(patterns: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    names = sorted({c for pair in pairs for c in pair})
    sums = patterns.agg(
        F.sum("_n").alias("_rows"),
        *[F.sum(F.col(c) * F.col("_n")).alias(f"s_{c}") for c in names],
        *[F.sum(F.col(a) * F.col(b) * F.col("_n")).alias(f"x_{i}") for i, (a, b) in enumerate(pairs)],
    )
    n = F.col("_rows").cast("double")
    rows = []
    for i, (a, b) in enumerate(pairs):
        sa, sb = F.col(f"s_{a}").cast("double"), F.col(f"s_{b}").cast("double")
        spread = F.sqrt(sa * (n - sa)) * F.sqrt(sb * (n - sb))
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                             F.try_divide(n * F.col(f"x_{i}") - sa * sb, spread).alias("correlation")))
    return struct_rows(sums, [], rows)


def segmented_null_rates(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Null rate of each column within each group value, long form."""
    chosen = columns
    rates = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("segment")).agg(*[
        F.avg(F.col(c).isNull().cast("int")).alias(f"r_{c}") for c in chosen
    ])
    return struct_rows(rates, ["segment"], [
        F.struct(F.lit(c).alias("column"), F.col(f"r_{c}").alias("null_rate")) for c in chosen
    ])


def welch_by_missingness(df: DataFrame, null_columns: list[str], test_columns: list[str],
                         min_side: int = 10) -> DataFrame:
    """Welch t of each test column between rows where another column is present and rows where it is missing.

    All pairs in one pass: six conditional aggregates per pair.
    """
    pairs = [(a, b) for a in null_columns for b in test_columns if a != b]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        for side, test in (("p", F.col(a).isNotNull()), ("m", F.col(a).isNull())):
            v = F.when(test, F.col(b).cast("double"))
            aggs += [F.count(v).alias(f"n{side}{i}"), F.avg(v).alias(f"a{side}{i}"),
                     F.var_samp(v).alias(f"v{side}{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        ep, em = F.col(f"vp{i}") / F.col(f"np{i}"), F.col(f"vm{i}") / F.col(f"nm{i}")
        t = F.try_divide(F.col(f"ap{i}") - F.col(f"am{i}"), F.sqrt(ep + em))
        freedom = F.try_divide(
            (ep + em) * (ep + em), ep * ep / (F.col(f"np{i}") - 1) + em * em / (F.col(f"nm{i}") - 1))
        rows.append(F.struct(
            F.lit(a).alias("null_column"), F.lit(b).alias("test_column"), F.col(f"np{i}").alias("n_present"),
            F.col(f"nm{i}").alias("n_missing"), t.alias("t_statistic"), freedom.alias("welch_df")))
    return struct_rows(one, [], rows).where((F.col("n_present") >= min_side) & (F.col("n_missing") >= min_side))


def mcar_flags(df: DataFrame, null_columns: list[str], test_columns: list[str], top: int = 15) -> DataFrame:
    """The pairs that speak against missing completely at random (p below 0.05), strongest first."""
    tests = welch_by_missingness(df, null_columns, test_columns)
    tests = tests.withColumn("p_value", student_p("t_statistic", "welch_df")).where(F.col("p_value") < 0.05)
    verdict = F.when(F.col("p_value") < 0.01, "MAR likely").otherwise("Possibly MAR")
    return tests.withColumn("interpretation", verdict).orderBy("p_value", "null_column", "test_column").limit(top)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts, severity of the imbalance, balancing weights and the synthetic rows a 1:2 balance would need."""
    one = df.where(F.col(target).isNotNull()).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("positives"),
    ).withColumn("negatives", F.col("total") - F.col("positives"))
    minor, major = F.least("positives", "negatives"), F.greatest("positives", "negatives")
    ratio = minor / F.col("total")
    severity = F.when(ratio < 0.05, "severe").when(ratio < 0.15, "moderate").when(ratio < 0.30, "mild").otherwise(
        "balanced")
    return one.select(
        "total", "positives", "negatives", ratio.alias("minority_ratio"), severity.alias("severity"),
        (ratio < 0.05).alias("imbalanced"),
        F.try_divide(F.col("total"), 2 * F.col("positives")).alias("weight_positive"),
        F.try_divide(F.col("total"), 2 * F.col("negatives")).alias("weight_negative"),
        F.greatest(F.lit(0), F.floor(major * 0.5) - minor).cast("bigint").alias("synthetic_rows_needed"),
        F.try_divide(F.col("negatives"), F.greatest(F.col("positives"), F.lit(1))).alias("scale_pos_weight"),
    )


def vintage_default_rate(df: DataFrame, vintage: str = "issue_d", target: str = "default_flag") -> DataFrame:
    return df.groupBy(vintage).agg(
        F.count(F.lit(1)).alias("total"), F.sum(target).alias("defaults"),
        F.avg(F.col(target).cast("double")).alias("default_rate"),
    )


def default_target_report(df: DataFrame, target: str = "default_flag") -> DataFrame:
    """Default rate, adequacy of the minority class and an assessment of the rate."""
    rate = F.avg(F.col(target).cast("double"))
    one = df.agg(F.count(F.lit(1)).alias("total"), F.sum(target).alias("defaults"), rate.alias("default_rate"))
    minority = F.least(F.col("default_rate"), 1 - F.col("default_rate")) * 100
    return one.select(
        "total", "defaults", "default_rate", minority.alias("minority_pct"),
        (minority >= 5).alias("minority_adequate"),
        F.when(F.col("default_rate") < 0.01, "very low").when(F.col("default_rate") > 0.5, "very high").otherwise(
            "normal").alias("assessment"),
    )


def loss_target_report(defaults: DataFrame, lgd: str = "lgd") -> DataFrame:
    """Loss and no-loss counts among defaulted loans and the distribution of positive losses."""
    counts = defaults.agg(
        F.count(F.lit(1)).alias("n_default"),
        F.count(F.when(F.col(lgd) > 0, 1)).alias("n_loss"),
        F.count(F.when(F.col(lgd) <= 0, 1)).alias("n_no_loss"),
    )
    severity = numeric_summary(defaults.where(F.col(lgd) > 0), [lgd], [0.25, 0.5, 0.75])
    return attach(counts, severity.drop("n")).select(
        "n_default", "n_loss", "n_no_loss", (F.col("n_loss") / F.col("n_default")).alias("loss_share"),
        F.col("mean").alias("severity_mean"), F.col("p50").alias("severity_median"), F.col("std").alias("severity_std"),
        F.col("min").alias("severity_min"), F.col("max").alias("severity_max"),
        F.col("p25").alias("severity_p25"), F.col("p75").alias("severity_p75"),
    )


def exposure_target_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments and percentiles of exposure and conversion factor, over all loans."""
    return numeric_summary(df, columns or ["ead", "ccf"], [0.05, 0.25, 0.5, 0.75, 0.95])


def conversion_factor_shares(df: DataFrame, by: str | None = "default_flag") -> DataFrame:
    """Share of conversion factors above one, equal to one and below a half, per default flag."""
    known = df.where(F.col("ccf").isNotNull())
    pct = lambda test: (F.avg(test.cast("int")) * 100)
    return known.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ead").alias("ead_mean"), F.avg("ccf").alias("ccf_mean"),
        pct(F.col("ccf") > 1).alias("pct_above_one"), pct(F.col("ccf") == 1).alias("pct_equal_one"),
        pct(F.col("ccf") < 0.5).alias("pct_below_half"),
    )
