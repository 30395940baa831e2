"""Rule checks on a loan tape; each returns rows with the measured value and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.functions.ordered import quantile_values
from loanstrata.functions.stats import moments
from loanstrata.functions.text import issue_year
from loanstrata.operators.profile import CORE_CATEGORICAL, struct_rows, top_values, value_counts

# Plausible range per column.
RANGE_RULES = {
    "loan_amnt": (100, 100_000),
    "int_rate": (0, 50),
    "annual_inc": (0, 10_000_000),
    "dti": (0, 100),
    "revol_util": (0, 100),
    "ead": (0, 100_000),
    "lgd": (0, 1),
}


def baseline_scan(df: DataFrame, key: str, categories: list[str] | None = None, top: int = 20) -> DataFrame:
    """Row count, null or blank keys and the top values of the core categories as `(section, item, n)`."""
    categories = [c for c in (categories or CORE_CATEGORICAL) if c in df.columns]
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(blank, 1)).alias("blank"))
    sizes = struct_rows(one, [], [
        F.struct(F.lit("row_count").alias("section"), F.lit("").alias("item"), F.col("rows").alias("n")),
        F.struct(F.lit("null_key").alias("section"), F.lit("").alias("item"), F.col("blank").alias("n")),
    ])
    shares = top_values(df, categories, top, with_null=True)
    return sizes.unionByName(shares.select(
        F.col("column").alias("section"), F.coalesce("value", F.lit("")).alias("item"), "n"))


def _outside(column: str, low: float, high: float):
    v = F.col(column).cast("double")
    return (v < low) | (v > high)


def outliers(df: DataFrame, columns: list[str], z_limit: float = 4.0, fence: float = 3.0) -> DataFrame:
    """Counts beyond `z_limit` population deviations and beyond the outer Tukey fences, all columns in one pass."""
    stats = moments(df, columns)
    q = quantile_values(df, columns, [0.25, 0.75], rows=stats.rows)
    columns = [c for c in columns if c in q]
    aggs, rows = [], []
    for c in columns:
        spread = q[c][1] - q[c][0]
        low, high = q[c][0] - fence * spread, q[c][1] + fence * spread
        deviation = stats[c]["std_pop"] or float("inf")
        z = F.abs(F.col(c).cast("double") - stats[c]["mean"]) / deviation
        aggs += [F.count(F.when(z > z_limit, 1)).alias(f"z_{c}"),
                 F.count(F.when(_outside(c, low, high), 1)).alias(f"t_{c}"), F.count(F.col(c)).alias(f"n_{c}")]
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"z_{c}").alias("z_outliers"),
            (F.col(f"z_{c}") / F.col(f"n_{c}")).alias("z_rate"), F.col(f"t_{c}").alias("iqr_outliers"),
            (F.col(f"t_{c}") / F.col(f"n_{c}")).alias("iqr_rate"), F.lit(low).alias("iqr_lower"),
            F.lit(high).alias("iqr_upper")))
    return struct_rows(df.agg(*aggs), [], rows)


def iqr_screen(df: DataFrame, columns: list[str], fence: float = 1.5, fail_pct: float = 10.0) -> DataFrame:
    """Percent of values beyond the inner fences; a column fails at `fail_pct`."""
    found = outliers(df, columns, fence=fence)
    return found.select("feature", (F.col("iqr_rate") * 100).alias("outlier_pct"),
                        (F.col("iqr_rate") * 100 < fail_pct).alias("passed"))


def percentile_outliers(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values below and above two percentiles of each column."""
    q = quantile_values(df, columns, [low, high])
    aggs = [f for c in q for f in (
        F.count(F.when(F.col(c).cast("double") < q[c][0], 1)).alias(f"lo_{c}"),
        F.count(F.when(F.col(c).cast("double") > q[c][1], 1)).alias(f"hi_{c}"))]
    return struct_rows(df.agg(*aggs), [], [
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("below"), F.col(f"hi_{c}").alias("above")) for c in q
    ])


def completeness(df: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Share of cells that hold a value."""
    filled = sum((F.count(F.col(c)) for c in df.columns[1:]), F.count(F.col(df.columns[0])))
    share = filled / (F.count(F.lit(1)) * len(df.columns))
    return df.agg(share.alias("completeness")).withColumn("passed", F.col("completeness") >= minimum)


def range_rules(df: DataFrame, rules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values outside the plausible range, for the rules whose column exists."""
    rules = {c: r for c, r in (rules or RANGE_RULES).items() if c in df.columns}
    aggs = [f for c, (lo, hi) in rules.items() for f in (
        F.count(F.when(F.col(c) < lo, 1)).alias(f"lo_{c}"), F.count(F.when(F.col(c) > hi, 1)).alias(f"hi_{c}"))]
    return struct_rows(df.agg(*aggs), [], [
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("below"), F.col(f"hi_{c}").alias("above"),
                 (F.col(f"lo_{c}") + F.col(f"hi_{c}") == 0).alias("passed")) for c in rules
    ])


def temporal_order(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose end lies before their start, among rows with both."""
    both = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    bad = F.count(F.when(F.col(end) < F.col(start), 1))
    return both.agg(F.count(F.lit(1)).alias("checked"), bad.alias("violations"), (bad == 0).alias("passed"))


def appropriateness(df: DataFrame, target_status: str = "Charged Off") -> DataFrame:
    """Observation span, number of defaults, variety of grades and terms, and the share of the largest status."""
    # One group per combination of four low-cardinality fields; everything else runs on those groups.
    year = issue_year(F.col("issue_d"))
    groups = df.groupBy(year.alias("y"), "loan_status", "grade", "term").agg(F.count(F.lit(1)).alias("n"))
    statuses = groups.groupBy("loan_status").agg(
        F.sum("n").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.collect_set("grade").alias("g"), F.collect_set("term").alias("t"))
    one = statuses.agg(
        (F.max("hi") - F.min("lo") + 1).alias("span_years"),
        F.coalesce(F.sum(F.when(F.col("loan_status") == target_status, F.col("n"))), F.lit(0)).alias("defaults"),
        F.size(F.array_distinct(F.flatten(F.collect_list("g")))).cast("bigint").alias("grades"),
        F.size(F.array_distinct(F.flatten(F.collect_list("t")))).cast("bigint").alias("terms"),
        (F.max("n") / F.sum("n")).alias("top_status_share"))
    return one.withColumn("passed", F.expr(
        "span_years >= 5 AND defaults >= 100 AND grades >= 5 AND terms >= 2 AND top_status_share < 0.95"))


def numeric_text_share(df: DataFrame, columns: list[str], coerce_above: float = 0.9) -> DataFrame:
    """Share of the non-null texts of a column that read as numbers."""
    aggs = [F.avg(F.when(F.col(c).isNotNull(), F.col(c).try_cast("double").isNotNull().cast("int"))).alias(f"s_{c}")
            for c in columns]
    return struct_rows(df.agg(*aggs), [], [
        F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("numeric_share"),
                 (F.col(f"s_{c}") > coerce_above).alias("coerce")) for c in columns
    ])


def non_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Encoded columns must not go below zero."""
    one = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in columns])
    return struct_rows(one, [], [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("lowest"), (F.col(c) >= 0).alias("passed")) for c in columns
    ])


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and the share of the most frequent one, per column."""
    return value_counts(df, columns).where(F.col("value").isNotNull()).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), (F.max("n") / F.sum("n")).alias("top_share"))
