"""Loan tape built from the supplied order tables: one row per order, one order per loan.

Only the joins a caller's columns need are planned, so a query on order columns never reads `lineitem`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanstrata.functions.text import issue_year

ORDER_COLUMNS = {
    "id": "o_orderkey",
    "issue_ts": "o_orderdate",
    "issue_d": "date_format(o_orderdate, 'MMM-yyyy')",
    "loan_status": "case o_orderstatus when 'F' then 'Fully Paid' when 'P' then 'Charged Off' else 'Current' end",
    "loan_amnt": "o_totalprice / 10",
    "funded_amnt": "case when o_orderkey % 97 = 0 then 0.0D else o_totalprice / 10 end",
    "int_rate": "concat(cast(5 + o_orderkey % 20 as string), '.', cast(o_orderkey % 10 as string), '%')",
    "term": "case when o_orderkey % 3 = 0 then ' 60 months' else ' 36 months' end",
    "emp_length": "case when o_orderkey % 13 = 12 then null when o_orderkey % 13 = 0 then '< 1 year' "
                  "when o_orderkey % 13 >= 10 then '10+ years' "
                  "else concat(cast(o_orderkey % 13 as string), ' years') end",
    "grade": "substr('ABCDE', cast(substr(o_orderpriority, 1, 1) as int), 1)",
    "sub_grade": "concat(substr('ABCDE', cast(substr(o_orderpriority, 1, 1) as int), 1), "
                 "cast(1 + o_orderkey % 5 as string))",
    "dti": "case when o_orderkey % 29 = 0 then null else (o_orderkey % 400) / 10 end",
    "installment": "o_totalprice / 360",
}
CUSTOMER_COLUMNS = {
    "annual_inc": "case when o_orderkey % 17 = 0 then null else c_acctbal * 10 + 30000 end",
    "purpose": "case when o_orderkey % 19 = 0 then null else c_mktsegment end",
}
REGION_COLUMNS = {"home_ownership": "r_name"}
LINE_COLUMNS = {
    "revol_bal": "sum(l_extendedprice * l_tax)",
    "tot_cur_bal": "sum(l_extendedprice)",
    "total_rev_hi_lim": "sum(l_extendedprice * (1 - l_discount))",
    "open_acc": "count(*)",
    "total_acc": "sum(l_quantity)",
    "recoveries": "sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) * 0.03",
    "collection_recovery_fee": "sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) * 0.003",
    "out_prncp": "sum(case when l_linestatus = 'O' then l_extendedprice else 0 end) * 0.02",
}
TAPE_COLUMNS = [
    "id", "issue_ts", "issue_d", "loan_status", "loan_amnt", "funded_amnt", "int_rate", "term", "emp_length",
    "grade", "sub_grade", "annual_inc", "dti", "purpose", "home_ownership", "installment", "revol_bal",
    "tot_cur_bal", "total_rev_hi_lim", "open_acc", "total_acc", "recoveries", "collection_recovery_fee",
    "out_prncp",
]
NUMERIC_COLUMNS = [
    "loan_amnt", "funded_amnt", "annual_inc", "dti", "installment", "revol_bal", "tot_cur_bal",
    "total_rev_hi_lim", "open_acc", "total_acc",
]
TRAIN_LAST_YEAR, TEST_FIRST_YEAR = 1998, 2000
SCORE_MODELS = ["uniform", "tied", "second", "informed", "sharp"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loan_tape(spark: SparkSession, folder: str, columns: list[str] | None = None,
              resolved: bool = False) -> DataFrame:
    """The tape restricted to `columns`; `resolved` keeps paid and charged-off loans, pushed to the scan."""
    wanted = columns or TAPE_COLUMNS
    orders = table(spark, folder, "orders")
    if resolved:
        orders = orders.where(F.col("o_orderstatus").isin("F", "P"))
    source = orders
    lines = [c for c in wanted if c in LINE_COLUMNS]
    if lines:
        sums = (
            table(spark, folder, "lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(*[F.expr(LINE_COLUMNS[c]).alias(c) for c in lines])
        )
        source = source.join(sums, "o_orderkey", "left")
    if any(c in CUSTOMER_COLUMNS or c in REGION_COLUMNS for c in wanted):
        source = source.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if any(c in REGION_COLUMNS for c in wanted):
        source = source.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        source = source.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    definitions = {**ORDER_COLUMNS, **CUSTOMER_COLUMNS, **REGION_COLUMNS}
    return source.select(*[
        F.col(c) if c in LINE_COLUMNS else F.expr(definitions[c]).alias(c) for c in wanted
    ])


def split_column(year, train_last: int = TRAIN_LAST_YEAR, test_first: int = TEST_FIRST_YEAR):
    """train / val / test by issue year; years between the cutoffs are validation."""
    return (
        F.when(year <= train_last, "train").when(year >= test_first, "test").when(year.isNotNull(), "val")
    )


def with_split(df: DataFrame, train_last: int = TRAIN_LAST_YEAR, test_first: int = TEST_FIRST_YEAR) -> DataFrame:
    year = issue_year(F.col("issue_d"))
    return df.withColumn("issue_year", year).withColumn(
        "split", split_column(F.col("issue_year"), train_last, test_first))


def resolved_loans(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Resolved loans with the default flag, the issue year and the split."""
    need = list(dict.fromkeys([*columns, "id", "issue_d", "loan_status"]))
    tape = loan_tape(spark, folder, need, resolved=True)
    flagged = tape.withColumn("default_flag", F.when(F.col("loan_status") == "Charged Off", 1).otherwise(0))
    return with_split(flagged)


def with_scores(loans: DataFrame) -> DataFrame:
    """One score column per model of `SCORE_MODELS`, computed from the key and the label."""
    key, label = F.col("id"), F.col("default_flag")
    spread = lambda step: ((key * step) % 1000 + 0.5) / 1000
    return loans.withColumns({
        "uniform": spread(37),
        "tied": (key * 37) % 20 / F.lit(20.0),
        "second": spread(61),
        "informed": 0.2 + 0.3 * label + 0.4 * spread(17),
        "sharp": 0.1 + 0.5 * label + 0.35 * spread(29),
    })


def deterministic_scores(loans: DataFrame) -> DataFrame:
    """Long `(id, split, model, label, score)` for metric checks that need no training.

    One pass over the loans; each yields one row per model.
    """
    rows = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(name).cast("double").alias("score")) for name in SCORE_MODELS
    ])
    scored = with_scores(loans).select("id", "split", F.col("default_flag").alias("label"), F.explode(rows).alias("m"))
    return scored.select("id", "split", "m.model", "label", "m.score")
