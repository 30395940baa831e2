"""Queries on awkward input and on sources, sinks and registry look-ups: nulls, constant columns, text keys, unseen levels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanstrata.operators import clean, features, metrics, registry
from loanstrata.plans.tape import deterministic_scores, loan_tape, resolved_loans, table
from loanstrata.registered import register
from loanstrata.registered.profiling import rounded
from loanstrata.registered.registry import EVENTS, registrations
from loanstrata.registered.sql import inflation, with_scores, with_tape
from loanstrata.session import pin, shared_folder
from loanstrata.sources import tables

CHECKED = ["annual_inc", "dti", "purpose", "emp_length", "loan_amnt", "revol_bal"]


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("null_counts", with_tape(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count FROM tape" for c in CHECKED)))
def null_counts(spark, folder):
    return tables.null_counts(loan_tape(spark, folder, CHECKED).select(*CHECKED))


@register("table_info", "SELECT count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE part)) AS n_columns, "
          "'p_partkey' IN (SELECT column_name FROM (DESCRIBE part)) AS has_key FROM part")
def table_info(spark, folder):
    info = tables.table_info(table(spark, folder, "part"))
    return info.select("row_count", F.size("columns").cast("long").alias("n_columns"), F.array_contains("columns", "p_partkey").alias("has_key"))


@register("csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, folder):
    source = table(spark, folder, "supplier")
    path = _fresh(spark, "csv")
    tables.write_csv(source, path)
    return tables.ingest_csv(spark, path, f"{path}-parquet", source.schema).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@register("json_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def json_round_trip(spark, folder):
    source = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    path = _fresh(spark, "json")
    tables.write_json(source, path)
    return spark.read.schema(source.schema).json(path)


@register("parquet_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_round_trip(spark, folder):
    source = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = _fresh(spark, "parquet")
    tables.write_parquet(source, path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"), "o_totalprice")


def _odd_columns(spark, folder):
    """Loans with a constant column, an all-null column and infinite values among ordinary ones."""
    loans = resolved_loans(spark, folder, ["loan_amnt", "annual_inc", "dti"])
    return loans.select("loan_amnt", "annual_inc", "dti", F.lit(0.1).alias("fixed"), F.lit(None).cast("double").alias("empty"),
                        F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 7 == 0, float("inf")).otherwise(F.col("dti")).alias("holed"))


ODD = ["loan_amnt", "annual_inc", "dti", "fixed", "empty", "holed"]


@register("corr_constant", with_tape(", odd AS (SELECT loan_amnt, annual_inc, dti, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE dti END AS holed FROM resolved) "
    + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                         + ("max(CAST(NULL AS DOUBLE))" if {a, b} & {"fixed", "empty"} else f"round(corr({a}, {b}), 8)") + " AS r FROM odd"
                         for i, a in enumerate(ODD) for b in ODD[i + 1:])))
def corr_constant(spark, folder):
    return rounded(features.correlation_pairs(_odd_columns(spark, folder), ODD), r=8)


MANY = [f"x{i}" for i in range(24)]


@register("corr_many", with_tape(", many AS (SELECT " + ", ".join(
    f"CASE WHEN id % {i + 11} = 0 THEN NULL ELSE loan_amnt + ((id * {2 * i + 3}) % 101) * 100.0 END AS x{i}" for i in range(24))
    + " FROM resolved), long AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 8) AS r FROM many"
                                                          for i, a in enumerate(MANY) for b in MANY[i + 1:]) + ") SELECT * FROM long"))
def corr_many(spark, folder):
    loans = resolved_loans(spark, folder, ["loan_amnt"])
    wide = loans.select(*[F.when(F.col("id") % (i + 11) != 0, F.col("loan_amnt") + ((F.col("id") * (2 * i + 3)) % 101) * 100.0).alias(f"x{i}")
                          for i in range(24)])
    return rounded(features.correlation_pairs(wide, MANY), r=8)


VIF_COLUMNS = ["loan_amnt", "annual_inc", "dti", "revol_bal", "open_acc"]


@register("vif_five", with_tape(", " + inflation(VIF_COLUMNS) + " SELECT feature, round(vif, 6) AS vif, vif > 10 AS flagged FROM vifs"))
def vif_five(spark, folder):
    return rounded(features.variance_inflation(pin(resolved_loans(spark, folder, VIF_COLUMNS)), VIF_COLUMNS), vif=6)


@register("calibration_text_ids", with_scores(
    ", ranked AS (SELECT split, score, label, ntile(10) OVER (PARTITION BY split ORDER BY holed NULLS FIRST, tie) AS bucket FROM ("
    "SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE score END AS holed, concat('L', id) AS tie FROM scores WHERE model = 'tied')) "
    "SELECT split, bucket, count(*) AS n, CAST(sum(label) AS BIGINT) AS observed FROM ranked GROUP BY 1, 2"))
def calibration_text_ids(spark, folder):
    """A quarter of the scores null, many ties, and text ids that decide them."""
    rows = deterministic_scores(resolved_loans(spark, folder, [])).where("model = 'tied'").select(
        "split", "label", F.when(F.col("id") % 4 != 0, F.col("score")).alias("score"), F.concat(F.lit("L"), F.col("id")).alias("id"))
    out = metrics.calibration_table(rows, ["split"])
    return out.select("split", "bucket", "n", "observed")


@register("encode_target_unseen", with_tape(
    ", fit AS (SELECT * FROM resolved WHERE split = 'train' AND purpose <> 'BUILDING'), rate AS (SELECT purpose, avg(default_flag) AS r FROM fit "
    "GROUP BY 1) SELECT id, round(CASE WHEN resolved.purpose IS NULL THEN NULL ELSE coalesce(r, (SELECT avg(default_flag) FROM fit)) END, 6) AS purpose_risk "
    "FROM resolved LEFT JOIN rate ON resolved.purpose = rate.purpose"))
def encode_target_unseen(spark, folder):
    """BUILDING never occurs in the fitted rows; its loans keep a rate."""
    loans = resolved_loans(spark, folder, ["purpose"])
    coded = clean.encode_target_rate(loans, fit_on=loans.where("split = 'train' AND purpose <> 'BUILDING'"))
    return rounded(coded.select("id", "purpose_risk"), purpose_risk=6)


@register("registry_champion_of_type", EVENTS + "SELECT model_id, model_type, round(value, 4) AS value FROM state WHERE champion AND model_type = 'CLICK'")
def registry_champion_of_type(spark, folder):
    state = registry.registry_state(registrations(spark, folder))
    return rounded(registry.get_champion(state, "click").select("model_id", "model_type", "value"), value=4)


@register("registry_model", EVENTS + "SELECT model_id, model_type, champion FROM state WHERE model_id = 'm5'")
def registry_model(spark, folder):
    return registry.get_model(registry.registry_state(registrations(spark, folder)), "m5").select("model_id", "model_type", "champion")


_KEPT = ["loan_amnt", "funded_amnt", "int_rate", "term", "emp_length", "grade", "sub_grade", "annual_inc", "dti", "purpose", "home_ownership",
         "installment", "revol_bal", "tot_cur_bal", "total_rev_hi_lim", "open_acc", "total_acc"]
_FIXED = {"funded_amnt": (1000, 40000), "annual_inc": (10000, 200000), "dti": (0, 50)}
_CLIPPED = ["annual_inc", "revol_bal", "loan_amnt", "funded_amnt", "dti", "open_acc"]
_LINEAGE = (
    ", gaps AS (SELECT count(*) AS n, " + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _KEPT) + " AS nulls FROM resolved), "
    "med AS (SELECT grade, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _CLIPPED) + " FROM resolved GROUP BY grade), "
    "imp AS (SELECT " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _CLIPPED) + " FROM resolved JOIN med USING (grade)), "
    "lim AS (SELECT " + ", ".join(
        f"{_FIXED[c][0]}::DOUBLE AS lo_{c}, {_FIXED[c][1]}::DOUBLE AS hi_{c}" if c in _FIXED else
        f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _CLIPPED) + " FROM imp), "
    "cut AS (SELECT " + ", ".join(f"count(*) FILTER ({c} < lo_{c} OR {c} > hi_{c}) AS c_{c}, any_value(lo_{c}) AS lo_{c}, any_value(hi_{c}) AS hi_{c}"
                                  for c in _CLIPPED) + " FROM imp, lim) ")


@register("cleaning_steps", with_tape(_LINEAGE +
    "SELECT 0 AS step, 'initial' AS action, count(*) AS rows_before, count(*) AS row_count, NULL::BIGINT AS nulls_before, NULL::BIGINT AS nulls_after, "
    "NULL::BIGINT AS values_clipped, 0 AS dropped FROM tape UNION ALL SELECT 1, 'resolved_only', (SELECT count(*) FROM tape), n, NULL, NULL, NULL, 0 FROM gaps "
    "UNION ALL SELECT 2, 'drop_leakage', n, n, NULL, NULL, NULL, 3 FROM gaps "
    "UNION ALL SELECT 3, 'coerce_types', n, n, NULL, nulls, NULL, 3 FROM gaps UNION ALL SELECT 4, 'impute', n, n, nulls, 0, NULL, 0 FROM gaps "
    "UNION ALL SELECT 5, 'cap', n, n, 0, 0, " + " + ".join(f"c_{c}" for c in _CLIPPED) + ", 0 FROM gaps, cut "
    "UNION ALL SELECT 6, 'encode', n, n, NULL, NULL, NULL, 4 FROM gaps"))
def cleaning_steps(spark, folder):
    """What each step of the cleaning run reports of itself."""
    cleaned = clean.clean_tape(loan_tape(spark, folder), train_last_year=1998)
    return cleaned.lineage.select("step", "action", "rows_before", F.col("rows").alias("row_count"), "nulls_before", "nulls_after", "values_clipped",
                                  F.size("columns_dropped").alias("dropped"))


@register("cleaning_columns", with_tape(_LINEAGE + " UNION ALL ".join(
    [f"SELECT 'impute' AS action, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls_before, 0 AS nulls_after, NULL::DOUBLE AS lower, "
     f"NULL::DOUBLE AS upper, NULL::BIGINT AS clipped FROM resolved HAVING nulls_before > 0" for c in _KEPT]
    + [f"SELECT 'cap', '{c}', NULL, NULL, round(lo_{c}, 4), round(hi_{c}, 4), c_{c} FROM cut" for c in _CLIPPED])))
def cleaning_columns(spark, folder):
    """Nulls before and after imputation, and bounds and clipped values of capping, per column."""
    cleaned = clean.clean_tape(loan_tape(spark, folder), train_last_year=1998)
    return rounded(cleaned.lineage_columns.drop("step"), lower=4, upper=4)


@register("encode_sparse", with_tape(
    ", w AS (SELECT id, CASE WHEN id % 17 <> 0 THEN concat('L', id % 11000) END AS level FROM tape), "
    "r AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT level FROM w WHERE level IS NOT NULL)) "
    "SELECT id, CASE WHEN place IS NULL THEN concat('(', (SELECT any_value(n) FROM r), ',[],[])') ELSE concat('(', n, ',[', place, '],[1.0])') END AS vector "
    "FROM w LEFT JOIN r USING (level)"))
def encode_sparse(spark, folder):
    """A column of thousands of levels as sparse vectors; every seventeenth value is null."""
    wide = loan_tape(spark, folder, ["id"]).withColumn(
        "level", F.when(F.col("id") % 17 != 0, F.concat(F.lit("L"), (F.col("id") % 11000).cast("string"))))
    return clean.encode_sparse(wide, "level").select("id", F.col("level_vec").cast("string").alias("vector"))


_GAPPED = ("(SELECT " + ", ".join(f"coalesce(CASE WHEN id % 2 = {i % 2} THEN {c} END, m_{c}) AS {c}" for i, c in enumerate(VIF_COLUMNS))
           + " FROM resolved, (SELECT " + ", ".join(f"median(CASE WHEN id % 2 = {i % 2} THEN {c} END) AS m_{c}" for i, c in enumerate(VIF_COLUMNS))
           + " FROM resolved))")


@register("vif_gaps", with_tape(", " + inflation(VIF_COLUMNS, _GAPPED) + " SELECT 'median' AS missing, feature, round(vif, 6) AS vif FROM vifs "
                                "UNION ALL SELECT 'complete', feature, NULL FROM vifs"))
def vif_gaps(spark, folder):
    """Columns filled on alternate rows, so that no row is complete: null without a fill, medians with it."""
    loans = resolved_loans(spark, folder, VIF_COLUMNS)
    gapped = pin(loans.select("id", *[F.when(F.col("id") % 2 == i % 2, F.col(c)).alias(c) for i, c in enumerate(VIF_COLUMNS)]))
    found = [features.variance_inflation(gapped, VIF_COLUMNS, missing=how).select(F.lit(how).alias("missing"), "feature", "vif")
             for how in ("median", "complete")]
    return rounded(found[0].unionByName(found[1]), vif=6)


@register("list_tables", "SELECT 'tape_customers' AS name, true AS temporary, count(*) AS row_count FROM customer UNION ALL SELECT 'tape_orders', true, count(*) FROM orders")
def list_tables(spark, folder):
    """The views that a session holds under a prefix, with their rows."""
    _views(spark, folder)
    found = tables.table_rows(spark).where("name IN ('tape_orders', 'tape_customers')").select("name", "temporary")
    sizes = [spark.table(r["name"]).agg(F.lit(r["name"]).alias("name"), F.count(F.lit(1)).alias("row_count")) for r in found.collect()]
    return found.join(sizes[0].unionByName(sizes[1]), "name")


def _views(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("tape_orders")
    table(spark, folder, "customer").createOrReplaceTempView("tape_customers")


def _dictionary(spark, folder):
    """A dictionary made of the table's own status values: the text of a column is the number of orders behind it."""
    orders = table(spark, folder, "orders")
    counted = orders.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("k"))
    return counted.select(F.explode(F.array(
        F.struct(F.lit(" O_OrderKey ").alias("field"), F.concat(F.lit("key of "), F.col("n").cast("string"), F.lit(" orders")).alias("description")),
        F.struct(F.lit("o_custkey").alias("field"), F.concat(F.lit("one of "), F.col("k").cast("string"), F.lit(" customers")).alias("description")),
        F.struct(F.lit("no_such").alias("field"), F.lit("left over").alias("description")))).alias("d")).select("d.*")


_SCHEMA_SQL = ("WITH c AS (SELECT column_name AS name, column_index AS position FROM duckdb_columns() WHERE table_name = 'orders'), "
               "n AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders), d AS (SELECT name, position, CASE name WHEN 'o_orderkey' "
               "THEN concat('key of ', n, ' orders') WHEN 'o_custkey' THEN concat('one of ', k, ' customers') END AS description FROM c, n) ")


@register("describe_table", _SCHEMA_SQL + "SELECT row_number() OVER (ORDER BY position) - 1 AS position, name, name = 'o_orderkey' AS is_key, description FROM d")
def describe_table(spark, folder):
    """Columns of a view with the dictionary's text, whatever the case and blanks of its names."""
    _views(spark, folder)
    found = tables.describe_table(spark.table("tape_orders"), _dictionary(spark, folder), "o_orderkey")
    return found.select(F.col("position").cast("long").alias("position"), "name", "is_key", "description")


@register("dictionary_summary", _SCHEMA_SQL + "SELECT count(description) AS matched, count(*) - count(description) AS unmatched, "
          "list(name ORDER BY name) FILTER (description IS NULL) AS first_unmatched FROM d")
def dictionary_summary(spark, folder):
    return tables.dictionary_summary(table(spark, folder, "orders"), _dictionary(spark, folder))


@register("dictionary_gaps", _SCHEMA_SQL + "SELECT 'undocumented' AS kind, name FROM d WHERE description IS NULL UNION ALL SELECT 'unused', 'no_such'")
def dictionary_gaps(spark, folder):
    return tables.dictionary_gaps(table(spark, folder, "orders"), _dictionary(spark, folder))
