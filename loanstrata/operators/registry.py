"""Model registry, run history and test results as append-only rows.

The current state is computed from the events by mergeable aggregates (latest by time), never by sorting a whole
group, so a type that holds a third of all events costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("model_type", T.StringType()),
    T.StructField("algorithm", T.StringType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("model_path", T.StringType()), T.StructField("champion", T.BooleanType()),
    T.StructField("dataset_hash", T.StringType()), T.StructField("feature_count", T.IntegerType()),
    T.StructField("training_time_s", T.DoubleType()), T.StructField("registered_at", T.TimestampType()),
    T.StructField("action", T.StringType()),
])
HANDOFF_SCHEMA = T.StructType([
    T.StructField("agent", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()), T.StructField("completed_at", T.TimestampType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("output_files", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("errors", T.ArrayType(T.StringType())),
])
TEST_SCHEMA = ("test_id string, test_name string, dimension string, status string, detail string, evidence string, "
               "remediation string")
STAGES = 7


def append(df: DataFrame, path: str) -> None:
    """Adds registration or promotion events."""
    df.write.mode("append").parquet(path)


def register_model(spark: SparkSession, path: str, row: dict) -> str:
    """Appends one registration; its id is type, algorithm and time."""
    at = row["registered_at"]
    model_id = f"{row['model_type'].upper()}_{row['algorithm']}_{at:%Y%m%d_%H%M%S}"
    full = {**row, "model_id": model_id, "model_type": row["model_type"].upper(), "action": "register"}
    append(spark.createDataFrame([tuple(full.get(f.name) for f in MODEL_SCHEMA.fields)], MODEL_SCHEMA), path)
    return model_id


def promote(spark: SparkSession, path: str, model_id: str, at) -> bool:
    """Appends a promotion of a registered model; False when the id is unknown."""
    known = spark.read.schema(MODEL_SCHEMA).parquet(path).where(
        (F.col("model_id") == model_id) & (F.col("action") == "register")).limit(1)
    event = known.withColumns({"champion": F.lit(True), "registered_at": F.lit(at), "action": F.lit("promote")})
    rows = event.collect()
    if rows:
        append(spark.createDataFrame(rows, MODEL_SCHEMA), path)
    return bool(rows)


def current_champions(events: DataFrame) -> DataFrame:
    """The model of the latest champion registration or promotion, per type."""
    newest = F.max_by("model_id", F.struct("registered_at", "model_id"))
    return events.where("champion").groupBy(F.upper("model_type").alias("model_type")).agg(newest.alias("champion_id"))


def registry_state(events: DataFrame) -> DataFrame:
    """Every registered model with its current champion flag: an earlier champion of the type is demoted."""
    champions = current_champions(events).select(F.col("model_type").alias("_t"), "champion_id")
    models = events.where(F.col("action") == "register").withColumn("model_type", F.upper("model_type"))
    joined = models.join(champions, [models["model_type"] == F.col("_t"), models["model_id"] == F.col("champion_id")], "left")
    return joined.withColumn("champion", F.col("champion_id").isNotNull()).drop("_t", "champion_id")


def list_models(state: DataFrame, model_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, optionally of one type."""
    chosen = state if model_type is None else state.where(F.col("model_type") == model_type.upper())
    newest = chosen.orderBy(F.desc("registered_at"), "model_id")
    return newest if limit is None else newest.limit(limit)


def get_model(state: DataFrame, model_id: str) -> DataFrame:
    return state.where(F.col("model_id") == model_id)


def get_champion(state: DataFrame, model_type: str) -> DataFrame:
    return state.where(F.col("champion") & (F.col("model_type") == model_type.upper()))


def registry_summary(state: DataFrame) -> DataFrame:
    """Models per type, the overall total and the champion of each type."""
    per = state.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("models"), F.max(F.when(F.col("champion"), F.col("model_id"))).alias("champion_id"))
    return per


def scan_runs(spark: SparkSession, root: str, pattern: str = "*", stages: int = STAGES) -> DataFrame:
    """Run table from `<root>/<run>/<stage>/handoff.json`; the run and stage are taken from the file path."""
    files = spark.read.schema(HANDOFF_SCHEMA).option("multiLine", True).json(f"{root}/{pattern}/*/handoff.json")
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select("*", F.element_at(parts, -3).alias("run_id"), F.element_at(parts, -2).alias("stage"))
    return run_table(rows, stages)


def count_artifacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Output files per run by extension; only file names are listed, no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{pattern}").select("path")
    tail = F.split(F.split("path", F.lit(root.rstrip("/") + "/")).getItem(1), "/")
    return listed.select(tail.getItem(0).alias("run_id"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind")).groupBy(
        "run_id", "kind").agg(F.count(F.lit(1)).alias("artifacts"))


def run_table(handoffs: DataFrame, stages: int = STAGES) -> DataFrame:
    """Status, stages, duration and the metrics of the tournament stage per run, from handoff rows.

    Needs run_id, stage, status, completed_at and metrics. A run failed when a stage failed, is complete when all
    stages are there, else partial.
    """
    done = handoffs.groupBy("run_id").agg(
        F.count_distinct("stage").alias("stages_completed"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed_stages"),
        F.min("completed_at").alias("first_at"), F.max("completed_at").alias("last_at"),
        F.max_by("metrics", F.struct(F.map_contains_key("metrics", "auc"), "completed_at")).alias("metrics"))
    seconds = F.unix_timestamp(F.col("last_at").cast("timestamp")) - F.unix_timestamp(F.col("first_at").cast("timestamp"))
    status = F.when(F.col("failed_stages") > 0, "failed").when(F.col("stages_completed") >= stages, "completed").otherwise(
        "partial")
    return done.withColumns({"status": status, "duration_seconds": F.greatest(seconds, F.lit(0))})


def run_metrics(runs: DataFrame) -> DataFrame:
    """`(run_id, metric, value)` rows."""
    return runs.select("run_id", F.explode("metrics").alias("metric", "value"))


def compare_runs(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change of every metric both runs hold, for each `(run_1, run_2)` of a table of pairs."""
    left = metrics.select(F.col("run_id").alias("run_1"), "metric", F.col("value").alias("value_1"))
    right = metrics.select(F.col("run_id").alias("run_2"), "metric", F.col("value").alias("value_2"))
    both = pairs.join(left, "run_1").join(right, ["run_2", "metric"])
    return both.withColumn("change", F.col("value_2") - F.col("value_1"))


def compare_verdict(changes: DataFrame, judged: tuple[str, ...] = ("auc", "accuracy")) -> DataFrame:
    """Mean change over the judged metrics, a missing one counting as no change."""
    total = F.sum(F.when(F.col("metric").isin(*judged), F.col("change")).otherwise(0.0)) / len(judged)
    return changes.groupBy("run_1", "run_2").agg(total.alias("overall_improvement"), (total > 0).alias("run_2_better"))


def best_run(runs: DataFrame, metric: str = "auc", status: str = "completed") -> DataFrame:
    """The run of a status with the highest value of a metric."""
    value = F.col("metrics")[metric]
    known = runs.where((F.col("status") == status) & value.isNotNull())
    return known.agg(F.max_by("run_id", F.struct(value.alias("v"), "run_id")).alias("run_id"), F.max(value).alias("value"))


def test_summary(results: DataFrame) -> DataFrame:
    """Results per dimension and status."""
    return results.groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("tests"))
