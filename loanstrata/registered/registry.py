"""Registry and run-history queries. Events stand in for registrations and stage handoffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.operators import registry
from loanstrata.plans.tape import table
from loanstrata.registered import register
from loanstrata.registered.profiling import rounded

EVENTS = """WITH reg AS (SELECT event_id, concat('m', event_id) AS model_id, upper(event_type) AS model_type, ts AS registered_at,
  value, event_id % 7 = 0 AS champion, event_id % 11 <> 0 AS registers FROM events),
champ AS (SELECT model_type, arg_max(model_id, struct_pack(t := registered_at, m := model_id)) AS champion_id FROM reg
  WHERE champion GROUP BY 1),
state AS (SELECT reg.model_id, reg.model_type, registered_at, value, champion_id IS NOT NULL AS champion FROM reg LEFT JOIN champ
  ON reg.model_type = champ.model_type AND reg.model_id = champion_id WHERE registers) """


def registrations(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("model_id"), F.col("event_type").alias("model_type"),
        F.col("ts").alias("registered_at"), "value", (F.col("event_id") % 7 == 0).alias("champion"),
        F.when(F.col("event_id") % 11 == 0, "promote").otherwise("register").alias("action"))


@register("registry_state", EVENTS + "SELECT model_id, model_type, round(value, 4) AS value, champion FROM state")
def registry_state(spark, folder):
    state = registry.registry_state(registrations(spark, folder))
    return rounded(state.select("model_id", "model_type", "value", "champion"), value=4)


@register("registry_champions", EVENTS + "SELECT model_type, champion_id FROM champ")
def registry_champions(spark, folder):
    return registry.current_champions(registrations(spark, folder))


@register("registry_summary", EVENTS + "SELECT model_type, count(*) AS models, max(CASE WHEN champion THEN model_id END) AS champion_id "
          "FROM state GROUP BY 1")
def registry_summary(spark, folder):
    return registry.registry_summary(registry.registry_state(registrations(spark, folder)))


@register("registry_newest", EVENTS + "SELECT model_id, model_type FROM state ORDER BY registered_at DESC, model_id")
def registry_newest(spark, folder):
    state = registry.registry_state(registrations(spark, folder))
    return registry.list_models(state).select("model_id", "model_type")


RUNS = """WITH h AS (SELECT user_id AS run_id, event_type AS stage, CASE WHEN event_type = 'error' AND value > 60 THEN 'failed'
  ELSE 'completed' END AS status, ts AS completed_at FROM events),
runs AS (SELECT run_id, count(DISTINCT stage) AS stages_completed, count(*) FILTER (status = 'failed') AS failed_stages,
  date_diff('second', date_trunc('second', min(completed_at)), date_trunc('second', max(completed_at))) AS duration_seconds FROM h GROUP BY 1),
m AS (SELECT user_id AS run_id, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2) """


def handoffs(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), "failed").otherwise("completed").alias("status"),
        F.col("ts").alias("completed_at"), F.create_map(F.lit("auc"), F.col("value") / 100).alias("metrics"))


@register("run_table", RUNS + "SELECT run_id, stages_completed, failed_stages, duration_seconds, CASE WHEN failed_stages > 0 THEN 'failed' "
          "WHEN stages_completed >= 5 THEN 'completed' ELSE 'partial' END AS status FROM runs")
def run_table(spark, folder):
    return registry.run_table(handoffs(spark, folder), stages=5).select(
        "run_id", "stages_completed", "failed_stages", "duration_seconds", "status")


@register("best_run", RUNS + ", l AS (SELECT user_id AS run_id, arg_max(value / 100, ts) AS v FROM events GROUP BY 1) "
          "SELECT arg_max(run_id, struct_pack(v := v, r := run_id)) AS run_id, round(max(v), 6) AS value FROM l JOIN runs USING (run_id) "
          "WHERE failed_stages = 0 AND stages_completed >= 5")
def best_run(spark, folder):
    return rounded(registry.best_run(registry.run_table(handoffs(spark, folder), stages=5)), value=6)


def _metrics(spark, folder):
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric")).agg(
        F.avg("value").alias("value"))


def _pairs(spark, folder):
    """Every run with the one before it."""
    ids = table(spark, folder, "events").select(F.col("user_id").alias("run_1")).distinct()
    return ids.withColumn("run_2", F.col("run_1") + 1)


@register("run_compare", RUNS + "SELECT a.run_id AS run_1, b.run_id AS run_2, a.metric, round(a.value, 6) AS value_1, round(b.value, 6) "
          "AS value_2, round(b.value - a.value, 6) AS change FROM m a JOIN m b ON a.metric = b.metric AND b.run_id = a.run_id + 1")
def run_compare(spark, folder):
    return rounded(registry.compare_runs(_metrics(spark, folder), _pairs(spark, folder)), value_1=6, value_2=6, change=6)


@register("run_verdict", RUNS + "SELECT a.run_id AS run_1, b.run_id AS run_2, round(sum(CASE WHEN a.metric IN ('click', 'view') THEN "
          "b.value - a.value ELSE 0 END) / 2, 6) AS overall_improvement, sum(CASE WHEN a.metric IN ('click', 'view') THEN b.value - a.value "
          "ELSE 0 END) / 2 > 0 AS run_2_better FROM m a JOIN m b ON a.metric = b.metric AND b.run_id = a.run_id + 1 GROUP BY 1, 2")
def run_verdict(spark, folder):
    changes = registry.compare_runs(_metrics(spark, folder), _pairs(spark, folder))
    return rounded(registry.compare_verdict(changes, ("click", "view")), overall_improvement=6)


@register("test_results", "SELECT event_type AS dimension, CASE WHEN value > 50 THEN 'FAIL' WHEN value > 20 THEN 'WARN' ELSE 'PASS' END "
          "AS status, count(*) AS tests FROM events GROUP BY 1, 2")
def test_results(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("dimension"), F.when(
        F.col("value") > 50, "FAIL").when(F.col("value") > 20, "WARN").otherwise("PASS").alias("status"))
    return registry.test_summary(rows)
