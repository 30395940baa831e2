"""The whole run on the smallest tables, and the run history read back from its files."""

from __future__ import annotations

import tempfile

import pytest

from conftest import SMALL
from loanstrata.operators import candidates, models, registry
from loanstrata.plans.tape import loan_tape
from loanstrata.session import PINNED
from loanstrata.plans.workflow import Plan, handoff_table, run_all
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def finished(spark):
    root = tempfile.mkdtemp(prefix="run-") + "/run_1"
    k = F.col("id")
    tape = loan_tape(spark, SMALL).withColumn("loan_amnt", F.col("loan_amnt") + F.when(
        F.col("loan_status") == "Charged Off", 12000).otherwise(0))
    tape = tape.withColumn("recoveries", F.when(k % 3 == 0, F.col("funded_amnt") * 2).otherwise(F.col("recoveries")))
    plan = Plan(train_last_year=1998, test_first_year=2000,
                pd_pool=[candidates.PD_CANDIDATES[0], candidates.PD_CANDIDATES[3].with_params(min_samples_leaf=20)],
                lgd_pools=(candidates.LGD_STAGE1[:1], candidates.LGD_STAGE2[:2]), ead_pool=candidates.EAD_CANDIDATES[:2],
                settings=models.Settings(top_k=1, rounds=1, draws=0, workers=2))
    before = len(PINNED)
    run = run_all(tape, root, plan)
    assert len(PINNED) == before
    return run, root


def test_every_stage_completes(finished):
    run, _ = finished
    rows = handoff_table(run).collect()
    assert [(r["agent"], r["status"], r["errors"]) for r in rows] == [
        (s, "completed", []) for s in ("data", "features", "pd", "lgd", "ead", "loss")]
    assert 0.5 < rows[2]["metrics"]["auc"] <= 1.0


def test_losses_hold_their_bounds(spark, finished):
    run, _ = finished
    el = run.read("loss", "results")
    n = el.count()
    assert n == run.read("features", "matrix").where("split = 'test'").count()
    assert el.where("pd BETWEEN 0 AND 1 AND lgd BETWEEN 0 AND 1 AND expected_loss <= ead + 1e-9").count() == n
    stressed = {r["scenario"]: r["s"] for r in run.read("loss", "stressed").groupBy("scenario").agg(F.sum("stressed_el").alias("s")).collect()}
    assert stressed["base"] <= stressed["adverse"] <= stressed["severe"]


def test_saved_champion_scores_like_the_fitted_one(spark, finished):
    run, _ = finished
    rows = run.read("features", "matrix").where("split = 'test'")
    saved = models.load_and_score(run.path("pd", "champion"), rows, ["id"])
    live = models.add_score(rows, *run.pd, "live").select("id", "live")
    assert saved.join(live, "id").where("abs(score - live) > 1e-12").count() == 0


def test_run_history_reads_the_files(spark, finished):
    _, root = finished
    base = root.rsplit("/", 1)[0]
    runs = registry.scan_runs(spark, base, stages=6).collect()
    assert [(r["run_id"], r["status"], r["stages_completed"]) for r in runs] == [("run_1", "completed", 6)]
    scanned = registry.scan_runs(spark, base).collect()
    assert scanned[0]["status"] == "partial" and scanned[0]["metrics"]["auc"] > 0.5
    kinds = {r["kind"] for r in registry.count_artifacts(spark, base).collect()}
    assert {"parquet", "csv", "json"} <= kinds
    state = registry.registry_state(spark.read.schema(registry.MODEL_SCHEMA).parquet(f"{root}/registry"))
    assert registry.get_champion(state, "pd").count() == 1
