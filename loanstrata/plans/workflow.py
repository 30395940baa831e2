"""The full run from tape to stressed losses, as one driver function over the operators.

Each stage ends in a written table that the next one reads, and leaves a handoff row with its status, duration and
metrics. A failed stage is recorded and ends the run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanstrata.operators import candidates, clean, features, loss, metrics, models
from loanstrata.operators.candidates import Candidate
from loanstrata.operators.registry import HANDOFF_SCHEMA, register_model
from loanstrata.plans.tape import split_column
from loanstrata.session import PINNED, release_pins
from loanstrata.sources.tables import write_csv, write_json, write_parquet


@dataclass
class Plan:
    """What a run needs besides the tape."""
    train_last_year: int = 2015
    test_first_year: int = 2017
    iv_threshold: float = 0.02
    # Strongest features kept when none passes the selection; 0 stops the run instead.
    fallback_features: int = 3
    fit_scope: str = "train"
    stages: tuple[str, ...] = ("data", "features", "pd", "lgd", "ead", "loss")
    pd_pool: list[Candidate] = field(default_factory=lambda: candidates.PD_CANDIDATES)
    lgd_pools: tuple[list[Candidate], list[Candidate]] = (candidates.LGD_STAGE1, candidates.LGD_STAGE2)
    ead_pool: list[Candidate] = field(default_factory=lambda: candidates.EAD_CANDIDATES)
    settings: models.Settings = field(default_factory=models.Settings)


@dataclass
class Run:
    spark: SparkSession
    root: str
    plan: Plan
    tape: DataFrame
    selected: list[str] = field(default_factory=list)
    pd: tuple | None = None
    lgd: models.TwoStage | None = None
    ead: tuple | None = None
    handoffs: list[tuple] = field(default_factory=list)

    def path(self, stage: str, name: str) -> str:
        return f"{self.root}/{stage}/{name}"

    def read(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, name))


def _data(run: Run) -> dict[str, float]:
    made = clean.clean_tape(run.tape, fit_scope=run.plan.fit_scope, train_last_year=run.plan.train_last_year)
    write_parquet(made.features, run.path("data", "features"))
    write_parquet(made.targets, run.path("data", "targets"))
    write_parquet(made.leakage, run.path("data", "leakage"))
    write_json(made.lineage, run.path("data", "lineage"))
    rate = run.read("data", "targets").agg(F.avg(F.col("default_flag").cast("double")).alias("r"), F.count("*").alias("n")).collect()[0]
    return {"default_rate": float(rate["r"] or 0.0), "rows": float(rate["n"])}


def _features(run: Run) -> dict[str, float]:
    year = F.col("issue_year")
    ready = features.ratio_features(run.read("data", "features")).withColumn(
        "split", split_column(year, run.plan.train_last_year, run.plan.test_first_year))
    names = [f.name for f in ready.schema.fields if f.name not in ("id", "default_flag", "issue_year", "split")]
    found = features.select_features(ready.where("split = 'train'"), names, "default_flag", run.plan.iv_threshold)
    strongest = [] if found.selected else [
        r["feature"] for r in found.values.orderBy(F.desc("iv"), "feature").limit(run.plan.fallback_features).collect()]
    run.selected = found.selected or strongest
    if not run.selected:
        raise ValueError("no feature passes the selection")
    kept = run.spark.createDataFrame([(f, "fallback", "kept: no feature passed the selection") for f in strongest], found.log.schema)
    write_json(found.log.unionByName(kept), run.path("features", "removed"))
    keep = ["id", "split", "default_flag", "issue_year"]
    targets = run.read("data", "targets").select("id", "lgd", "ead", F.unix_timestamp(F.col("issue_d").cast("timestamp")).cast("double").alias("issued"))
    extra = [c for c in ("grade_ord",) if c in ready.columns and c not in run.selected]
    matrix = features.feature_matrix(ready, [*run.selected, *extra], keep).join(targets, "id")
    write_parquet(matrix, run.path("features", "matrix"))
    return {"features": float(len(run.selected))}


def _pd(run: Run) -> dict[str, float]:
    frame = models.model_frame(run.read("features", "matrix"), run.selected, "default_flag", keep=["issued"], balanced=True)
    found = models.pd_tournament(frame, run.plan.pd_pool, run.plan.settings, order="issued")
    write_csv(found.leaderboard, run.path("pd", "leaderboard"))
    write_parquet(found.tiers, run.path("pd", "tiers"))
    write_parquet(found.trace, run.path("pd", "trace"))
    table = models.coefficient_table(run.read("features", "matrix").where("split = 'train'"), run.selected, "default_flag")
    write_csv(table.table, run.path("pd", "coefficients"))
    models.save_model(found.champion, frame, run.path("pd", "champion"))
    run.pd = (frame, found.champion)
    best = found.leaderboard.where("rank = 1").collect()[0]
    scores = {"auc": best["auc"], "ks": best["ks"], "brier": best["brier"]}
    register_model(run.spark, f"{run.root}/registry", {
        "model_type": "PD", "algorithm": found.champion.candidate.kind, "metrics": {k: float(v) for k, v in scores.items()},
        "hyperparameters": {k: str(v) for k, v in found.champion.candidate.params.items()}, "champion": True,
        "model_path": run.path("pd", "champion"), "feature_count": len(found.champion.features),
        "training_time_s": found.champion.seconds, "registered_at": datetime.now(timezone.utc).replace(tzinfo=None)})
    return {k: float(v) for k, v in scores.items()}


def _lgd(run: Run) -> dict[str, float]:
    defaults = clean.loss_stage_targets(run.read("features", "matrix"))
    run.lgd = models.lgd_two_stage(defaults, run.selected, *run.plan.lgd_pools, run.plan.settings.workers)
    write_csv(run.lgd.stage1, run.path("lgd", "stage1"))
    write_csv(run.lgd.stage2, run.path("lgd", "stage2"))
    test = run.lgd.predict(defaults.where("split = 'test'")).select(
        F.lit("test").alias("split"), F.lit("lgd").alias("model"), F.col("lgd").alias("actual"), "predicted")
    row = metrics.regression_report(test).collect()
    return {"test_rmse": float(row[0]["rmse"]), "test_mae": float(row[0]["mae"])} if row else {}


def _ead(run: Run) -> dict[str, float]:
    frame = models.model_frame(run.read("features", "matrix").where("ead IS NOT NULL"), run.selected, "ead")
    found = models.regression_tournament(frame, run.plan.ead_pool, 0.0, None, run.plan.settings.workers)
    write_csv(found.entries, run.path("ead", "leaderboard"))
    models.save_model(found.champion, frame, run.path("ead", "champion"))
    run.ead = (frame, found.champion)
    best = found.entries.where(F.col("model") == found.champion.name).collect()[0]
    return {"val_rmse": float(best["val_rmse"]), "test_rmse": float(best["test_rmse"])}


def _loss(run: Run) -> dict[str, float]:
    rows = run.read("features", "matrix").where("split = 'test'").withColumnsRenamed(
        {"lgd": "actual_lgd", "ead": "actual_ead", "default_flag": "actual_default"})
    scored = models.add_score(rows, *run.pd, "pd")
    scored = models.add_score(run.lgd.predict(scored, "lgd"), *run.ead, "ead", 0.0, None)
    grade = F.substring(F.lit(clean.GRADES), F.col("grade_ord").cast("int"), F.lit(1)) if "grade_ord" in rows.columns else F.lit(None)
    el = loss.expected_loss(scored.withColumn("grade", grade.cast("string"))).select(
        "id", "pd", "lgd", "ead", "expected_loss", "actual_default", "actual_lgd", "actual_ead", "grade", "issue_year")
    write_parquet(el, run.path("loss", "results"), ["issue_year"])
    written = run.read("loss", "results")
    write_csv(loss.rollup(written, "grade"), run.path("loss", "by_grade"))
    write_csv(loss.stress_report(written), run.path("loss", "stress"))
    write_parquet(loss.under_stress(written), run.path("loss", "stressed"), ["scenario"])
    one = loss.loss_summary(written).collect()[0]
    return {"portfolio_el": float(one["portfolio_el"] or 0.0), "el_rate": float(one["el_rate"] or 0.0)}


STAGES: dict[str, Callable[[Run], dict[str, float]]] = {
    "data": _data, "features": _features, "pd": _pd, "lgd": _lgd, "ead": _ead, "loss": _loss}


def run_all(tape: DataFrame, root: str, plan: Plan | None = None) -> Run:
    """Runs the planned stages in order; the handoff of each is written to `<root>/<stage>/handoff.json`.

    Intermediate tables of the run are deleted at its end; its results are in the folder.
    """
    pinned = len(PINNED)
    run = Run(tape.sparkSession, root.rstrip("/"), plan or Plan(), tape)
    for stage in run.plan.stages:
        begun = datetime.now(timezone.utc).replace(tzinfo=None)
        start, errors, found = time.perf_counter(), [], {}
        try:
            found = STAGES[stage](run)
        except Exception as problem:  # noqa: BLE001
            errors = [f"{type(problem).__name__}: {str(problem)[:500]}"]
        ended = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (stage, "failed" if errors else "completed", begun, ended, round(time.perf_counter() - start, 1),
               {"root": run.path(stage, "")}, found, errors)
        run.handoffs.append(row)
        write_handoff(run, stage, row)
        if errors:
            break
    release_pins(run.spark, pinned)
    return run


def write_handoff(run: Run, stage: str, row: tuple) -> None:
    """One JSON document at a fixed name, through the Hadoop file system so that shared storage works."""
    names = [f.name for f in HANDOFF_SCHEMA.fields]
    text = json.dumps({n: v.isoformat() if isinstance(v, datetime) else v for n, v in zip(names, row)})
    context = run.spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(run.path(stage, "handoff.json"))
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def handoff_table(run: Run) -> DataFrame:
    return run.spark.createDataFrame(run.handoffs, HANDOFF_SCHEMA)
