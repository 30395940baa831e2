"""Checks on a fitted model: shocks, noise, missing features, permutation, partial dependence, synthetic minority rows.

Variants of a row (scenarios, noise levels, grid points, permuted features) are made by exploding literals in the task
that holds the row, so they are scored where they are and only aggregates are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.functions.ordered import quantile_values, rank_values
from loanstrata.operators import metrics, models
from loanstrata.operators.candidates import Candidate
from loanstrata.operators.models import Fitted, ModelFrame
from loanstrata.operators.profile import struct_rows
from loanstrata.functions.stats import moments
from loanstrata.session import attach, pin

# Fixed values: (scenario, {feature: (added, factor)}).
SHOCKS = [
    ("base", {}),
    ("adverse", {"int_rate": (5.0, 1.0), "annual_inc": (0.0, 0.8)}),
    ("severe", {"int_rate": (10.0, 1.0), "annual_inc": (0.0, 0.7), "dti": (0.0, 1.2)}),
]
NOISE_LEVELS = [0.0, 0.01, 0.05, 0.10]
HIGH_IMPACT, MEDIUM_IMPACT, MAX_DROP_PCT = 0.10, 0.02, 10.0
# Distances that a task holds at once.
BLOCK_CELLS = 1_000_000


def rescore(frame: ModelFrame, fitted: Fitted, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Scores raw feature columns with the frame's preparation; keeps the named columns."""
    return models.add_score(rows, frame, fitted).select(*keep, "score")


def variants(df: DataFrame, name: str, features: list[str], made: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """Each row once per variant, with the features a variant redefines."""
    other = [c for c in df.columns if c not in features]
    return struct_rows(df, other, [
        F.struct(F.lit(label).alias(name), *[changed.get(f, F.col(f)).cast("double").alias(f) for f in features])
        for label, changed in made])


def feature_shocks(frame: ModelFrame, fitted: Fitted, rows: DataFrame, shocks: list | None = None) -> DataFrame:
    """Mean and range of the score when features are shifted and scaled, against the unshocked scores."""
    made = [(name, {f: F.col(f) * factor + added for f, (added, factor) in changes.items() if f in frame.features})
            for name, changes in (shocks or SHOCKS)]
    scored = rescore(frame, fitted, variants(rows.select("id", *frame.features), "scenario", frame.features, made), ["id", "scenario"])
    out = scored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"))
    base = F.max(F.when(F.col("scenario") == "base", F.col("mean_score"))).over(Window.partitionBy())
    return out.withColumn("change_pct", (F.col("mean_score") - base) / F.greatest(base, F.lit(1e-10)) * 100)


def hashed_normal(key: Column, *salt: str) -> Column:
    """A standard normal number that depends only on the key and the salt, so a repeated task draws the same."""
    unit = lambda tag: (F.pmod(F.xxhash64(key, F.lit("|".join([*salt, tag]))), F.lit(2 ** 52)) + 1) / F.lit(float(2 ** 52 + 1))
    return F.sqrt(-2 * F.log(unit("r"))) * F.cos(2 * np.pi * unit("a"))


def noise_volatility(frame: ModelFrame, fitted: Fitted, rows: DataFrame, levels: list[float] | None = None,
                     seed: int = 42) -> DataFrame:
    """Coefficient of variation of the scores under normal noise of each level on every feature."""
    made = [(f"{level:g}", {f: F.col(f) + level * hashed_normal(F.col("id"), f, f"{level:g}", str(seed)) for f in frame.features})
            for level in (levels or NOISE_LEVELS)]
    scored = rescore(frame, fitted, variants(rows.select("id", *frame.features), "level", frame.features, made), ["id", "level"])
    return scored.groupBy(F.col("level").cast("double").alias("level")).agg(
        F.avg("score").alias("mean_score"),
        (F.stddev_pop("score") / (F.avg("score") + 1e-6)).alias("coefficient_of_variation"))


def partial_dependence(frame: ModelFrame, fitted: Fitted, rows: DataFrame, features: list[str] | None = None,
                       points: int = 10) -> DataFrame:
    """Mean score when one feature is set to each point of a grid from its 5th to its 95th percentile."""
    features = features or frame.features
    ends = quantile_values(rows, features, [0.05, 0.95])
    made = []
    for f in features:
        low, high = ends[f]
        for i in range(points):
            made.append((f"{f}|{i}|{low + (high - low) * i / (points - 1)!r}", {f: F.lit(low + (high - low) * i / (points - 1))}))
    scored = rescore(frame, fitted, variants(rows.select("id", *frame.features), "at", frame.features, made), ["at"])
    part = F.split("at", r"\|")
    return scored.groupBy("at").agg(F.avg("score").alias("mean_score")).select(
        part[0].alias("feature"), part[1].cast("int").alias("point"), part[2].cast("double").alias("value"), "mean_score")


def dependence_trend(curve: DataFrame) -> DataFrame:
    """Share of rising steps per feature and the resulting trend."""
    step = F.col("mean_score") - F.lag("mean_score").over(Window.partitionBy("feature").orderBy("point"))
    moved = curve.withColumn("_s", step).where(F.col("_s").isNotNull())
    out = moved.groupBy("feature").agg(F.avg((F.col("_s") > 0).cast("int")).alias("rising_share"),
                                       F.avg((F.col("_s") < 0).cast("int")).alias("falling_share"))
    return out.withColumn("trend", F.when(F.col("rising_share") > 0.5, "increasing").when(
        F.col("falling_share") > 0.5, "decreasing").otherwise("mixed"))


def permutation_importance(frame: ModelFrame, fitted: Fitted, rows: DataFrame, repeats: int = 5, seed: int = 42,
                           cell_rows: int = 100_000) -> DataFrame:
    """Mean loss of AUC when a feature is shuffled among rows; negative means become 0.

    Rows are spread over cells of bounded size by a hash and put in random order there; every row takes the features of
    the next one, the last those of the first. That is one random permutation per repeat for all features together, so
    one shuffle of the rows serves all features.
    """
    data = pin(rows.select("id", "label", *frame.features))
    size = data.count()
    cells = max(1, -(-size // cell_rows))
    turns = data.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    ticket = F.xxhash64("id", "repeat", F.lit(seed))
    placed = turns.withColumns({"_t": ticket, "_cell": F.pmod(F.xxhash64(ticket), F.lit(cells))})
    order = Window.partitionBy("repeat", "_cell").orderBy("_t", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*frame.features)
    donor = F.coalesce(F.lead(own).over(order), F.first(own).over(whole))
    given = placed.withColumn("_d", donor).drop("_t", "_cell")
    made = [(f, {f: F.col(f"_d.{f}")}) for f in frame.features]
    changed = struct_rows(given, ["id", "label", "repeat"], [
        F.struct(F.lit(name).alias("feature"), *[c.get(f, F.col(f)).alias(f) for f in frame.features]) for name, c in made])
    # Written once: several passes read the scores, and scoring is the dearest step.
    scored = pin(rescore(frame, fitted, changed, ["label", "feature", "repeat"]))
    shuffled = metrics.discrimination(scored, ["feature", "repeat"], rows=size * repeats * len(frame.features))
    base = metrics.discrimination(pin(rescore(frame, fitted, data, ["label"])), [], rows=size).select(F.col("auc").alias("base_auc"))
    drop = shuffled.groupBy("feature").agg(F.avg("auc").alias("permuted_auc"))
    return attach(drop, base).withColumn("importance", F.greatest(F.lit(0.0), F.col("base_auc") - F.col("permuted_auc")))


def feature_dropout(frame: ModelFrame, candidate: Candidate, workers: int = 4) -> DataFrame:
    """AUC on the test rows when the model is fitted again without each feature."""
    sets = [("all", frame.features)] + [(f, [g for g in frame.features if g != f]) for f in frame.features]
    fitted = models.side_by_side(
        frame.data.sparkSession, lambda s: models.fit(frame, candidate, s[1], s[0]), sets, workers)
    found = metrics.discrimination(models.score(frame, fitted, 0.0, 1.0, frame.data.where("split = 'test'")), ["model"])
    base = F.max(F.when(F.col("model") == "all", F.col("auc"))).over(Window.partitionBy())
    out = found.select("model", "auc", base.alias("base_auc")).where("model <> 'all'")
    impact = F.col("base_auc") - F.col("auc")
    return out.select(
        F.col("model").alias("feature"), "base_auc", "auc", impact.alias("impact"),
        F.when(impact > HIGH_IMPACT, "HIGH").when(impact > MEDIUM_IMPACT, "MEDIUM").otherwise("LOW").alias("sensitivity"),
        (impact / F.col("base_auc") * 100 < MAX_DROP_PCT).alias("within_limit"))


def importance_stability(frame: ModelFrame, candidate: Candidate) -> DataFrame:
    """Correlation of the importances fitted on two halves of the training rows; stable above 0.6."""
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    fitted = [models.fit(frame, candidate, name=f"half{i}", data=frame.train().where(half == i), rows=frame.train_rows // 2)
              for i in (0, 1)]
    table = models.importances(fitted, frame.data.sparkSession)
    wide = table.groupBy("feature").pivot("model", ["half0", "half1"]).agg(F.first("importance"))
    return wide.agg(F.count(F.lit(1)).alias("features"), F.corr("half0", "half1").alias("correlation")).withColumn(
        "stable", F.col("correlation") > 0.6)


def additive_contributions(df: DataFrame, importances: dict[str, float], fit_on: DataFrame | None = None) -> DataFrame:
    """(value - mean) x importance per row and feature, and their sum over the total importance."""
    names = list(importances)
    stats = moments(df if fit_on is None else fit_on, names)
    parts = {f"{f}_contribution": (F.col(f) - F.lit(stats[f]["mean"])) * importances[f] for f in names}
    total = sum((F.coalesce(c, F.lit(0.0)) for c in parts.values()), F.lit(0.0)) / (sum(importances.values()) or 1.0)
    return df.select("id", *[c.alias(n) for n, c in parts.items()], total.alias("total_contribution"))


def nearest_neighbours(points: DataFrame, features: list[str], k: int = 5, leaf_rows: int = 20_000, trees: int = 6) -> DataFrame:
    """The k nearest rows of every row among its candidates: `(id, neighbour, rank, distance)`.

    Candidates share a leaf: rows are ordered by a random projection and range-partitioned into leaves of about
    `leaf_rows` rows, once for each of `trees` projections, and compared inside each leaf by matrix products. Up to
    `leaf_rows` rows there is one leaf, and the result is exact; beyond it, more trees find more of the true neighbours.
    Nothing passes the driver, work grows with the rows, and ids cut groups of equal rows.
    """
    data = pin(points.select("id", *[F.col(f).cast("double").alias(f) for f in features]))
    stats = moments(data, features)
    leaves = max(1, -(-stats.rows // leaf_rows))
    draws = np.random.default_rng(17)
    found = None
    for _ in range(1 if leaves == 1 else trees):
        weights = draws.normal(size=len(features))
        line = sum((F.coalesce(F.col(f), F.lit(0.0)) * float(w / (stats[f]["std_pop"] or 1.0)) for f, w in zip(features, weights)), F.lit(0.0))
        dealt = data.withColumn("_line", line).repartitionByRange(leaves, "_line", "id").drop("_line")
        part = dealt.mapInPandas(_nearest_in_leaf(features, k), "id long, neighbour long, distance double")
        found = part if found is None else found.unionByName(part)
    # At most k rows per tree meet for each id.
    best = F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour"))), 1, k)
    return found.groupBy("id").agg(best.alias("_n")).select("id", F.posexplode("_n").alias("rank", "_n")).select(
        "id", F.col("_n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("_n.distance").alias("distance"))


def _nearest_in_leaf(features: list[str], k: int):
    def run(batches):
        held = list(batches)
        if not held:
            return
        leaf = pd.concat(held)
        ids, points = leaf["id"].to_numpy(), leaf[features].to_numpy()
        norms = (points * points).sum(axis=1)
        keep = min(k, len(ids))
        step = max(1, BLOCK_CELLS // len(ids))
        for start in range(0, len(ids), step):
            x, own = points[start:start + step], ids[start:start + step]
            gap = norms[start:start + step, None] + norms[None, :] - 2 * x @ points.T
            gap[own[:, None] == ids[None, :]] = np.inf
            near = np.argpartition(gap, keep - 1, axis=1)[:, :keep]
            ok = np.isfinite(np.take_along_axis(gap, near, axis=1)).ravel()
            # The chosen few are measured again by differences, so that every leaf gives a pair the same distance.
            exact = np.sqrt(((x[:, None, :] - points[near]) ** 2).sum(axis=2)).ravel()
            yield pd.DataFrame({"id": np.repeat(own, keep)[ok], "neighbour": ids[near].ravel()[ok], "distance": exact[ok]})
    return run


def smote(df: DataFrame, features: list[str], target: str, enabled: bool = False, below: float = 0.05,
          never_from: float = 0.40, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds synthetic minority rows until both classes are equal, if enabled and the minority is rare enough.

    A synthetic row lies at a random point between a minority row, its `parent_id`, and one of its k nearest minority
    rows; its id follows the largest one. Every minority row gives the same number of rows, give or take one.
    """
    base = df.select("id", F.col(target).cast("int").alias(target), *[F.col(f).cast("double").alias(f) for f in features],
                     F.lit(False).alias("synthetic"), F.lit(None).cast("long").alias("parent_id"))
    if not enabled:
        return base
    sizes = {r[target]: r["n"] for r in base.groupBy(target).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(sizes) != 2:
        return base
    rare = min(sizes, key=lambda c: sizes[c])
    total, minor = sum(sizes.values()), sizes[rare]
    if minor / total >= min(below, never_from) or minor < 2:
        return base
    missing = total - 2 * minor
    minority = pin(base.where(F.col(target) == rare).drop("synthetic", "parent_id"))
    last = base.agg(F.max("id")).first()[0]
    near = nearest_neighbours(minority, features, k).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))
    each, extra = divmod(missing, minor)
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(2 ** 52)) / F.lit(float(2 ** 52))
    # The `extra` rows of lowest rank in a random order give one more.
    ticket = minority.select("id", F.concat(F.hex(F.xxhash64("id", F.lit(seed))), F.lit("-"), F.col("id").cast("string")).alias("_t"))
    ranked = rank_values(ticket, "_t").select("id", "rank")
    copies = F.lit(each) + (F.col("rank") <= extra).cast("int")
    drawn = minority.join(ranked, "id").join(near, "id").withColumn("_copies", copies).where("_copies > 0")
    drawn = drawn.withColumn("copy", F.explode(F.expr("sequence(1, _copies)"))).withColumn(
        "neighbour", F.get("_near", F.floor(unit("id", "copy", F.lit(seed)) * F.size("_near")).cast("int"))["neighbour"])
    other = minority.select(F.col("id").alias("neighbour"), *[F.col(f).alias(f"_n_{f}") for f in features])
    share = unit("id", "copy", F.lit(seed), F.lit("share"))
    made = drawn.join(other, "neighbour").select(
        (F.lit(last) + (F.col("copy") - 1) * minor + F.col("rank")).cast("long").alias("id"), target,
        *[(F.col(f) + share * (F.col(f"_n_{f}") - F.col(f))).alias(f) for f in features],
        F.lit(True).alias("synthetic"), F.col("id").alias("parent_id"))
    return base.unionByName(made)
