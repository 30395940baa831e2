"""Ratio features, weight of evidence, correlation, variance inflation and feature selection.

Work per row is one pass for all features at once; what reaches the driver is a table of bins or a matrix whose
size depends on the number of columns only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.functions.ordered import quantile_values
from loanstrata.functions.text import finite
from loanstrata.operators.profile import struct_rows
from loanstrata.functions.stats import moments
from loanstrata.session import pin

# Information-value bands and the share that stands in for an empty class.
IV_BANDS = [(0.02, "not useful"), (0.10, "weak"), (0.30, "medium"), (0.50, "strong")]
EMPTY_SHARE = 0.0001
INFINITE_VIF = 999999.99


def split_report(df: DataFrame) -> DataFrame:
    """Size, share, defaults and years of each split."""
    sizes = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("default_flag").alias("defaults"),
        F.avg(F.col("default_flag").cast("double")).alias("default_rate"),
        F.min("issue_year").alias("first_year"), F.max("issue_year").alias("last_year"))
    return sizes.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


RATIOS = {
    "loan_to_income": (["loan_amnt", "annual_inc"], "try_divide(loan_amnt, annual_inc)"),
    "installment_to_income": (["installment", "annual_inc"], "try_divide(installment, annual_inc / 12)"),
    "revol_to_total": (["revol_bal", "tot_cur_bal"], "try_divide(revol_bal, tot_cur_bal + 1)"),
    "credit_utilization": (["revol_bal", "total_rev_hi_lim"], "try_divide(revol_bal, total_rev_hi_lim + 1)"),
    "open_acc_ratio": (["open_acc", "total_acc"], "try_divide(open_acc, total_acc + 1)"),
}


def ratio_features(df: DataFrame) -> DataFrame:
    """Adds the ratios whose inputs exist; a ratio that cannot be computed is 0."""
    present = {n: e for n, (need, e) in RATIOS.items() if set(need) <= set(df.columns)}
    return df.withColumns({n: F.coalesce(finite(F.expr(e)), F.lit(0.0)) for n, e in present.items()})


def skipped_ratios(df: DataFrame) -> DataFrame:
    """The ratios that could not be built and the columns they lack."""
    rows = [(n, ", ".join(c for c in need if c not in df.columns)) for n, (need, _) in RATIOS.items()
            if not set(need) <= set(df.columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, missing_columns string")


def bin_number(value: Column, cuts: list[float], right_closed: bool = True) -> Column:
    """0-based bin of a value: the number of cut points below it (or at or below it)."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    below = F.filter(edges, (lambda c: value > c) if right_closed else (lambda c: value >= c))
    return F.when(value.isNotNull(), F.size(below))


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 10, drop_ends: bool = True) -> dict[str, list[float]]:
    """Inner quantile cut points per feature, equal ones once; a cut at an end of the range makes no bin."""
    probs = [i / bins for i in range(bins + 1)]
    found = {}
    for name, q in quantile_values(df, features, probs).items():
        inner = sorted(set(q[1:-1]))
        found[name] = [c for c in inner if q[0] <= c < q[-1] and (c > q[0] or not drop_ends)]
    return found


def binned_events(df: DataFrame, label: str, cuts: dict[str, list[float]], right_closed: bool = True) -> DataFrame:
    """`(feature, bin, n, events)` for all features from one scan; only bin counts are shuffled."""
    known = df.where(F.col(label).isNotNull())
    rows = struct_rows(known, [label], [
        F.struct(F.lit(name).alias("feature"), bin_number(F.col(name).cast("double"), c, right_closed).alias("bin"))
        for name, c in cuts.items()
    ]).where(F.col("bin").isNotNull())
    return rows.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("events"))


def woe_rows(counts: DataFrame) -> DataFrame:
    """Weight of evidence and information value per bin: ln(share of non-events / share of events)."""
    whole = Window.partitionBy("feature")
    event = F.try_divide(F.col("events"), F.sum("events").over(whole))
    rest = F.try_divide(F.col("n") - F.col("events"), F.sum(F.col("n") - F.col("events")).over(whole))
    floor = lambda c: F.when(c > 0, c).otherwise(EMPTY_SHARE)
    woe = F.log(floor(rest) / floor(event))
    return counts.select(
        "feature", "bin", "n", (F.col("n") / F.sum("n").over(whole)).alias("count_pct"),
        (F.col("events") / F.col("n")).alias("event_rate"), woe.alias("woe"),
        ((floor(rest) - floor(event)) * woe).alias("iv"))


def iv_band(iv: Column) -> Column:
    out = F.when(iv < IV_BANDS[0][0], IV_BANDS[0][1])
    for limit, name in IV_BANDS[1:]:
        out = out.when(iv < limit, name)
    return out.otherwise("suspicious")


def information_values(counts: DataFrame, min_rows: int = 100) -> DataFrame:
    """Information value and band per feature; a feature with fewer than `min_rows` values gets 0."""
    total = woe_rows(counts).groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins"),
                                                   F.sum("iv").alias("_iv"))
    iv = F.when(F.col("n") < min_rows, 0.0).otherwise(F.col("_iv"))
    return total.select("feature", "n", "bins", iv.alias("iv"), iv_band(iv).alias("band"))


def monotone_cuts(df: DataFrame, features: list[str], label: str, prebins: int = 20,
                  min_share: float = 0.05) -> dict[str, list[float]]:
    """Cut points whose event rate rises or falls throughout, found by merging quantile bins.

    One job counts the fine bins of all features. The merging then runs on at most `prebins` counts per feature:
    small bins first join a neighbour, then neighbours that break the trend are pooled.
    """
    cuts, table = _fine_bins(df, features, label, prebins)
    return {name: _merge_bins(rows, cuts[name], min_share) for name, rows in table.items()}


def _fine_bins(df: DataFrame, features: list[str], label: str, prebins: int) -> tuple[dict, dict]:
    cuts = quantile_cuts(df, features, prebins)
    table: dict[str, list[tuple[int, int, int]]] = {name: [] for name in cuts}
    for r in binned_events(df, label, cuts).orderBy("feature", "bin").collect():
        table[r["feature"]].append((r["bin"], r["n"], r["events"]))
    return cuts, table


def optimal_cuts(df: DataFrame, features: list[str], label: str, prebins: int = 50,
                 min_share: float = 0.05) -> dict[str, list[float]]:
    """Cut points with the greatest information value among those whose event rate strictly rises or falls.

    Every bin holds at least `min_share` of the values, events and non-events. Spark counts the fine quantile bins of all
    features in one job; `best_bins` then runs on at most `prebins` counts a feature. A feature for which no two bins meet
    the terms gets no cut.
    """
    cuts, table = _fine_bins(df, features, label, prebins)
    return {name: [cuts[name][rows[last][0]] for last in best_bins([r[1:] for r in rows], min_share)[:-1]] for name, rows in table.items()}


def best_bins(counts: list[tuple[int, int]], min_share: float) -> list[int]:
    """Last fine bin of every bin of the best monotone grouping of (rows, events), by dynamic programming.

    A state is the fine bins i..j of the last bin; it extends the best state that ends at i - 1 with a lower (or higher)
    rate. Among equal values the grouping with fewer bins wins.
    """
    m = len(counts)
    rows = [0, *np.cumsum([n for n, _ in counts]).tolist()]
    events = [0, *np.cumsum([e for _, e in counts]).tolist()]
    total, bad = rows[-1], events[-1]
    if not 0 < bad < total:
        return [m - 1] if m else []
    value, rate = {}, {}
    for i in range(m):
        for j in range(i, m):
            n, e = rows[j + 1] - rows[i], events[j + 1] - events[i]
            if n >= min_share * total and 0 < e < n:
                rest, event = (n - e) / (total - bad), e / bad
                value[i, j], rate[i, j] = (rest - event) * math.log(rest / event), (e, n)
    found = [(0.0, -1, [m - 1])]
    for sign in (1, -1):
        best: dict[tuple[int, int], tuple[float, int, list[int]]] = {}
        for (i, j), own in sorted(value.items(), key=lambda s: s[0][1]):
            if i == 0:
                best[i, j] = (own, -1, [j])
                continue
            e, n = rate[i, j]
            before = [best[k, i - 1] for k in range(i) if (k, i - 1) in best
                      and sign * rate[k, i - 1][0] * n < sign * e * rate[k, i - 1][1]]
            if before:
                held = max(before, key=lambda b: b[:2])
                best[i, j] = (held[0] + own, held[1] - 1, [*held[2], j])
        found += [b for (_, j), b in best.items() if j == m - 1]
    return max(found, key=lambda b: b[:2])[2]


def _merge_bins(rows: list[tuple[int, int, int]], cuts: list[float], min_share: float) -> list[float]:
    if not rows:
        return []
    total = sum(n for _, n, _ in rows)
    # Each block: number of its last fine bin, rows, events.
    blocks = [[b, n, e] for b, n, e in rows]
    i = 0
    while len(blocks) > 1 and i < len(blocks):
        if blocks[i][1] >= min_share * total and 0 < blocks[i][2] < blocks[i][1]:
            i += 1
            continue
        j = i + 1 if i + 1 < len(blocks) else i - 1
        first, second = sorted((i, j))
        blocks[first:second + 1] = [[blocks[second][0], blocks[first][1] + blocks[second][1],
                                     blocks[first][2] + blocks[second][2]]]
        i = max(first - 1, 0)
    mid = (len(rows) - 1) / 2
    slope = sum((k - mid) * (e / n) for k, (_, n, e) in enumerate(rows))
    sign = 1 if slope >= 0 else -1
    pooled: list[list[int]] = []
    for block in blocks:
        pooled.append(list(block))
        while len(pooled) > 1 and sign * pooled[-2][2] * pooled[-1][1] >= sign * pooled[-1][2] * pooled[-2][1]:
            last = pooled.pop()
            pooled[-1] = [last[0], pooled[-1][1] + last[1], pooled[-1][2] + last[2]]
    return [cuts[b[0]] for b in pooled[:-1]]


def woe_transform(df: DataFrame, label: str, cuts: dict[str, list[float]]) -> DataFrame:
    """Adds `<feature>_woe`: the weight of evidence of the bin each value falls in, as literals."""
    table: dict[str, dict[int, float]] = {name: {} for name in cuts}
    for r in woe_rows(binned_events(df, label, cuts)).collect():
        table[r["feature"]][r["bin"]] = r["woe"]
    added = {}
    for name, c in cuts.items():
        weights = F.array(*[F.lit(float(table[name].get(i, 0.0))) for i in range(len(c) + 1)])
        added[f"{name}_woe"] = F.get(weights, bin_number(F.col(name).cast("double"), c))
    return df.withColumns(added)


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows that hold both; null where it is undefined.

    One pass for any number of columns and any nulls: each task adds up the products of all pairs and of their
    indicators of finite values, and the matrices of the tasks are summed in Spark. NaN and infinite values count as
    missing; a pair with a constant column, or with fewer than two common rows, has no correlation.
    """
    k = len(columns)
    values = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    stats = moments(values, columns)
    centre = np.array([stats[c]["mean"] or 0.0 for c in columns])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            held = ~np.isnan(x)
            x = np.where(held, x - centre, 0.0)
            m = held.astype(float)
            n, sx, sxx, sxy = n + m.T @ m, sx + x.T @ m, sxx + (x * x).T @ m, sxy + x.T @ x
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
            i, j, n[i, j], sx[i, j], sx.T[i, j], sxx[i, j], sxx.T[i, j], sxy[i, j])], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = values.mapInArrow(products, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double").groupBy(
        "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n), F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    # Rounding leaves a trace of variance in a constant column.
    varied = (n >= 2) & (vx > F.col("sxx") * 1e-14) & (vy > F.col("syy") * 1e-14) & (vx > 0) & (vy > 0)
    r = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n), F.sqrt(vx) * F.sqrt(vy))
    constant = [i for i, c in enumerate(columns) if stats[c]["min"] == stats[c]["max"]]
    usable = varied & ~F.col("i").isin(constant) & ~F.col("j").isin(constant)
    name = lambda c: F.get(F.array(*[F.lit(x) for x in columns]), F.col(c).cast("int"))
    return sums.select(name("i").alias("feature_1"), name("j").alias("feature_2"), F.when(usable, r).alias("r"))


def flagged_pairs(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    return pairs.where((F.abs("r") > threshold) & ~F.isnan("r")).orderBy(F.desc(F.abs("r")), "feature_1", "feature_2")


def correlation_summary(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Mean, median and largest absolute correlation, and the share of strong pairs (one row per pair of columns)."""
    r = F.abs("r")
    return pairs.where(F.col("r").isNotNull()).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(r).alias("mean_abs_r"), F.percentile(r, 0.5).alias("median_abs_r"),
        F.max(r).alias("max_abs_r"), (F.avg((r > 0.5).cast("int")) * 100).alias("pct_above_half"),
        (F.avg((r > threshold).cast("int")) * 100).alias("pct_above_threshold"))


@dataclass
class Gram:
    """Products of all column pairs over the complete rows, per row."""
    columns: list[str]
    matrix: np.ndarray
    means: np.ndarray

    def vif(self, columns: list[str], centered: bool = False) -> dict[str, float]:
        """Variance inflation of each column given the others, from the inverse of the sub-matrix."""
        at = [self.columns.index(c) for c in columns]
        sub = self.matrix[np.ix_(at, at)]
        if centered:
            sub = sub - np.outer(self.means[at], self.means[at])
        size = np.sqrt(np.diag(sub))
        scaled = sub / np.outer(size, size)
        try:
            values = np.diag(np.linalg.inv(scaled))
        except np.linalg.LinAlgError:
            values = np.full(len(columns), np.inf)
        return {c: float(v) if np.isfinite(v) and 0 < v < INFINITE_VIF else INFINITE_VIF
                for c, v in zip(columns, values)}


def gram(df: DataFrame, columns: list[str], missing: str = "complete") -> Gram:
    """One distributed covariance pass over the complete rows; with `missing="median"` gaps get their column's median first.

    Constant columns are left out. Fewer than two columns, or fewer than two complete rows, give none.
    """
    values = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    if missing == "median":
        middle = quantile_values(values, columns, [0.5])
        values = values.select(*[F.coalesce(F.col(c), F.lit(middle[c][0]) if c in middle else F.lit(None)).alias(c) for c in columns])
    varies = lambda stats, c: bool(stats[c]["std_pop"]) and stats[c]["min"] != stats[c]["max"]
    none = Gram([], np.zeros((0, 0)), np.zeros(0))
    stats = moments(values, columns)
    held = [c for c in columns if varies(stats, c)]
    if len(held) < 2:
        return none
    complete = values.select(*held).na.drop()
    stats = moments(complete, held)
    held = [c for c in held if varies(stats, c)]
    if stats.rows < 2 or len(held) < 2:
        return none
    vectors = VectorAssembler(inputCols=held, outputCol="v").transform(complete).select("v")
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    means, spread = (np.array([stats[c][m] for c in held]) for m in ("mean", "std_pop"))
    return Gram(held, matrix * np.outer(spread, spread) + np.outer(means, means), means)


def variance_inflation(df: DataFrame, columns: list[str], limit: float = 10.0, centered: bool = False,
                       missing: str = "complete") -> DataFrame:
    """VIF per column, without intercept unless `centered`; flagged above the limit.

    Columns that do not vary have no row; where no two rows are complete, every column that varies has a null VIF.
    """
    g = gram(df, columns, missing)
    rows = [(c, v, v > limit) for c, v in g.vif(g.columns, centered).items()] if g.columns else []
    if not rows:
        stats = moments(df.select(*[finite(F.col(c)).alias(c) for c in columns]), columns)
        varied = [c for c in columns if stats[c]["std_pop"]]
        rows = [(c, None, None) for c in varied] if len(varied) > 1 else []
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, flagged boolean")


@dataclass
class Selection:
    selected: list[str]
    log: DataFrame
    values: DataFrame


def select_features(df: DataFrame, features: list[str], label: str, threshold: float = 0.02,
                    max_r: float = 0.85, max_vif: float = 10.0, rounds: int = 20, method: str = "combined") -> Selection:
    """Information value, then correlation, then variance inflation.

    The columns are written once; then come bin counts, pair correlations and one covariance matrix. The rounds of the
    last stage work on sub-matrices of it and start no job.
    """
    spark = df.sparkSession
    df = pin(feature_matrix(df, features, [label]))
    cuts = optimal_cuts(df, features, label)
    values = information_values(binned_events(df, label, cuts))
    iv = {r["feature"]: r["iv"] for r in values.collect()}
    log = [(f, "iv_filter", f"IV={iv.get(f, 0.0):.6f} < threshold={threshold}")
           for f in features if iv.get(f, 0.0) < threshold]
    selected = [f for f in features if iv.get(f, 0.0) >= threshold]
    if method != "iv" and len(selected) > 1:
        dropped: set[str] = set()
        strong = {(r["feature_1"], r["feature_2"]): abs(r["r"])
                  for r in flagged_pairs(correlation_pairs(df, selected), max_r).collect()}
        for a, b in sorted(strong, key=lambda p: (selected.index(p[0]), selected.index(p[1]))):
            lose, keep = (b, a) if iv[a] >= iv[b] else (a, b)
            if lose not in dropped:
                dropped.add(lose)
                log.append((lose, "correlation_filter", f"|r|={strong[a, b]:.4f} with {keep}, which has the higher IV"))
        selected = [f for f in selected if f not in dropped]
    if method != "iv" and len(selected) > 1:
        g = gram(df, selected)
        for turn in range(rounds):
            live = [f for f in selected if f in g.columns]
            if len(live) < 2:
                break
            factors = g.vif(live)
            worst = max(live, key=lambda f: factors[f])
            if factors[worst] <= max_vif:
                break
            selected.remove(worst)
            log.append((worst, "vif_filter", f"VIF={factors[worst]:.2f} > {max_vif:g} (round {turn + 1})"))
    rows = spark.createDataFrame(log, "feature string, stage string, reason string")
    return Selection(selected, rows, values)


def feature_matrix(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or ["id"]), *[F.col(c).cast("double").alias(c) for c in features])


def z_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 by the fitted rows; a constant column is only centred."""
    stats = moments(df if fit_on is None else fit_on, columns)
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std_pop"] or 1.0) for c in columns})
