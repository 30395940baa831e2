"""Population stability, multivariate drift and two-sample tests.

Edges are fitted once and used as literals, so every comparison is one scan whose shuffle carries bin counts only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanstrata.functions.ordered import TASK_ROWS, long_values, quantile_values
from loanstrata.operators.features import bin_number
from loanstrata.operators.metrics import discrimination
from loanstrata.operators.profile import struct_rows
from loanstrata.functions.stats import moments
from loanstrata.session import attach, pin


@dataclass(frozen=True)
class BinRule:
    """How values are binned and how empty bins count.

    outer: `open` puts everything beyond the ends into the end bins; `closed` leaves it out;
    `counted` leaves it out of the bins but not out of the total.
    zero: `replace` puts `epsilon` for an empty share, `clip` raises every share to it, `add` adds it to every share.
    """
    outer: str = "open"
    zero: str = "replace"
    epsilon: float = 0.0001


QUANTILE_OPEN = BinRule()
QUANTILE_CLOSED = BinRule("closed", "clip", 1e-8)
CHARACTERISTIC = BinRule("counted", "replace", 0.0001)
EQUAL_WIDTH = BinRule("closed", "add", 1e-4)


def stability_status(psi: Column) -> Column:
    return F.when(psi < 0.10, "PASS").when(psi < 0.25, "WARN").when(psi.isNotNull(), "FAIL")


def quantile_edges(reference: DataFrame, features: list[str], bins: int = 10) -> dict[str, list[float]]:
    """All bins + 1 quantiles per feature, repeats kept: a repeated edge is an empty bin."""
    return quantile_values(reference, features, [i / bins for i in range(bins + 1)])


def equal_width_edges(df: DataFrame, features: list[str], bins: int = 10) -> dict[str, list[float]]:
    """bins + 1 evenly spaced edges over the joint range."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in
                   (("lo", F.min), ("hi", F.max))]).collect()[0]
    spread = lambda lo, hi: [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    return {c: spread(row[f"lo_{c}"], row[f"hi_{c}"]) for c in features if row[f"lo_{c}"] is not None}


def side_counts(df: DataFrame, side: str, sides: list[str], edges: dict[str, list[float]], rule: BinRule) -> DataFrame:
    """One row per feature and bin with a count per side; bin -1 holds what the rule leaves out of the bins."""
    rows = []
    for name, e in edges.items():
        value, inner = F.col(name).cast("double"), e[1:-1]
        place = bin_number(value, inner, right_closed=False)
        if rule.outer != "open":
            low, high = (e[0], e[-1]) if rule.outer == "closed" else (e[0] - 0.001, e[-1] + 0.001)
            place = F.when((value < low) | (value > high), -1).otherwise(place)
        rows.append(F.struct(F.lit(name).alias("feature"), place.alias("bin")))
    long = struct_rows(df.where(F.col(side).isin(*sides)), [side], rows).where(F.col("bin").isNotNull())
    return long.groupBy("feature", "bin").agg(*[
        F.count(F.when(F.col(side) == s, 1)).alias(f"n_{s}") for s in sides])


def _share(counts: str, rule: BinRule) -> Column:
    counted = F.col(counts) if rule.outer != "closed" else F.when(F.col("bin") >= 0, F.col(counts)).otherwise(0)
    share = F.try_divide(F.col(counts), F.sum(counted).over(Window.partitionBy("feature")))
    if rule.zero == "add":
        return share + rule.epsilon
    if rule.zero == "clip":
        return F.greatest(share, F.lit(rule.epsilon))
    return F.when(share == 0, rule.epsilon).otherwise(share)


def psi_bins(counts: DataFrame, reference: str, other: str, rule: BinRule = QUANTILE_OPEN) -> DataFrame:
    """Shares and contribution of every bin."""
    shares = counts.withColumns({"ref_share": _share(f"n_{reference}", rule), "cmp_share": _share(f"n_{other}", rule)})
    part = (F.col("cmp_share") - F.col("ref_share")) * F.log(F.col("cmp_share") / F.col("ref_share"))
    return shares.where(F.col("bin") >= 0).withColumn("contribution", part)


def psi(df: DataFrame, side: str, reference: str, other: str, edges: dict[str, list[float]],
        rule: BinRule = QUANTILE_OPEN) -> DataFrame:
    """Population stability index per feature between two values of a column."""
    counts = side_counts(df, side, list(dict.fromkeys([reference, other])), edges, rule)
    return psi_bins(counts, reference, other, rule).groupBy("feature").agg(
        F.sum("contribution").alias("psi")).withColumn("status", stability_status(F.col("psi")))


def vintage_psi(df: DataFrame, features: list[str], bins: int = 10, min_reference: int = 100,
                min_other: int = 50) -> DataFrame:
    """PSI of train against validation and test for all features, from one scan after the edges are known."""
    edges = quantile_edges(df.where(F.col("split") == "train"), features, bins)
    counts = side_counts(df, "split", ["train", "val", "test"], edges, QUANTILE_OPEN)
    both = counts.select("*", *[_share(f"n_{s}", QUANTILE_OPEN).alias(f"s_{s}") for s in ("train", "val", "test")])
    part = lambda s: F.sum((F.col(f"s_{s}") - F.col("s_train")) * F.log(F.col(f"s_{s}") / F.col("s_train")))
    out = both.groupBy("feature").agg(
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("train", "val", "test")], part("val").alias("v"), part("test").alias("t"))
    out = out.where(F.col("n_train") >= min_reference)
    value = lambda c, n: F.when(F.col(n) >= min_other, F.col(c))
    return out.select(
        "feature", value("v", "n_val").alias("psi_train_val"), value("t", "n_test").alias("psi_train_test")).withColumns({
            "status_train_val": F.coalesce(stability_status(F.col("psi_train_val")), F.lit("N/A")),
            "status_train_test": F.coalesce(stability_status(F.col("psi_train_test")), F.lit("N/A"))})


def csi_mean(csi: DataFrame) -> DataFrame:
    return csi.agg(F.count(F.lit(1)).alias("features"), F.avg("psi").alias("mean_csi"), F.max("psi").alias("max_csi"))


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in features)))


def mean_embedding_drift(df: DataFrame, features: list[str], side: str = "split", reference: str = "train",
                         other: str = "test") -> DataFrame:
    """Length of the difference of mean vectors, in reference deviations: one aggregate over complete rows."""
    known = complete_rows(df.where(F.col(side).isin(reference, other)), features)
    at = lambda c, s: F.when(F.col(side) == s, F.col(c).cast("double"))
    one = known.agg(
        F.count(F.when(F.col(side) == reference, 1)).alias("n_reference"),
        F.count(F.when(F.col(side) == other, 1)).alias("n_other"),
        *[a.alias(f"{n}_{c}") for c in features for n, a in (
            ("m", F.avg(at(c, reference))), ("o", F.avg(at(c, other))), ("s", F.stddev_pop(at(c, reference))))])
    total = F.lit(0.0)
    for c in features:
        z = (F.col(f"m_{c}") - F.col(f"o_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))
        total = total + z * z
    return one.select("n_reference", "n_other", F.sqrt(total).alias("drift_score"))


# Tickets are residues modulo this prime; a histogram level resolves 12 of their 31 bits.
TICKET_PRIME = (1 << 31) - 1
TICKET_SHIFTS = (19, 7, 0)
# Rows whose tickets a task mixes at once.
TICKET_ROWS = 16_384
# Rows of a draw that one task may sort.
BOUNDARY_ROWS = 2_000


def key_hashes(key: Column, seed: int) -> dict[str, Column]:
    """The two halves of a key's hash that all draws mix."""
    part = lambda at: F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), at, 7), 16, 10).cast("long")
    return {"_x": part(1), "_y": part(8)}


def multipliers(draws: int, seed: int) -> list[tuple[int, int, int]]:
    """The numbers that make a ticket of the two halves, per draw 1..draws."""
    number = lambda name, draw: int(hashlib.md5(f"{name}-{draw}-{seed}".encode()).hexdigest()[:7], 16) + 1
    return [tuple(number(n, d) for n in "abc") for d in range(1, draws + 1)]


def tickets(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Every row once per draw 1..draws, exploded in place, with a `ticket` that is a hash of key and draw.

    The key is hashed once; a draw mixes the two halves of that hash with multipliers of its own.
    """
    mixes = F.array(*[F.struct(F.lit(d).alias("draw"), *[F.lit(v).cast("long").alias(n) for n, v in zip("abc", m)])
                      for d, m in enumerate(multipliers(draws, seed), 1)])
    mixed = df.withColumns({**key_hashes(F.col(key), seed), "_mix": F.explode(mixes)})
    p = F.lit(TICKET_PRIME)
    ticket = (F.col("_x") * F.col("_mix.a") % p + F.col("_y") * F.col("_mix.b") % p + F.col("_mix.c")) % p
    return mixed.withColumns({"draw": F.col("_mix.draw"), "ticket": ticket}).drop("_x", "_y", "_mix")


def _drawn(batches: Iterator[pa.RecordBatch], mixes: list[tuple[int, int, int]]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The tickets of a few thousand rows in one draw after the other, as `tickets` makes them."""
    for batch in batches:
        for start in range(0, batch.num_rows, TICKET_ROWS):
            part = batch.slice(start, TICKET_ROWS)
            x, y = (part.column(n).to_numpy() for n in ("_x", "_y"))
            for draw, (a, b, c) in enumerate(mixes):
                yield part, draw, (x * a % TICKET_PRIME + y * b % TICKET_PRIME + c) % TICKET_PRIME


def row_cuts(rows: DataFrame, draws: int, seed: int, size: int) -> dict[int, tuple]:
    """What `ticket_cuts` finds, from rows `(_key, _x, _y)` that are not exploded.

    A task mixes the tickets of its rows in blocks and sends on a count per draw and range, and at the end the few rows in
    the range that holds the cut.
    """
    mixes = multipliers(draws, seed)
    found, left = np.full(draws, -1), np.full(draws, size)
    above = None
    for shift in TICKET_SHIFTS:
        inside = None if above is None else (above, found.copy())
        low = np.zeros(draws, np.int64) if inside is None else found << (above - shift)
        width = (TICKET_PRIME >> shift) + 1 if inside is None else 1 << (above - shift)

        def counted(batches: Iterator[pa.RecordBatch], shift=shift, inside=inside, low=low, width=width) -> Iterator[pa.RecordBatch]:
            total = np.zeros((draws, width), np.int64)
            for _, draw, ticket in _drawn(batches, mixes):
                if inside is not None:
                    ticket = ticket[ticket >> inside[0] == inside[1][draw]]
                total[draw] += np.bincount((ticket >> shift) - low[draw], minlength=width)
            draw, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(at), pa.array(total[draw, at])], ["draw", "at", "n"])

        counts = rows.mapInArrow(counted, "draw long, at long, n long").groupBy("draw", "at").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("draw").orderBy("at")) - F.col("n")
        need = F.get(F.lit(left.tolist()), F.col("draw").cast("int"))
        spots = counts.withColumns({"before": before, "need": need}).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need"))).collect()
        most = max((r["n"] for r in spots), default=0)
        held = {r["draw"]: r for r in spots}
        found = np.array([low[d] + held[d]["at"] if d in held else -1 for d in range(draws)])
        left = np.array([left[d] - held[d]["before"] if d in held else 0 for d in range(draws)])
        above = shift
        if most <= BOUNDARY_ROWS:
            break

    def at_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, draw, ticket in _drawn(batches, mixes):
            spot = np.flatnonzero(ticket >> above == found[draw])
            if len(spot):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spot), draw + 1, np.int32)), pa.array(ticket[spot]),
                                                  part.column("_key").take(pa.array(spot))], ["draw", "ticket", "_key"])

    kept = T.StructType([T.StructField("draw", T.IntegerType()), T.StructField("ticket", T.LongType()), rows.schema["_key"]])
    place = F.row_number().over(Window.partitionBy("draw").orderBy("ticket", "_key"))
    need = F.get(F.lit(left.tolist()), F.col("draw") - 1)
    ends = rows.mapInArrow(at_cut, kept).withColumn("_place", place).where(F.col("_place") == need).collect()
    return {r["draw"]: (r["ticket"], r["_key"]) for r in ends}


def reference_sums(rows: DataFrame, values: list[str], draws: int, seed: int, cuts: dict[int, tuple]) -> DataFrame:
    """`(draw, n, sums)`: rows up to the cut of every draw and the sums of their values, one part per task.

    Rows that share a cut's ticket are parts of their own, so that Spark compares their keys with that of the cut.
    """
    mixes = multipliers(draws, seed)
    cut = [cuts[d][0] if d in cuts else -1 for d in range(1, draws + 1)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(draws, np.int64), np.zeros((draws, len(values)))
        kind, held, z = None, None, None
        for part, draw, ticket in _drawn(batches, mixes):
            if part is not held:
                held, kind = part, part.column("_key").type
                z = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in values])
            under = ticket < cut[draw]
            n[draw] += np.count_nonzero(under)
            total[draw] += under @ z
            tied = np.flatnonzero(ticket == cut[draw])
            if len(tied):
                yield _parts([draw + 1] * len(tied), part.column("_key").take(pa.array(tied)), [1] * len(tied), z[tied])
        if held is not None:
            yield _parts(range(1, draws + 1), pa.nulls(draws, kind), n, total)

    schema = T.StructType([T.StructField("draw", T.IntegerType()), rows.schema["_key"], T.StructField("n", T.LongType()),
                           T.StructField("sums", T.ArrayType(T.DoubleType()))])
    at = F.get(F.array(*[F.lit(cuts[d][1] if d in cuts else None).cast(rows.schema["_key"].dataType) for d in range(1, draws + 1)]), F.col("draw") - 1)
    return rows.mapInArrow(summed, schema).where((F.col("n") > 0) & (F.col("_key").isNull() | (F.col("_key") <= at))).drop("_key")


def _parts(draw, key: pa.Array, n, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(draw, pa.int32()), key, pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))],
                                      ["draw", "_key", "n", "sums"])


def ticket_cuts(ticketed: DataFrame, key: str, draws: int, size: int) -> dict[int, tuple]:
    """The `size`-th smallest (ticket, key) of every draw, without sorting the rows.

    Each pass counts tickets per draw in 4,096 ranges inside the range that holds the cut; what remains after the last
    pass that was needed is sorted. Only one row per draw reaches the driver.
    """
    inside, left = ticketed, {d: size for d in range(1, draws + 1)}
    for shift in TICKET_SHIFTS:
        counts = inside.groupBy("draw", F.shiftright("ticket", shift).alias("range")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("draw").orderBy("range")) - F.col("n")
        need = F.get(F.lit([left.get(d, 0) for d in range(1, draws + 1)]), F.col("draw") - 1)
        spots = counts.withColumns({"before": before, "need": need}).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        held = {r["draw"]: r for r in spots.collect()}
        left = {d: left[d] - r["before"] for d, r in held.items()}
        ranges = F.get(F.lit([held[d]["range"] if d in held else -1 for d in range(1, draws + 1)]), F.col("draw") - 1)
        inside = inside.where(F.shiftright("ticket", shift) == ranges)
        if not held or max(r["n"] for r in held.values()) <= BOUNDARY_ROWS:
            break
    place = F.row_number().over(Window.partitionBy("draw").orderBy("ticket", key))
    need = F.get(F.lit([left.get(d, 0) for d in range(1, draws + 1)]), F.col("draw") - 1)
    rows = inside.select("draw", "ticket", key).withColumn("_place", place).where(F.col("_place") == need).collect()
    return {r["draw"]: (r["ticket"], r[key]) for r in rows}


def permutation_draws(df: DataFrame, features: list[str], key: str = "id", side: str = "split", reference: str = "train",
                      other: str = "test", permutations: int = 100, seed: int = 42) -> DataFrame:
    """`(draw, n_reference, n_other, stat)`: distance of mean standardised features; draw 0 has the real sides.

    In a draw the rows with the smallest tickets play the reference, exactly as many as there really are. `key` names a
    unique column. Rows with a null feature or on neither side are left out.
    """
    known = complete_rows(df.where(F.col(side).isin(reference, other)), features)
    fitted = moments(known.where(F.col(side) == reference), features)
    z = {c: (F.col(c).cast("double") - F.lit(fitted[c]["mean"])) / F.lit(fitted[c]["std_pop"] or 1.0) for c in features}
    rows = pin(known.select(F.col(key).alias("_key"), (F.col(side) == reference).alias("_ref"), *[v.alias(f"_z_{c}") for c, v in z.items()],
                            *[h.alias(n) for n, h in key_hashes(F.col(key), seed).items()]))
    facts = rows.agg(F.count_if("_ref").alias("a"), F.count_if(~F.col("_ref")).alias("b"), F.count_if(F.col("_x").isNull()).alias("bare"), *[F.sum(f"_z_{c}").alias(c) for c in features]).collect()[0]
    # Rows without a key have no ticket; they come first in every draw and count for no side.
    keyed = rows.where(F.col("_x").isNotNull())
    cuts = row_cuts(keyed.select("_key", "_x", "_y"), permutations, seed, facts["a"] - facts["bare"])
    sums = [F.count(F.lit(1)).alias("n_reference"), *[F.sum(f"_z_{c}").alias(f"_a_{c}") for c in features]]
    real = rows.where("_ref").agg(*sums).select(F.lit(0).alias("draw"), "*")
    chosen = reference_sums(keyed, [f"_z_{c}" for c in features], permutations, seed, cuts)
    per = chosen.groupBy("draw").agg(F.sum("n").alias("n_reference"), *[F.sum(F.get("sums", F.lit(i))).alias(f"_a_{c}") for i, c in enumerate(features)])
    per = real.unionByName(per).withColumn("n_other", F.lit(facts["a"] + facts["b"]) - F.col("n_reference"))
    total = F.lit(0.0)
    for c in features:
        rest = F.lit(facts[c]) - F.col(f"_a_{c}")
        d = F.try_divide(F.col(f"_a_{c}"), F.col("n_reference")) - F.try_divide(rest, F.col("n_other"))
        total = total + d * d
    return per.select("draw", "n_reference", "n_other", F.sqrt(total).alias("stat"))


def permutation_drift(df: DataFrame, features: list[str], key: str = "id", side: str = "split", reference: str = "train",
                      other: str = "test", permutations: int = 100, seed: int = 42) -> DataFrame:
    """p-value of the drift score under random relabelling of rows that keeps the group sizes."""
    stats = permutation_draws(df, features, key, side, reference, other, permutations, seed)
    out = attach(stats.where("draw > 0"), stats.where("draw = 0").select(F.col("stat").alias("_real"))).agg(
        F.max("_real").alias("drift_score"), F.avg((F.col("stat") >= F.col("_real")).cast("int")).alias("p_value"))
    return out.withColumn("interpretation", F.when(
        F.col("p_value") < 0.05, "significant drift").otherwise("no significant drift"))


def ks_by_feature(df: DataFrame, features: list[str], side: str = "split", reference: str = "train",
                  other: str = "test", task_rows: int = TASK_ROWS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature; a shift is p below 0.05."""
    marked = df.where(F.col(side).isin(reference, other)).withColumn(
        "_label", F.when(F.col(side) == other, 1).otherwise(0))
    rows = long_values(marked, features, ["_label"]).select(
        "feature", F.col("_label").alias("label"), F.col("value").alias("score"))
    found = discrimination(rows, ["feature"], task_rows)
    return found.select("feature", F.col("n_neg").alias("n_reference"), F.col("n_pos").alias("n_other"), "ks",
                        F.col("ks_pvalue").alias("p_value"), (F.col("ks_pvalue") < 0.05).alias("shifted"))
