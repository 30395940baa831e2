"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Only DataFrame operations: each level runs a few aggregates over a small pinned table of groups, and the driver sees
one row per tree node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.session import pin

BINS = 4096
PASSES = 2
ROWS_PER_RANK = 100_000


def _node_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """At most one row per tree node, so the broadcast is bounded by the number of leaves."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def kd_leaves(points: DataFrame, weight: str, dims: list[str], leaves: int) -> DataFrame:
    """Adds `leaf` (0 .. leaves - 1): leaves of nearly equal total weight.

    A node of n leaves is cut along the dimension whose value range inside the node is widest relative to the whole
    table, at the weighted quantile floor(n / 2) / n. The cut comes from weight histograms of `BINS` bins, refined
    `PASSES` times inside the bin that holds it. Null coordinates count as 0 and null weights as 0; rows with equal
    coordinates stay together; an empty table gives no rows.
    """
    at = F.array(*[F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dims])
    placed = pin(points.withColumns({"_at": at, "_w": F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), "_node": F.lit(0)}))
    nodes = {0: (0, leaves)}
    whole: list[float] | None = None
    fresh = 1
    while any(n > 1 for _, n in nodes.values()):
        open_nodes = [k for k, (_, n) in nodes.items() if n > 1]
        ranges = {r["_node"]: r for r in placed.groupBy("_node").agg(
            F.sum("_w").alias("w"), *[F.min(F.get("_at", F.lit(i))).alias(f"lo{i}") for i in range(len(dims))],
            *[F.max(F.get("_at", F.lit(i))).alias(f"hi{i}") for i in range(len(dims))]).collect()}
        if whole is None:
            whole = [max(ranges[0][f"hi{i}"] - ranges[0][f"lo{i}"], 1e-300) if 0 in ranges else 1.0
                     for i in range(len(dims))]
        spans = {}
        for k in open_nodes:
            if k not in ranges:
                spans[k] = (0, 0.0, 0.0, 0.0)
                continue
            r = ranges[k]
            wide = max(range(len(dims)), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i))
            spans[k] = (wide, r[f"lo{wide}"], r[f"hi{wide}"], r["w"] * (nodes[k][1] // 2) / nodes[k][1])
        for _ in range(PASSES):
            table = _node_table(placed, [(k, *v) for k, v in spans.items()], "n int, dim int, lo double, hi double, want double")
            inside = placed.join(table, placed["_node"] == table["n"]).withColumn("_v", F.get("_at", F.col("dim")))
            inside = inside.where(F.col("_v").between(F.col("lo"), F.col("hi")))
            step = (F.col("hi") - F.col("lo")) / BINS
            slot = F.when(step > 0, F.least(F.floor((F.col("_v") - F.col("lo")) / step), F.lit(BINS - 1))).otherwise(F.lit(0))
            counted = inside.withColumn("_bin", slot.cast("int")).groupBy("n", "_bin").agg(
                F.sum("_w").alias("w"), F.first("want").alias("want"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            # At most BINS rows per node.
            order = Window.partitionBy("n").orderBy("_bin")
            upto = counted.withColumns({"upto": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))})
            hit = upto.withColumn("_first", F.row_number().over(
                Window.partitionBy("n").orderBy((F.col("upto") < F.col("want")).cast("int"), "_bin")))
            for r in hit.where("_first = 1").collect():
                dim = spans[r["n"]][0]
                spans[r["n"]] = (dim, r["low"], r["high"], r["want"] - (r["upto"] - r["w"]))
        cuts, grown = [], {}
        for k, (first, n) in nodes.items():
            if n == 1:
                grown[k] = (first, n)
                continue
            dim, _, high, _ = spans[k]
            left, right = fresh, fresh + 1
            fresh += 2
            grown[left], grown[right] = (first, n // 2), (first + n // 2, n - n // 2)
            cuts.append((k, dim, float(high), left, right))
        table = _node_table(placed, cuts, "n int, dim int, cut double, lhs int, rhs int")
        placed = placed.join(table, placed["_node"] == table["n"], "left").withColumn("_node", F.when(
            F.col("n").isNull(), F.col("_node")).when(F.get("_at", F.col("dim")) <= F.col("cut"), F.col("lhs"))
            .otherwise(F.col("rhs"))).drop("n", "dim", "cut", "lhs", "rhs")
        # Written each level: the next one reads plain columns and never plans this one again.
        placed = pin(placed)
        nodes = grown
    table = _node_table(placed, [(k, first) for k, (first, _) in nodes.items()], "n int, leaf int")
    return placed.join(table, placed["_node"] == table["n"]).drop("n", "_node", "_at", "_w")


def leaf_count(total: int, target: int) -> int:
    """Leaves so that each reaches about the target bytes."""
    return max(1, math.ceil(total / max(1, target)))


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds a gapless number from 0 within each group without a task that holds a group.

    Rows of a group are dealt into hash pieces of about ROWS_PER_RANK rows; the sizes of the earlier pieces (one row
    per group and piece, broadcast) are added to the position inside the piece.
    """
    total = rows.count()
    pieces = max(64, math.ceil(total / ROWS_PER_RANK))
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    sizes = dealt.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_piece").alias("_p"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order)) - 1
    ranked = dealt.withColumn("_r", inside)
    joined = ranked.join(offsets, (ranked[group] == offsets["_g"]) & (ranked["_piece"] == offsets["_p"]))
    return joined.withColumn(name, (F.col("_off") + F.col("_r")).cast("long")).drop("_g", "_p", "_off", "_r", "_piece")


def shard_documents(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """Shards of nearly equal bytes that follow metadata; equal texts share a shard (law `bytes`).

    Size is the UTF-8 length plus 1 (null text: 1). Points of the tree are the distinct texts, with the metadata of
    their smallest doc_id: language, source and log size. A text hash breaks ties inside a language or a source, so
    no metadata value is too large to be cut. Null texts are points of their own. Extra columns are ignored; repeated
    doc_ids are kept as rows.
    """
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) / F.lit(2.0 ** 32)
    base = pin(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("_bytes"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.concat(F.lit("-"), F.xxhash64("doc_id"))).alias("_key"),
        code("lang").alias("_lang"), code("source").alias("_source"),
    ).withColumn("size", F.coalesce(F.col("_bytes"), F.lit(0)) + 1))
    tie = F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    points = pin(base.groupBy("_key").agg(
        F.sum("size").alias("_weight"), F.min_by(F.struct("_lang", "_source", "size"), "doc_id").alias("_m"),
    ).select("_key", "_weight", (F.col("_m._lang") + tie / 1024).alias("_d0"), (F.col("_m._source") + tie / 1024).alias("_d1"),
             (F.log(F.coalesce(F.col("_m.size"), F.lit(1)).cast("double")) + tie / 1024).alias("_d2")))
    if target_bytes is not None:
        shards = leaf_count(points.agg(F.sum("_weight")).first()[0] or 0, target_bytes)
    leaves = pin(kd_leaves(points, "_weight", ["_d0", "_d1", "_d2"], shards).select("_key", F.col("leaf").alias("shard")))
    placed = base.join(leaves, "_key")
    out = numbered(placed, "shard", [F.col("doc_id"), F.col("_key")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
