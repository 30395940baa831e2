"""Drift of a stream of scores: tumbling windows compared with a frozen baseline, and rates per window.

The stream keeps a few counters per window and bin, whatever the number of rows; the baseline's edges are literals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanstrata.operators.drift import QUANTILE_OPEN, quantile_edges, side_counts, stability_status
from loanstrata.operators.features import bin_number
from loanstrata.session import shared_folder

Baseline = dict[int, float]


def frozen_baseline(reference: DataFrame, value: str, bins: int = 10) -> tuple[list[float], Baseline]:
    """Quantile edges of a reference table and the share of each bin, an empty one as epsilon; no edges without values."""
    edges = quantile_edges(reference, [value], bins).get(value) or []
    if not edges or any(e is None for e in edges):
        return [], {}
    counts = {r["bin"]: r["n_all"] for r in side_counts(reference.select(value).withColumn("_side", F.lit("all")), "_side", ["all"],
                                                        {value: edges}, QUANTILE_OPEN).collect()}
    counts = {b: n for b, n in counts.items() if b is not None}
    total = sum(counts.values())
    return edges, {b: n / total for b, n in counts.items()}


def counts_by_window(stream: DataFrame, time: str, keys: dict[str, Column], sums: dict[str, Column], window: str = "1 day",
                     watermark: str = "1 hour") -> DataFrame:
    """Running sums per tumbling window and key of a streamed frame; rows later than the watermark are dropped.

    Rows without a time are dropped as well: no window holds them. Windows of a day begin at midnight UTC; a time without
    zone is read in the session's.
    """
    timed = stream.where(F.col(time).isNotNull()).withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", watermark)
    named = [expression.alias(name) for name, expression in keys.items()]
    grouped = timed.groupBy(F.window("_time", window).alias("_window"), *named)
    return grouped.agg(*[expression.alias(name) for name, expression in sums.items()]).withColumn(
        "window_start", F.col("_window.start")).drop("_window")


def drain(running: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all files that are there and returns the last state of every group.

    Each batch writes the groups it changed into a folder of its own, which a repeated batch replaces, so a restart from
    the same checkpoint loses and doubles nothing. Windows that are still open are in the result with what they have.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    running.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).foreachBatch(keep).start().awaitTermination()
    spark, schema = running.sparkSession, running.schema
    if not any_batch(spark, f"{folder}/counts"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/counts")


def any_batch(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def latest(states: DataFrame, keys: list[str]) -> DataFrame:
    """The state that the last batch gave each group."""
    if "batch" not in states.columns:
        return states
    values = [c for c in states.columns if c not in [*keys, "batch"]]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_last")).select(*keys, "_last.*")


def run_stream(running: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """One row per window and key; `folder` keeps the checkpoint, so a later run goes on with the files that came since."""
    folder = folder or f"{shared_folder(running.sparkSession)}/stream-{uuid.uuid4().hex}"
    return latest(drain(running, folder), keys)


def window_psi(stream: DataFrame, time: str, value: str, edges: list[float], shares: Baseline, window: str = "1 day",
               watermark: str = "1 hour", epsilon: float = QUANTILE_OPEN.epsilon, folder: str | None = None) -> DataFrame:
    """window_start, n, psi and status of every tumbling window against the frozen shares.

    Values beyond the ends go to the end bins, empty bins count as `epsilon`, null values are left out; a window without
    values has no row.
    """
    bins = range(len(edges) - 1)
    place = bin_number(F.col(value).cast("double"), edges[1:-1], right_closed=False)
    known = stream.where(F.col(value).isNotNull()).withColumn("_bin", place)
    sums = {f"n{b}": F.count(F.when(F.col("_bin") == b, 1)) for b in bins}
    counts = run_stream(counts_by_window(known, time, {}, sums, window, watermark), ["window_start"], folder)
    total: Column = sum((F.col(f"n{b}") for b in bins), F.lit(0))
    psi: Column = F.lit(0.0)
    for b in bins:
        share = F.when(F.col(f"n{b}") == 0, F.lit(epsilon)).otherwise(F.col(f"n{b}") / F.col("n"))
        base = shares.get(b) or epsilon
        psi = psi + (share - base) * F.log(share / base)
    return counts.withColumn("n", total).where("n > 0").select("window_start", "n", psi.alias("psi")).withColumn(
        "status", stability_status(F.col("psi")))


def window_rates(stream: DataFrame, time: str, kind: Column, window: str = "1 day", watermark: str = "1 hour",
                 folder: str | None = None) -> DataFrame:
    """window_start, kind, n and its share of the window's rows; rows of a null kind are a kind of their own."""
    counts = run_stream(counts_by_window(stream, time, {"kind": kind}, {"n": F.count(F.lit(1))}, window, watermark),
                        ["window_start", "kind"], folder)
    whole = counts.groupBy("window_start").agg(F.sum("n").alias("_all"))
    return counts.join(whole, "window_start").select("window_start", "kind", "n", (F.col("n") / F.col("_all")).alias("rate"))
