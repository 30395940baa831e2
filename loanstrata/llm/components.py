"""Connected components of a link table, without holding a component in one task or on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.session import pin

MAX_ROUNDS = 60


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a few links in memory: every node that is not the smallest of its component, and that smallest."""
    if not len(a):
        return a, b
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[:len(a)], both[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        jumped = root[root]
        while not np.array_equal(jumped, root):
            root, jumped = jumped, jumped[jumped]
        if np.array_equal(root, before):
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, root = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["v", "p"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every linked id that is not the smallest of its component; `component` is that smallest.

    Links inside an Arrow batch are first reduced to stars, which caps the rows of any one node. Each round then hooks
    every node to its smallest neighbour below it, links its other neighbours to that one, and halves the paths by a join
    of the table with itself; each round is written to the shared folder. Self links, repeats and both directions
    are allowed; an empty table gives no rows; null ends are ignored.
    """
    ends = links.select(F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).where("_a <> _b")
    edges = ends.select(F.greatest("_a", "_b").alias("v"), F.least("_a", "_b").alias("p"))
    edges = pin(edges.mapInArrow(_local_stars, "v long, p long"))
    for _ in range(MAX_ROUNDS):
        parent = edges.groupBy("v").agg(F.min("p").alias("m"), F.max("p").alias("_most"))
        parent = pin(parent)
        other = edges.join(parent.where("_most <> m").select(F.col("v").alias("_v"), "m"), F.col("v") == F.col("_v"))
        other = other.where("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        up = parent.select(F.col("v").alias("_w"), F.col("m").alias("_m2"))
        jumped = parent.join(up, parent["m"] == up["_w"], "left")
        hooked = jumped.select("v", F.coalesce("_m2", "m").alias("p"), F.col("_m2").isNotNull().alias("moved"))
        merged = other.select("v", "p", F.lit(True).alias("moved"))
        nxt = pin(hooked.unionByName(merged))
        if nxt.where("moved").limit(1).count() == 0:
            return nxt.select(F.col("v").alias("id"), F.col("p").alias("component"))
        edges = nxt.select("v", "p").mapInArrow(_local_stars, "v long, p long")
    raise RuntimeError("components did not settle")
