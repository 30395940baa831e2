"""Hard-negative mining by exact threshold joins over a length-filtered inverted index (L2AP style).

Vectors become integers, so scores are exact and ties are ties. The rows are dealt into blocks; a task holds one block
and the anchors stream past it. A block keeps its dimensions in slabs, strongest first, each with the list of the rows
that need it: a row leaves out every slab from which on its remaining norm times the anchors' cannot reach the
threshold. Partial scores grow slab by slab, a pair goes as soon as its partial score plus the product of the remaining
norms falls short, and what is left is scored in full. Thresholds start high and come down until an anchor's window is
full or its lower end is reached, so an anchor sees no more of a block than it needs.

Two passes: the best rows of the anchor's own label give the positives; their scores set the windows of the second
pass over the other labels. A block sends at most `positives` rows an anchor, then `negatives` rows a window: the best
of all blocks are among them, whatever the number of equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.session import pin

# Scaled components are held within this bound, so that sums of products stay exact in double precision.
LIMIT = 1 << 20
BLOCK_ROWS = 1 << 18
SLAB = 8
CELLS = 2_000_000
CHUNK = 256
PAIRS = 1 << 16
# Below this share of live pairs they are followed one by one.
SPARSE = 0.15
# Thresholds for positives as shares of the largest possible score; the last one admits every row.
SHARES = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0, -1.01)
# Thresholds for negatives as steps from the smallest positive score down to the lower end of its window.
STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)
FOUND = "key long, target long, vec_id long, score long"


def usable(df: DataFrame, scale: int) -> DataFrame:
    """Rows with an id, a label and finite components, as `floor(scale * x)`; equal rows are counted."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    known = df.select("vec_id", "label", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    held = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    rows = known.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", held).alias("vec"))
    return rows.groupBy("vec_id", "label", "vec").agg(F.count(F.lit(1)).alias("copies"))


def mine(df: DataFrame, anchors: str | Column = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5,
         low: int = 80, scale: int = 256) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` from vec_id, label, embedding.

    Positives are an anchor's best rows of its own label and another id; negatives of a positive are the best rows of
    other labels whose score is from `low` percent of the positive's score up to that score. Scores are inner products
    of the integer vectors, ties go to the smaller id. Rows take no part if the id, the label, the vector or a component
    is null or a component is not finite. An empty vector scores 0, a shorter one counts as filled with zeros, and
    scaled components beyond 2^20 are held there. A positive with a negative score has no window. Repeated rows count
    as often as they occur; an anchor row that repeats is mined once, one that shares its id but not its label or vector
    is mined for itself. Other columns of the input are ignored.
    """
    spark = df.sparkSession
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-df.count() // BLOCK_ROWS))
    rows = pin(usable(df, scale).withColumns({
        "key": F.xxhash64("vec_id", "label", "vec"), "block": F.pmod(F.xxhash64("vec", "vec_id"), F.lit(blocks)).cast("int")}))
    asked = rows.where(anchors).select("key", "vec_id", "label", "vec")

    first = threshold_join(rows, asked.withColumn("targets", F.lit(None).cast("array<bigint>")), blocks, positives, low)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = pin(first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select(
        "key", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    wanted = near.where("positive_score >= 0").groupBy("key").agg(F.collect_set("positive_score").alias("targets"))
    second = threshold_join(rows, asked.join(wanted, "key"), blocks, negatives, low)
    order = Window.partitionBy("key", "target").orderBy(F.desc("score"), "vec_id")
    far = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "key", F.col("target").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.join(far, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def threshold_join(rows: DataFrame, asked: DataFrame, blocks: int, top: int, low: int) -> DataFrame:
    """The best rows of every block for every anchor: of its label, or of the others inside each target's window."""
    none = F.lit(None).cast("array<bigint>")
    members = rows.select("block", F.lit(0).alias("kind"), "key", "vec_id", "label", "vec", none.alias("targets"),
                          F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)).cast("int"))).alias("copy")).drop("copy")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                          "key", "vec_id", "label", "vec", "targets")
    met = members.unionByName(visits).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(partial(visit_blocks, top=top, low=low), FOUND)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled with zeros, longer ones cut to `width`."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    own = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), own))
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - at] = values
    if width is None or own == width:
        return out
    return out[:, :width] if own > width else np.pad(out, ((0, 0), (0, width - own)))


class Index:
    """The rows of a block: slabs of dimensions, strongest first, and the norm that remains from each slab on."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.dims = np.argsort(-np.square(x).sum(0), kind="stable")
        self.width = x.shape[1]
        self.edges = list(range(0, self.width, SLAB)) + [self.width]
        self.slabs = [np.ascontiguousarray(x[order][:, self.dims[a:b]]) for a, b in zip(self.edges, self.edges[1:])]
        self.rest = self.remaining(self.slabs, len(ids))

    @staticmethod
    def remaining(slabs: list[np.ndarray], rows: int) -> np.ndarray:
        out = np.zeros((rows, len(slabs) + 1))
        for s in range(len(slabs) - 1, -1, -1):
            out[:, s] = out[:, s + 1] + np.square(slabs[s]).sum(1)
        return np.sqrt(out)

    def cut(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, self.dims[a:b]] for a, b in zip(self.edges, self.edges[1:])]

    def join(self, q: list[np.ndarray], q_rest: np.ndarray, least: np.ndarray, rows: np.ndarray):
        """Every (query, row, score) with a score of at least the query's threshold, among the given rows."""
        floor = least - 0.5
        empty = np.zeros(0, np.int64)
        # A row is listed in the slabs before the first one from which on no query can reach its threshold.
        reach = np.zeros(len(rows), np.int64)
        for s in range(len(self.slabs)):
            most = q_rest[:, s, None].max(initial=0.0)
            covered = self.rest[rows, s] * most < floor.min(initial=np.inf)
            reach = np.where(covered, reach, s + 1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if not self.slabs:
            done.append((np.repeat(np.arange(len(least)), len(rows)), np.tile(rows, len(least))))
        keep = reach > 0
        at, reach = rows[keep], reach[keep]
        held, s = np.zeros((len(least), len(at))), 0
        pairs = None
        while s < len(self.slabs) and len(at):
            held += q[s] @ self.slabs[s][at].T
            s += 1
            alive = held + q_rest[:, s, None] * self.rest[at, s] >= floor[:, None]
            ended = reach == s
            if ended.any():
                a, b = np.nonzero(alive & ended)
                done.append((a, at[b]))
                held, alive, at, reach = held[:, ~ended], alive[:, ~ended], at[~ended], reach[~ended]
            if len(at) and alive.mean() < SPARSE:
                a, b = np.nonzero(alive)
                pairs = (a, at[b], held[a, b], reach[b])
                break
        if pairs is not None:
            a, b, sums, ends = pairs
            while s < len(self.slabs) and len(a):
                sums = sums + np.einsum("ij,ij->i", q[s][a], self.slabs[s][b])
                s += 1
                alive = sums + q_rest[a, s] * self.rest[b, s] >= floor[a]
                out = alive & (ends == s)
                done.append((a[out], b[out]))
                alive &= ~out
                a, b, sums, ends = a[alive], b[alive], sums[alive], ends[alive]
        a = np.concatenate([d[0] for d in done]) if done else empty
        b = np.concatenate([d[1] for d in done]) if done else empty
        score = np.zeros(len(a))
        for i in range(0, len(a), PAIRS):
            part = slice(i, i + PAIRS)
            for s, slab in enumerate(self.slabs):
                score[part] += np.einsum("ij,ij->i", q[s][a[part]], slab[b[part]])
        enough = score >= floor[a]
        return a[enough], b[enough], score[enough].astype(np.int64)

    def own_label(self, label: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rows with the label, and of the others."""
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        return np.arange(lo, hi), np.concatenate([np.arange(lo), np.arange(hi, len(self.labels))])

    def positives(self, ids: np.ndarray, q: np.ndarray, label: int, top: int) -> Iterator[tuple]:
        """(query, None, id, score) of the best rows of the label, other ids than the query's own."""
        rows, _ = self.own_label(label)
        if not len(rows):
            return
        parts = self.cut(q)
        rest = self.remaining(parts, len(q))
        reachable = rest[:, 0] * self.rest[rows, 0].max()
        left = np.arange(len(q))
        for share in SHARES:
            least = np.ceil(reachable[left] * share)
            at, found, score = self.join([p[left] for p in parts], rest[left], least, rows)
            other = self.ids[found] != ids[left][at]
            at, found, score = at[other], found[other], score[other]
            full = np.bincount(at, minlength=len(left)) >= top
            if share == SHARES[-1]:
                full[:] = True
            order = np.lexsort((self.ids[found], -score, at))
            at, found, score = at[order], found[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            for i in np.flatnonzero(full[at] & (place < top)):
                yield int(left[at[i]]), None, int(self.ids[found[i]]), int(score[i])
            left = left[~full]
            if not len(left):
                return

    def negatives(self, q: np.ndarray, targets: list[np.ndarray], label: int, top: int, low: int) -> Iterator[tuple]:
        """(query, target, id, score) of the best rows of other labels in each target's window."""
        _, rows = self.own_label(label)
        if not len(rows):
            return
        parts = self.cut(q)
        rest = self.remaining(parts, len(q))
        high = np.array([t[0] for t in targets], float)
        end = np.array([-(-low * int(t[0]) // 100) for t in targets], float)
        left = np.arange(len(q))
        for step in STEPS:
            least = end[left] if step == 1.0 else np.floor(high[left] - (high[left] - end[left]) * step)
            at, found, score = self.join([p[left] for p in parts], rest[left], least, rows)
            order = np.lexsort((self.ids[found], -score, at))
            at, found, score = at[order], found[order], score[order]
            first = np.searchsorted(at, np.arange(len(left) + 1))
            still = []
            for i, query in enumerate(left):
                mine_, ids = score[first[i]:first[i + 1]], self.ids[found[first[i]:first[i + 1]]]
                rows_out, full = [], True
                for target in targets[query]:
                    bottom = -(-low * int(target) // 100)
                    a, b = np.searchsorted(-mine_, [-target, -bottom], "left")[0], np.searchsorted(-mine_, -bottom, "right")
                    full &= b - a >= top or least[i] <= bottom
                    rows_out += [(int(query), int(target), int(ids[k]), int(mine_[k])) for k in range(a, min(b, a + top))]
                if full:
                    yield from rows_out
                else:
                    still.append(query)
            left = np.array(still, np.int64)
            if not len(left):
                return


def visit_blocks(batches: Iterator[pa.RecordBatch], top: int, low: int) -> Iterator[pa.RecordBatch]:
    """Gathers the rows of a block, then answers its anchors; rows come before anchors, block after block."""
    block, parts, index = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        mark = number("block").astype(np.int64) * 2 + number("kind")
        edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            run = batch.slice(a, b - a)
            if mark[a] >> 1 != block:
                block, parts, index = mark[a] >> 1, [], None
            if not mark[a] & 1:
                parts.append((run.column("vec_id").to_numpy(), run.column("label").to_numpy(), matrix(run.column("vec"))))
                continue
            if index is None and parts:
                width = max(p[2].shape[1] for p in parts)
                x = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
                index = Index(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), x)
                parts = []
            if index is not None:
                yield from answers(index, run, top, low)


def answers(index: Index, run: pa.RecordBatch, top: int, low: int) -> Iterator[pa.RecordBatch]:
    keys, ids, labels = (run.column(n).to_numpy() for n in ("key", "vec_id", "label"))
    size = min(CHUNK, max(1, CELLS // max(1, len(index.ids))))
    for label in np.unique(labels):
        members = np.flatnonzero(labels == label)
        for i in range(0, len(members), size):
            chunk = members[i:i + size]
            q = matrix(run.column("vec").take(pa.array(chunk)), index.width)
            lists = run.column("targets").take(pa.array(chunk)).to_pylist()
            if lists[0] is None:
                found = list(index.positives(ids[chunk], q, int(label), top))
            else:
                found = list(index.negatives(q, [np.array(sorted(t), np.int64) for t in lists], int(label), top, low))
            if found:
                at, target, vec, score = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[chunk][list(at)]), pa.array(target, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
                    names=["key", "target", "vec_id", "score"])
