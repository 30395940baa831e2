"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual subspace codes, table look-ups.

Fit: centroids of the lists and of the residual subspaces come from a bounded sample. Index: every vector is assigned
to its nearest list and its residual coded, one byte per subspace, with the length of what the code misses. Search: a
vector is sent to the lists nearest to it; there its distance to each code is a sum of table entries, and a pair stays
a candidate while that distance does not exceed the link radius plus what the code misses, so the codes lose no link.
Candidates are ranked again by exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanstrata.llm.components import components, stars
from loanstrata.session import pin

COSINE = 0.95
# The bound of the fit: vectors of the sample. Every row is indexed whatever the sample.
SAMPLE = 8192
MAX_LISTS = 1024
SUBSPACES = 8
CODES = 256
ROUNDS = 6
PROBES = 12
BLOCK_ROWS = 4000
QUERY_CHUNK = 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, of which there are few."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids; an empty one keeps its place."""
    pick = np.random.default_rng(7).permutation(len(rows))[:k]
    centres = rows[pick].copy()
    for _ in range(rounds):
        near = distances(rows, centres).argmin(1)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


class Index(NamedTuple):
    lists: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def assign(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        far = distances(x, self.lists)
        if far.shape[1] <= probes:
            return far.argsort(1, kind="stable")
        some = np.argpartition(far, probes, 1)[:, :probes]
        return np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(1, kind="stable"), 1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each residual and the length of the part that they miss."""
        code = np.zeros((len(residual), len(self.books)), np.uint8)
        missed = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m]:self.cuts[m + 1]]
            far = distances(part, book)
            code[:, m] = far.argmin(1)
            missed += far.min(1)
        return code, np.sqrt(missed)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each residual's part to every code: queries x subspaces x codes."""
        out = np.zeros((len(residual), len(self.books), CODES))
        for m, book in enumerate(self.books):
            out[:, m, :len(book)] = distances(residual[:, self.cuts[m]:self.cuts[m + 1]], book)
        return out


def fit(sample: np.ndarray, rows: int) -> Index:
    """Lists grow with the square root of the rows, up to MAX_LISTS and to an eighth of the sample."""
    k = int(max(1, min(MAX_LISTS, rows ** 0.5, len(sample) / 8)))
    lists = k_means(sample, k)
    residual = sample - lists[distances(sample, lists).argmin(1)]
    width = sample.shape[1]
    cuts = [width * m // min(SUBSPACES, width) for m in range(min(SUBSPACES, width) + 1)]
    return Index(lists, [k_means(residual[:, a:b], CODES) for a, b in zip(cuts, cuts[1:])], cuts)


def unit(blobs: pa.Array, kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = np.stack([np.frombuffer(b.as_buffer(), kind) for b in blobs]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def close_pairs(index: Index, centre: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) of at least the cosine, by table look-ups and an exact rank; y lies in one list."""
    code, missed = index.encode(y - centre)
    reach = (np.sqrt(2 - 2 * cosine) + missed + 1e-6) ** 2
    for at in range(0, len(x), QUERY_CHUNK):
        part = x[at:at + QUERY_CHUNK]
        table = index.tables(part - centre)
        far = np.zeros((len(part), len(y)))
        for m in range(len(index.books)):
            far += table[:, m, :][:, code[:, m]]
        i, j = np.nonzero(far <= reach[None, :])
        exact = np.einsum("ij,ij->i", part[i], y[j]) >= cosine
        yield i[exact] + at, j[exact]


def _links(rows: DataFrame, kind: str, total: int, cosine: float, probes: int) -> DataFrame:
    """Rows (vec_id, copies, blob) of one length to (a, b, n): n linked copies of a where b is null, else a link."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("blob").toArrow()
    index = fit(unit(sample.column(0), kind), total)
    shipped = spark.sparkContext.broadcast(index)
    placed_schema = pa.schema([("vec_id", pa.int64()), ("copies", pa.int64()), ("blob", pa.binary()), ("probes", pa.binary()), ("list", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                near = shipped.value.assign(unit(part.column(2), kind), probes).astype("<i4")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in near], pa.binary()),
                                                  pa.array(near[:, 0], pa.int32())], schema=placed_schema)

    placed = pin(rows.mapInArrow(assign, "vec_id long, copies long, blob binary, probes binary, list int"))
    # At most MAX_LISTS rows.
    blocks = {r["list"]: -(-r["n"] // BLOCK_ROWS) for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    work_schema = pa.schema([("list", pa.int32()), ("block", pa.int32()), ("member", pa.bool_()), ("home", pa.int32()),
                             ("vec_id", pa.int64()), ("copies", pa.int64()), ("blob", pa.binary()), ("probes", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A member row for the vector's own list and block, and query rows for every block it must be compared with."""
        for batch in batches:
            rows = []
            for vec, copies, blob, near, home in zip(*[c.to_pylist() for c in batch.columns]):
                own = (vec * 0x9E3779B1 >> 7) % blocks[home]
                rows.append((home, own, True, home, vec, copies, blob, near))
                rows += [(home, b, False, home, vec, copies, blob, near) for b in range(own)]
                rows += [(p, b, False, home, vec, copies, blob, near) for p in np.frombuffer(near, "<i4").tolist()
                         if p != home and p in blocks for b in range(blocks[p])]
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), work_schema)], schema=work_schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), work_schema)], schema=work_schema)

    def search(work: pa.Table) -> pa.Table:
        member = work.column("member").to_numpy()
        ids, copies = work.column("vec_id").to_numpy(), work.column("copies").to_numpy()
        home, here = work.column("home").to_numpy(), int(work.column("list")[0].as_py())
        mine, asked = np.flatnonzero(member), np.flatnonzero(~member)
        counts = np.zeros(len(ids), np.int64)
        a, b = [], []
        if len(mine):
            idx = shipped.value
            blob = work.column("blob").combine_chunks()
            y = unit(blob.take(pa.array(mine)), kind)
            back = np.stack([np.frombuffer(p.as_buffer(), "<i4") for p in work.column("probes").combine_chunks().take(pa.array(mine))])
            for queries in (mine, asked):
                for at in range(0, len(queries), 4 * QUERY_CHUNK):
                    some = queries[at:at + 4 * QUERY_CHUNK]
                    x = unit(blob.take(pa.array(some)), kind)
                    for i, j in close_pairs(idx, idx.lists[here], x, y, cosine):
                        i, j = some[i], j
                        if queries is mine:
                            ok = i < mine[j]
                        else:
                            # A pair that both lists would find is left to the smaller one.
                            ok = ~((home[i] < here) & (back[j] == home[i][:, None]).any(1))
                        i, j = i[ok], mine[j[ok]]
                        np.add.at(counts, i, copies[j])
                        np.add.at(counts, j, copies[i])
                        x1, y1 = stars(ids[i], ids[j])
                        a.append(x1), b.append(y1)
        some = np.flatnonzero(counts)
        empty = np.zeros(0, np.int64)
        x, y = stars(np.concatenate(a), np.concatenate(b)) if a else (empty, empty)
        return pa.table({"a": pa.array(np.concatenate([ids[some], x]), pa.int64()),
                         "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(y, pa.int64())]),
                         "n": pa.array(np.concatenate([counts[some], np.zeros(len(x), np.int64)]), pa.int64())})

    work = placed.mapInArrow(deal, "list int, block int, member boolean, home int, vec_id long, copies long, blob binary, probes binary")
    return work.groupBy("list", "block").applyInArrow(search, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links are pairs with cosine >= `cosine`.

    Equal vectors are searched once, by a 128-bit hash of their components, and counted by their number. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing, and vectors of different lengths never
    link. Rows that repeat a vec_id and its vector are one vector; a null vec_id links with nothing. Other columns are
    not read; an empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumns({
        "ok": F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull(),
        "k1": F.xxhash64(F.lit(1), "embedding"), "k2": F.xxhash64(F.lit(2), "embedding")})
    good = rows.where("ok")
    classes = pin(good.select("vec_id", "k1", "k2").distinct().groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    keyed = classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "rep", "copies")
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    firsts = good.join(keyed, same & (F.col("vec_id") == F.col("rep"))).select("vec_id", "copies", "embedding", "k1", "k2").dropDuplicates(["k1", "k2"])

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(
                [flat[e - s:e].tobytes() for s, e in zip(size.tolist(), ends.tolist())], pa.binary())], ["vec_id", "copies", "width", "blob"])

    packed = pin(firsts.select("vec_id", "copies", "embedding").mapInArrow(blobs, "vec_id long, copies long, width int, blob binary"))
    found = None
    for r in packed.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect():
        part = packed.where(F.col("width") == r["width"]).drop("width")
        links = _links(part, kind, r["n"], cosine, probes)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    found = pin(found)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b IS NOT NULL"), "a", "b").select(F.col("id").alias("_id"), "component")
    lead = keyed.join(counts, F.col("rep") == F.col("_a"), "left").join(joined, F.col("rep") == F.col("_id"), "left").select(
        "_k1", "_k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "rep").alias("_lead"))
    out = rows.select("vec_id", "ok", "k1", "k2").join(lead, same & F.col("ok"), "left")
    component = F.coalesce("_lead", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
