"""N-gram Jaccard join by T-occurrence search over inverted lists, in pieces that never hold more than a bounded group.

1. Every document's distinct shingles are hashed; equal sets become one class, represented by its smallest doc_id.
2. Shingles that only one document holds cannot be part of an overlap. They are found by dealing all hashes into buckets,
   packed, a shingle that many documents of a task share as one entry; what comes back to a document is its shared
   shingles. A document with too few of them for the threshold links with nothing and is done.
3. Of the others, two sets that reach the threshold must share one of their rarest shingles (n - ceil(t n) + 1 of
   them in a common order). A counting sketch puts common shingles last, so that shared passages do not bring
   strangers together. Documents that share such a shingle at a comparable size form clusters; every link lies inside one.
4. Inside a cluster each document is a query against the inverted lists of the smaller ones: short lists are merged,
   long ones probed by binary search, and candidates with the required overlap are linked (DivideSkip). Candidates
   already connected need no test, so a group of near copies costs one test each.
Large clusters are cut into tiles of similar size, each pair of blocks a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.llm import memory
from loanstrata.llm.components import components, stars
from loanstrata.llm.substring import bucket_count
from loanstrata.llm.words import mix, pack, shingle_sets, slices, unpack
from loanstrata.session import pin

SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
# A cluster up to this size is one task; larger ones are cut into blocks of about BLOCK_DOCS documents.
TASK_SHINGLES = 3_000_000
TASK_DOCS = 6_000
BLOCK_DOCS = 2_000
PREFIX_BUCKETS = 128
# The long lists' share of a query, after DivideSkip: L = T / (MU * log2(longest list) + 1).
MU = 0.0085



def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """A counting sketch of all shingles: 2^SKETCH_BITS counters, 4 MB whatever the input.

    It only orders shingles by how common they are; no result depends on its accuracy.
    """
    width = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for batch in slices(batches):
            shingles, _ = shingle_sets(batch.column(0), size)
            total += np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint32)
        blocks = [pack(block, 4) for block in total.reshape(-1, SKETCH_BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    def add(tables: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.uint64)
        for blob in tables.column(1):
            total += unpack(blob.as_py(), 4)
        return pa.table({"block": tables.column(0).slice(0, 1), "counts": pa.array([pack(np.minimum(total, 2 ** 32 - 1), 4)], pa.binary())})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    sums = texts.mapInArrow(memory.trimmed(count), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    out = np.zeros((width // SKETCH_BLOCK, SKETCH_BLOCK), np.uint32)
    for row in sums.toLocalIterator():
        out[row["block"]] = unpack(row["counts"], 4)
    return out.reshape(-1)


def order_key(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Common order of shingles: how many times the usual load their counter has, in powers of two, then the hash."""
    usual = max(float(counts.mean()), 1.0)
    load = counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]
    steps = np.floor(np.log2(np.maximum(load / usual, 1.0))).astype(np.uint64)
    return (steps << np.uint64(48)) | shingles


def required(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of a set of n with any set that reaches the threshold num / den."""
    return -(-num * n // den)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n and a 128-bit signature of the shingle set."""
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shingles, first = shingle_sets(batch.column(1), size)
            n = np.diff(first)
            some = first[:-1][n > 0]
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(shingles):
                s1[n > 0] = np.add.reduceat(mix(shingles), some)
                s2[n > 0] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)),
                                              pa.array(s2.view(np.int64))], schema=fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(memory.trimmed(run), "doc_id long, n long, s1 long, s2 long")


HELD = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("per", pa.binary()), ("hashes", pa.binary())])
HELD_TYPE = "bucket int, kind int, docs binary, per binary, hashes binary"
ONCE, OFTEN, SHARED, SIZE = 0, 1, 2, 3


def _packed(bucket: np.ndarray, doc: np.ndarray, hashes: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows of entries sorted by document: distinct documents, entries of each, hashes."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        d = doc[part]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        yield (int(bucket[part[0]]), kind, pack(np.diff(d[head], prepend=0).view(np.uint64), 8),
               pack(np.diff(np.append(head, len(d))), 4), pack(hashes[part], 6))


def _unpacked(docs: bytes, per: bytes, hashes: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    ids = np.cumsum(unpack(docs, 8).view(np.int64))
    n = unpack(per, 4).astype(np.int64)
    return (ids, n) if hashes is None else (np.repeat(ids, n), unpack(hashes, 6))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def shared_shingles(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, shingles): the shingles each document shares with another one, where they are enough to link it.

    Rows with a null doc_id are left out; rows that share a doc_id count as one document with the larger size.
    """
    buckets = bucket_count(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            shingles, first = shingle_sets(batch.column(1).take(pa.array(order)), size)
            ids, n = ids[order], np.diff(first)
            doc = np.repeat(ids, n)
            _, where, member, times = np.unique(shingles, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(doc), bool)
            lead[where] = True
            often = times[member] > 1
            home = (mix(shingles) % np.uint64(buckets)).astype(np.int32)
            rows = []
            for chosen, kind in ((lead & ~often, ONCE), (lead & often, OFTEN)):
                rows += _packed(home[chosen], doc[chosen], shingles[chosen], kind)
            rows += _packed((doc[often] % buckets).astype(np.int32), doc[often], shingles[often], SHARED)
            back = (ids % buckets).astype(np.int32)
            order = np.argsort(back, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(back[order])) + 1):
                rows.append((int(back[part[0]]), SIZE, pack(np.diff(ids[part], prepend=0).view(np.uint64), 8), pack(n[part], 4), None))
            yield from _table(rows, HELD).to_batches()

    def find(table: pa.Table) -> pa.Table:
        rows, docs, hashes, once = [], [], [], []
        for row in zip(*[c.to_pylist() for c in table.columns]):
            if row[1] in (SHARED, SIZE):
                rows.append(row)
            else:
                d, h = _unpacked(*row[2:])
                docs.append(d), hashes.append(h), once.append(np.full(len(d), row[1] == ONCE))
        if docs:
            h = np.concatenate(hashes)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            order = order[np.concatenate(once)[order]]
            d = np.concatenate(docs)[order]
            by_doc = np.argsort(d, kind="stable")
            rows += _packed((d[by_doc] % buckets).astype(np.int32), d[by_doc], h[order][by_doc], SHARED)
        return _table(rows, HELD)

    target = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def gather(table: pa.Table) -> pa.Table:
        docs, hashes, ids, sizes = [], [], [], []
        for row in zip(*[c.to_pylist() for c in table.columns]):
            a, b = _unpacked(*row[2:])
            (ids if row[1] == SIZE else docs).append(a), (sizes if row[1] == SIZE else hashes).append(b)
        if not docs:
            return _table([], target)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        order = np.lexsort((sizes, ids))
        ids, sizes = ids[order], sizes[order]
        last = np.append(ids[1:] != ids[:-1], True)
        ids, sizes = ids[last], sizes[last]
        d, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
        d, h = d[new], h[new]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ends = np.append(head[1:], len(d))
        n = sizes[np.searchsorted(ids, d[head])]
        enough = ends - head >= required(n, num, den)
        rows = [(int(d[x]), int(k), pack(h[x:y], 6)) for x, y, k in zip(head[enough], ends[enough], n[enough])]
        return _table(rows, target)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    found = texts.mapInArrow(memory.trimmed(deal), HELD_TYPE).groupBy("bucket").applyInArrow(memory.trimmed(find), HELD_TYPE)
    return found.groupBy("bucket").applyInArrow(memory.trimmed(gather), "doc_id long, n long, shingles binary")


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets that reach the threshold differ by at most one class."""
    return np.floor(np.log(n) / np.log(den / num) + 1e-9).astype(np.int64)


def _prefix_links(reps: DataFrame, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """Links between documents that share a rare shingle in the same or adjacent size classes; a few per document.

    A task keeps one entry for each shingle and class and links the others to it at once, so a shingle that all its
    documents share is dealt out as one entry per task.
    """
    shipped = reps.sparkSession.sparkContext.broadcast(counts)
    link = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("h", pa.binary()), ("c", pa.binary())])

    def star_links(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the first entry of each (shingle, class), and links of the rest to it."""
        order = np.lexsort((doc, c, h))
        h, c = h[order], c[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[:len(h)]
        own = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(h) else order
        return order[head], doc[order[~head]], doc[own[~head]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            parts = [unpack(x.as_py(), 6) for x in batch.column(2)]
            # Shingles that no other document holds come first in the order, and need not be looked at.
            few = n - required(n, num, den) + 1 - (n - np.array([len(p) for p in parts]))
            parts = [p[np.argsort(order_key(p, shipped.value))[:k]] for p, k in zip(parts, few.tolist())]
            sizes = [len(p) for p in parts]
            doc = np.repeat(batch.column(0).to_numpy(), sizes)
            c = np.repeat(size_class(n.astype(float), num, den), sizes)
            h = np.concatenate(parts)
            head, x, y = star_links(h, c, doc)
            x, y = stars(x, y)
            h, c, doc = h[head], c[head], doc[head]
            bucket = (mix(h) % np.uint64(PREFIX_BUCKETS)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows = [(int(bucket[p[0]]), pack(doc[p].view(np.uint64), 8), None, pack(h[p], 6), pack(c[p].astype(np.uint64), 2))
                    for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]
            if len(x):
                rows.append((int(x[0] % PREFIX_BUCKETS), pack(x.view(np.uint64), 8), pack(y.view(np.uint64), 8), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), link)], schema=link)

    def join(tables: pa.Table) -> pa.Table:
        docs, hs, cs, xs, ys = [], [], [], [], []
        for _, a, b, h, c in zip(*[col.to_pylist() for col in tables.columns]):
            if h is None:
                xs.append(unpack(a, 8).view(np.int64)), ys.append(unpack(b, 8).view(np.int64))
            else:
                docs.append(unpack(a, 8).view(np.int64)), hs.append(unpack(h, 6)), cs.append(unpack(c, 2).astype(np.int64))
        if docs:
            doc, h, c = np.concatenate(docs), np.concatenate(hs), np.concatenate(cs)
            head, x, y = star_links(h, c, doc)
            xs.append(x), ys.append(y)
            h, c, doc = h[head], c[head], doc[head]
            near = np.flatnonzero((h[1:] == h[:-1]) & (c[1:] == c[:-1] + 1))
            xs.append(doc[near]), ys.append(doc[near + 1])
        x, y = stars(np.concatenate(xs), np.concatenate(ys))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    blobs = reps.select("doc_id", "n", "shingles").mapInArrow(memory.trimmed(spread), "bucket int, a binary, b binary, h binary, c binary")
    return blobs.groupBy("bucket").applyInArrow(memory.trimmed(join), "a long, b long")


def occurrence_links(ids: np.ndarray, side: np.ndarray, n: np.ndarray, parts: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among a few sets: every linked pair is connected by the returned ones.

    `parts` hold the shared shingles of sets of size `n`. `side` is 0 where all pairs count; sets of side 1 are only compared with those of side 2.
    """
    order = np.lexsort((ids, n))
    n, side, name = n[order], side[order], ids[order]
    held_by = np.array([len(parts[i]) for i in order], np.int64)
    total = len(order)
    doc = np.repeat(np.arange(total), held_by)
    shingle = np.concatenate([parts[i] for i in order])
    by_list = np.argsort(shingle, kind="stable")
    ranked = shingle[by_list]
    list_of = np.zeros(len(shingle), np.int64)
    list_of[by_list] = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
    place = np.zeros(len(shingle), np.int64)
    place[by_list] = np.arange(len(shingle))
    posting = doc[by_list]
    keyed = list_of[by_list] * total + posting
    ends = np.cumsum(held_by)
    parent = list(range(total))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    for q in range(1, total):
        size = int(n[q])
        low = int(np.searchsorted(n, -(-num * size // den)))
        if low >= q:
            continue
        own = slice(int(ends[q] - held_by[q]), int(ends[q]))
        lists, until = list_of[own], place[own]
        start = np.searchsorted(keyed, lists * total + low)
        length = until - start
        some = length > 0
        need = -(-num * (size + int(n[low])) // (num + den))
        if int(some.sum()) < need:
            continue
        lists, start, length = lists[some], start[some], length[some]
        by_size = np.argsort(length, kind="stable")
        lists, start, length = lists[by_size], start[by_size], length[by_size]
        long_lists = min(need - 1, int(need / (MU * np.log2(float(length[-1]) + 1) + 1)))
        cut = len(lists) - long_lists
        spans = length[:cut]
        offset = np.repeat(start[:cut] - (np.cumsum(spans) - spans), spans)
        counts = np.bincount(posting[np.arange(len(offset)) + offset] - low, minlength=q - low)
        candidates = np.flatnonzero(counts >= need - long_lists)
        if side[q]:
            candidates = candidates[side[candidates + low] != side[q]]
        candidates = candidates[np.argsort(-counts[candidates], kind="stable")]
        at, step = 0, 1
        while at < len(candidates):
            mine = find(q)
            chunk = [c for c in candidates[at:at + step].tolist() if find(c + low) != mine]
            at, step = at + step, min(step * 4, 1024)
            if not chunk:
                continue
            these = np.array(chunk)
            probes = (lists[cut:, None] * total + (these + low)[None, :]).reshape(-1)
            hits = np.searchsorted(keyed, probes)
            held = (keyed[np.minimum(hits, len(keyed) - 1)] == probes).reshape(long_lists, len(these)).sum(0)
            overlap = held + counts[these]
            for c in these[overlap * (den + num) >= num * (size + n[these + low])].tolist():
                x, y = find(q), find(c + low)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((q, c + low))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return name[pairs[:, 0]], name[pairs[:, 1]]


def _tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """Adds one row per task a document takes part in: `tile` (a key) and `side`.

    A small cluster is one tile. A large one is cut by size class and into blocks of about BLOCK_DOCS inside a class;
    blocks meet those of their own and of the next class, no others.
    """
    members = members.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int"))
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_docs"))
    sized = members.join(sizes.withColumnRenamed("cluster", "_k"), F.col("cluster") == F.col("_k")).drop("_k")
    large = (F.col("_total") > TASK_SHINGLES) | (F.col("_docs") > TASK_DOCS)
    small = sized.where(~large).select("doc_id", F.xxhash64(F.lit("s"), "cluster").alias("tile"), F.lit(0).alias("side"))
    big = pin(sized.where(large).select("doc_id", "n", "cluster", "c"))
    per = big.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("t") * 3 / TASK_SHINGLES), F.lit(1)).cast("int")
    # One row per cluster and size class, of which there are at most a few hundred per cluster.
    around = Window.partitionBy("cluster").orderBy("c")
    per = per.withColumn("m", blocks)
    per = per.withColumns({"_up": F.when(F.lead("c").over(around) == F.col("c") + 1, F.lead("m").over(around)),
                           "_down": F.when(F.lag("c").over(around) == F.col("c") - 1, F.lag("m").over(around))})
    table = per.select(F.col("cluster").alias("_k"), F.col("c").alias("_c"), "m", "_up", "_down")
    placed = big.join(table, (F.col("cluster") == F.col("_k")) & (F.col("c") == F.col("_c")))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int"))
    count = lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda kind, c, i, j: F.xxhash64(F.lit(kind), F.col("cluster"), c, i, j)
    b, c = F.col("_b"), F.col("c")
    within = F.transform(count("m"), lambda j: F.struct(
        key("w", c, F.least(b, j), F.greatest(b, j)).alias("tile"),
        F.when(b == j, F.lit(0)).when(b < j, F.lit(1)).otherwise(F.lit(2)).alias("side")))
    above = F.transform(count("_up"), lambda j: F.struct(key("x", c, b, j).alias("tile"), F.lit(1).alias("side")))
    below = F.transform(count("_down"), lambda j: F.struct(key("x", c - 1, j, b).alias("tile"), F.lit(2).alias("side")))
    tiled = placed.select("doc_id", F.explode(F.concat(within, above, below)).alias("_t")).select("doc_id", "_t.tile", "_t.side")
    return small.unionByName(tiled)


def _members(classes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n and cluster of every member of a component, its smallest included."""
    found = pin(found)
    inside = found.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")).unionByName(
        found.select(F.col("component").alias("doc_id"), F.col("component").alias("cluster")).distinct())
    return classes.select(F.col("rep").alias("doc_id"), "n").join(inside, "doc_id")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; links need Jaccard >= num / den of distinct shingles.

    Words are lower-cased (A-Z) and taken from whole texts; a text shorter than a shingle is one shingle of all its
    words. Texts without words (also null) link with nothing. `component_id` is the smallest doc_id reachable by links,
    itself included. Rows that repeat a doc_id stay as rows and count as one document; a null doc_id links with
    nothing and has no component. Other columns are not read; an empty table gives no rows.
    """
    signed = pin(_signatures(docs, size))
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = pin(usable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    leads = classes.select(F.col("rep").alias("_r")).distinct()
    reps = pin(shared_shingles(docs, size, num, den).join(leads, F.col("doc_id") == F.col("_r"), "left_semi"))
    clusters = components(_prefix_links(reps, num, den, rarity(docs, size)), "a", "b")
    tiles = _tiles(_members(classes, clusters), num, den).withColumnRenamed("doc_id", "_d")
    held = reps.join(tiles, F.col("doc_id") == F.col("_d")).select("tile", "doc_id", "side", "n", "shingles")

    def link(tables: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), 6) for x in tables.column(4)]
        a, b = occurrence_links(*[tables.column(i).to_numpy() for i in (1, 2, 3)], parts, num, den)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = held.groupBy("tile").applyInArrow(memory.trimmed(link), "a long, b long")
    joined = components(links, "a", "b")
    found = joined.select(F.col("id").alias("_id"), "component")
    lead = classes.join(found, F.col("rep") == F.col("_id"), "left").select(
        F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("n").alias("_n"), F.coalesce("component", "rep").alias("_lead"))
    same = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n"))
    out = signed.select("doc_id", "n", "s1", "s2").join(lead, same & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(
        F.col("doc_id").isNotNull(), F.coalesce("_lead", "doc_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Documents that are the smallest of their component, all columns kept; rows with a null doc_id stay."""
    found = jaccard_components(docs, size, num, den)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
