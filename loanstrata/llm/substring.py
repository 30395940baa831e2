"""Removal of repeated word runs: Rabin-Karp hashes of every fixed-length window, counted in Spark.

Each task hashes all windows of its texts and keeps the earliest occurrence of each hash; later ones inside the task
are repeats already. Earliest occurrences are dealt into buckets by hash, packed as byte planes, so a window that a
third of all documents hold costs one entry per task slice. A bucket sorts its hashes and reports every occurrence that
is not the first. The reports meet the texts by document, where repeated windows merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.llm import memory
from loanstrata.llm.words import mix, pack, slices, text_bytes, unpack, windows, words_of

WINDOW = 20
# Text per bucket; a bucket holds about twice that in packed hashes and never depends on how often a window repeats.
BUCKET_BYTES = 8 << 20
MIN_BUCKETS = 97
LAST = (1 << 63) - 1
BLOB = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary()),
                  ("hashes", pa.binary())])
BLOB_TYPE = "bucket int, docs binary, counts binary, starts binary, hashes binary"


def prime_from(n: int) -> int:
    """The smallest prime of at least n, so that ids with a common stride still spread over the buckets."""
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def bucket_count(docs: DataFrame, target: int = BUCKET_BYTES, least: int = MIN_BUCKETS) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return prime_from(max(least, -(-size // target)))


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids; null stands after all others."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def grouped(doc: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Packs (doc, start) pairs sorted by both: distinct docs, entries of each, and start gaps inside a doc."""
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    gaps = np.diff(start, prepend=0)
    gaps[head] = start[head]
    return doc[head].astype("<i8").tobytes(), np.diff(np.append(head, len(doc))).astype("<u4").tobytes(), pack(gaps, 4)


def ungrouped(docs: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    doc = np.repeat(np.frombuffer(docs, "<i8"), n)
    run = np.cumsum(unpack(starts, 4).astype(np.int64))
    before = np.cumsum(n) - n
    return doc, run - np.repeat(np.where(before > 0, run[before - 1], 0), n)


def by_bucket(bucket: np.ndarray, doc: np.ndarray, start: np.ndarray, hashes: np.ndarray | None) -> Iterator[list]:
    """Blob rows of entries that come sorted by (doc, start)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield [int(bucket[part[0]]), *grouped(doc[part], start[part]), None if hashes is None else pack(hashes[part], 7)]


def hash_slices(size: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = ids_of(batch.column(0))
            order = np.argsort(ids, kind="stable")
            ids, words = ids[order], words_of(batch.column(1).take(pa.array(order)), False)
            row, at, hashes = windows(words, size)
            if not len(row):
                continue
            doc, start = ids[row], at - words.first[:-1][row]
            if (ids[1:] == ids[:-1]).any():
                again = np.lexsort((start, doc))
                doc, start, hashes = doc[again], start[again], hashes[again]
            _, first, member = np.unique(hashes, return_index=True, return_inverse=True)
            first.sort()
            owner = np.zeros(len(hashes), bool)
            owner[first] = True
            # Entries equal to the owner's place come from a repeated row and are no repeats.
            low = np.full(len(first), len(hashes))
            np.minimum.at(low, member, np.arange(len(hashes)))
            own = low[member]
            later = (doc > doc[own]) | (start > start[own])
            rows = list(by_bucket((mix(hashes[first]) % np.uint64(buckets)).astype(np.int32), doc[first], start[first], hashes[first]))
            if later.any():
                d, s = doc[later], start[later]
                rows += list(by_bucket((d % buckets).astype(np.int32), d, s, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOB)], schema=BLOB)
    return run


def later_starts(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket, every entry whose hash also has an earlier one; entries without hashes pass through."""
    def run(blobs: pa.Table) -> pa.Table:
        doc, start, hashes, known = [], [], [], []
        for _, docs, counts, starts, packed in zip(*[c.to_pylist() for c in blobs.columns]):
            d, s = ungrouped(docs, counts, starts)
            if packed is None:
                known.append((d, s))
            else:
                doc.append(d), start.append(s), hashes.append(unpack(packed, 7))
        if hashes:
            h = np.concatenate(hashes)
            order = np.argsort(h)
            h = h[order]
            same = h[1:] == h[:-1]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            h = np.concatenate(hashes)[order]
            d, s = np.concatenate(doc)[order], np.concatenate(start)[order]
            order = np.lexsort((s, d, h))
            h, d, s = h[order], d[order], s[order]
            head = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
            own = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, int)
            later = (d > d[own]) | (s > s[own])
            known.append((d[later], s[later]))
        d, s = (np.concatenate([k[i] for k in known]) if known else np.zeros(0, np.int64) for i in (0, 1))
        order = np.lexsort((s, d))
        rows = [r[:4] for r in by_bucket((d[order] % buckets).astype(np.int32), d[order], s[order], None)]
        fields = list(BLOB)[:4]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, fields)],
                                    schema=pa.schema(fields))
    return run


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal word intervals covered by windows that begin at the sorted starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > size) + 1
    return list(zip(starts[np.concatenate([[0], breaks])].tolist(),
                    (starts[np.concatenate([breaks - 1, [len(starts) - 1]])] + size).tolist()))


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for low, high in spans:
        kept += words[at:low]
        at = high
    return kept + words[at:]


def spans_by_doc(reports: pa.Table, size: int) -> dict[int, list[tuple[int, int]]]:
    parts = [ungrouped(*row) for row in zip(*[reports.column(c).to_pylist() for c in ("docs", "counts", "starts")])]
    if not parts:
        return {}
    doc, start = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return {int(doc[a]): intervals(start[a:b], size) for a, b in zip(head, np.append(head[1:], len(doc)))}


def repeats(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Packed (doc, start) of every window whose words also start earlier: smaller doc_id, or an earlier start in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blobs = rows.mapInArrow(memory.trimmed(hash_slices(size, buckets)), BLOB_TYPE)
    return blobs.groupBy("bucket").applyInArrow(memory.trimmed(later_starts(buckets)), "bucket int, docs binary, counts binary, starts binary")


def _with_texts(docs: DataFrame, size: int, finish: Callable, schema) -> DataFrame:
    buckets = bucket_count(docs)
    reports = repeats(docs, size, buckets)
    home = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.lit(buckets)).cast("int")
    key = "_home"
    while key in docs.columns:
        key += "_"
    left = docs.withColumn(key, home).groupBy(key)
    return left.cogroup(reports.groupBy("bucket")).applyInArrow(
        lambda texts, found: finish(texts, spans_by_doc(found, size)), schema)


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without repeated runs, all columns kept; a text left without words goes with its row.

    A text with a repeat becomes its kept words joined by one space, and `n_chars` its new length; other texts stay as
    they are. See `removal_report` for what counts as a repeat and for odd input.
    """
    names = docs.columns

    def finish(texts: pa.Table, spans: dict[int, list[tuple[int, int]]]) -> pa.Table:
        ids = ids_of(texts.column("doc_id").combine_chunks()) if texts.num_rows else []
        out, keep = texts.column("text").to_pylist(), np.ones(texts.num_rows, bool)
        sizes = texts.column("n_chars").to_pylist() if "n_chars" in names else None
        for i, doc in enumerate(ids):
            if (found := spans.get(int(doc))) and out[i]:
                kept = without(out[i].encode().split(), found)
                out[i] = b" ".join(kept).decode()
                keep[i] = bool(kept)
                if sizes is not None:
                    sizes[i] = len(out[i])
        columns = {n: texts.column(n) for n in names}
        columns["text"] = pa.chunked_array([pa.array(out, pa.string())])
        if sizes is not None:
            columns["n_chars"] = pa.chunked_array([pa.array(sizes, texts.schema.field("n_chars").type)])
        return pa.table(columns).filter(pa.array(keep))

    return _with_texts(docs, size, finish, docs.schema)


def removal_report(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every whole text.

    A word goes if some window of `size` words over it has the same words as a window that starts earlier: in a smaller
    doc_id, or in the same document further ahead. Words are compared unchanged, by 64-bit hashes of their bytes, and
    windows by 56 bits of their hash next to the bucket drawn from all 64. Null and empty texts have no words; texts
    shorter than a window lose none; a null doc_id stands after all others. Rows that repeat a doc_id and text do
    not count against each other; rows that share a doc_id but not the text lose the words at the same places.
    """
    target = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(texts: pa.Table, spans: dict[int, list[tuple[int, int]]]) -> pa.Table:
        rows = []
        for chunk in texts.to_batches():
            ids = ids_of(chunk.column(0))
            data, offsets = text_bytes(chunk.column(1))
            whole = data.tobytes()
            for doc, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                words = whole[a:b].split()
                kept = without(words, spans.get(doc, []))
                rows.append((None if doc == LAST else doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, target)], schema=target)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_texts(rows, size, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
