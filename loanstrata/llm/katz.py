"""Language-model scoring: a Katz bigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are cut into (history, word, document) counts, dealt into buckets by history, and packed as byte planes. They are
written once, as a table bucketed by that number, and every later step reads it without a shuffle: training counts only
the columns of pairs, scores those of documents too. All that a history needs is in one bucket: its own count, its
followers and their counts. As every word but the closing one is the history of the next token, the bucket also knows
the count of each word of a document, which the lower order and the base score need. Only followers must be looked up
elsewhere: each bucket asks the buckets of those words for their counts. Per-document sums come back in buckets of
documents.

A history that would fill a bucket alone (the opening token, or a word like "the") is spread over all buckets by its
followers. There are at most HOT_PER_BUCKET of them per bucket; their counts and backoff sums are added up per history.

P(w | h) = d(c(hw)) c(hw) / c(h) where c(hw) > 0, else a(h) P(w); a(h) makes the sum over all words exactly 1.
P(w) = d(c(w)) c(w) / N for known words; the discounted mass is the probability of the one class of unknown words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanstrata.llm.memory import trimmed, trimmed_pair
from loanstrata.llm.substring import LAST, bucket_count, ids_of
from loanstrata.llm.words import mix, pack, slices, unpack, words_of
from loanstrata.session import shared_folder

# Counts above this are trusted as they are.
GOOD_TURING_LIMIT = 5
BUCKET_BYTES = 9 << 20
# Texts packed together: the larger, the more often a pair is stored once for several documents.
PACK_BYTES = 4 << 20
# Files of the written table; beyond it a file holds several buckets.
MAX_FILES = 50_000
FIXED_POINT = 1e10
# A history is spread when it holds more than this part of an average bucket, so there are at most 4 per bucket.
HOT_PER_BUCKET = 4
BEGIN, END = np.uint64(1), np.uint64(2)

PAIR_COLUMNS, DOC_COLUMNS = ["h", "followers", "w", "trained", "holders"], ["docs", "doc", "times"]
ENTRY = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in PAIR_COLUMNS + DOC_COLUMNS]])
ENTRY_TYPE = "bucket int, " + ", ".join(f"{c} binary" for c in PAIR_COLUMNS + DOC_COLUMNS)


PLAIN = 16


def squeeze(values: np.ndarray) -> bytes:
    """Integers packed with as many bytes as the largest needs, which the first byte says.

    Compressed where that helps: the first byte is then greater by PLAIN, and four bytes with the plain size follow.
    """
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = pack(values, width)
    small = pa.compress(raw, "zstd", asbytes=True)
    return bytes([width]) + raw if len(small) + 4 >= len(raw) else bytes([width + PLAIN]) + len(raw).to_bytes(4, "little") + small


def unsqueeze(blob: bytes) -> np.ndarray:
    if blob[0] <= PLAIN:
        return unpack(blob[1:], blob[0])
    return unpack(pa.decompress(blob[5:], int.from_bytes(blob[1:5], "little"), "zstd", asbytes=True), blob[0] - PLAIN)


def lengths(head: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(head, total))


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    changed = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for key in keys:
        changed |= key[1:] != key[:-1]
    return np.flatnonzero(np.concatenate([[True], changed])[:len(keys[0])])


def home(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words) % np.uint64(buckets)).astype(np.int32)


def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids in order, their training flags, and the row, history and word of every token."""
    ids = ids_of(batch.column(0))
    order = np.argsort(ids, kind="stable")
    train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)[order]
    words = words_of(batch.column(1).take(pa.array(order)), True)
    code = (words.hash >> np.uint64(16)) | np.uint64(4)
    history, word = np.insert(code, words.first[:-1], BEGIN), np.insert(code, words.first[1:], END)
    return ids[order], train, np.repeat(np.arange(len(ids)), words.counts + 1), history, word


def hot_histories(rows: DataFrame, buckets: int) -> np.ndarray:
    """Histories with more than 1 / HOT_PER_BUCKET of an average bucket's tokens, sorted.

    Each slice reports those that reach half of that share in it. Whatever holds the whole share of all tokens and is
    spread evenly is reported nearly everywhere; what is missed only makes a bucket larger, never a result wrong.
    """
    share = 1 / (HOT_PER_BUCKET * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            history = pairs(batch)[3]
            h, n = np.unique(history, return_counts=True)
            often = n >= max(2, share / 2 * len(history))
            # Row 0 carries the tokens of the slice; no word has that code.
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[often], 0).astype(np.int64)), pa.array(np.append(n[often], len(history)))], ["h", "n"])

    counts = rows.mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    with shuffles_released(rows.sparkSession):
        total = counts.where("h = 0").first()
        least = share * (total["n"] if total else 0)
        # Shares above `share` leave room for at most 1 / share of them.
        found = counts.where((F.col("h") > 0) & (F.col("n") >= F.lit(max(least, 2.0)))).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.uint64))


def place(history: np.ndarray, word: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each token: that of its history, or for a hot history one drawn from both."""
    out = home(history, buckets)
    if len(hot):
        spread = held_in(history, hot)
        out[spread] = home(mix(history[spread]) ^ word[spread], buckets)
    return out


def held_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value occurs in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def count_slices(buckets: int, hot: np.ndarray):
    """Distinct (history, word, document) with their number, one row per slice of texts and bucket of histories.

    A row lists each history once, each of its followers once with its training count, and the documents of each pair
    as places in the row's list of ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=PACK_BYTES):
            ids, train, row, history, word = pairs(batch)
            # Codes have 48 bits and a slice few rows, so that word and row make one sort key.
            key = (word << np.uint64(16)) | row.astype(np.uint64)
            order = np.lexsort((key, history))
            key, history = key[order], history[order]
            first = heads(history, key)
            times = lengths(first, len(order))
            history, key = history[first], key[first]
            bucket = place(history, key >> np.uint64(16), hot, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = []
            for part in np.split(order, edges):
                h, w, n = history[part], key[part] >> np.uint64(16), times[part]
                r = (key[part] & np.uint64(0xFFFF)).astype(np.int64)
                of_pair = heads(h, w)
                of_h = heads(h[of_pair])
                present, local = np.unique(r, return_inverse=True)
                trained = np.add.reduceat(np.where(train[r], n, 0), of_pair)
                rows.append((int(bucket[part[0]]), pack(h[of_pair][of_h], 6), squeeze(lengths(of_h, len(of_pair))), pack(w[of_pair], 6),
                             squeeze(trained), squeeze(lengths(of_pair, len(part))), squeeze(np.diff(ids[present], prepend=0).view(np.uint64)),
                             squeeze(local), squeeze(n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ENTRY)], schema=ENTRY)
    return run


def counted(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """The packed counts, written once to the shared folder as a table bucketed by `bucket`.

    Groups and cogroups by bucket read it in place. The catalogue entry goes again at once, the files serve the frame.
    """
    spark, files = rows.sparkSession, min(buckets, MAX_FILES)
    name = f"katz_counts_{uuid.uuid4().hex}"
    blobs = rows.mapInArrow(trimmed(count_slices(buckets, hot)), ENTRY_TYPE).repartition(files, "bucket")
    with shuffles_released(spark):
        blobs.write.bucketBy(files, "bucket").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


class Pairs(NamedTuple):
    """One bucket: a row per slice, history and word, with the number of training documents' tokens."""

    h: np.ndarray
    w: np.ndarray
    trained: np.ndarray


def columns(table: pa.Table, names: list[str]) -> list[list[bytes]]:
    return [table.column(c).to_pylist() for c in names]


def pairs_in(table: pa.Table) -> Pairs:
    h, followers, w, trained = columns(table, PAIR_COLUMNS[:4])
    return Pairs(np.concatenate([np.repeat(unpack(a, 6), unsqueeze(n).astype(np.int64)) for a, n in zip(h, followers)]),
                 np.concatenate([unpack(a, 6) for a in w]), np.concatenate([unsqueeze(a) for a in trained]).astype(np.int64))


def documents_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of `pairs_in` the number of its documents, then their ids and counts, pair after pair."""
    docs, doc, times, holders = columns(table, [*DOC_COLUMNS, "holders"])
    ids = [np.cumsum(unsqueeze(d).view(np.int64))[unsqueeze(at).astype(np.int64)] for d, at in zip(docs, doc)]
    return (np.concatenate([unsqueeze(n) for n in holders]).astype(np.int64), np.concatenate(ids),
            np.concatenate([unsqueeze(n) for n in times]).astype(np.int64))


class Bigrams(NamedTuple):
    """Training counts of a bucket: histories with their counts, and the followers of each, sorted by both."""

    h: np.ndarray
    total: np.ndarray
    pair_h: np.ndarray
    pair_w: np.ndarray
    count: np.ndarray
    row_pair: np.ndarray


def bigrams(e: Pairs) -> Bigrams:
    """Counts over training documents; histories and pairs that only others hold are listed with count 0."""
    order = np.lexsort((e.w, e.h))
    h, w = e.h[order], e.w[order]
    first = heads(h, w)
    count = np.add.reduceat(e.trained[order], first)
    pair_h, pair_w = h[first], w[first]
    top = heads(pair_h)
    row_pair = np.empty(len(order), np.int32)
    row_pair[order] = np.repeat(np.arange(len(first), dtype=np.int32), lengths(first, len(order)))
    of_pair = np.repeat(np.arange(len(top), dtype=np.int32), lengths(top, len(first)))
    return Bigrams(pair_h[top], np.add.reduceat(count, top), of_pair, pair_w, count, row_pair)


def frequencies(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ... GOOD_TURING_LIMIT + 1."""
    return np.bincount(np.minimum(counts, GOOD_TURING_LIMIT + 2), minlength=GOOD_TURING_LIMIT + 3)[1:GOOD_TURING_LIMIT + 2].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts d[0 .. limit + 1] for counts up to the limit; 1 beyond.

    Where the counts of counts give none inside (0, 1), as on tiny corpora, r / (r + 1) is used.
    """
    k = GOOD_TURING_LIMIT
    out = np.ones(k + 2)
    far = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far) if n[r - 1] and far < 1 else 0.0
        out[r] = d if 0 < d < 1 else r / (r + 1)
    return out


class Model(NamedTuple):
    """What all buckets need: token count N, distinct tokens V, training documents, discounts of both orders.

    Also the counts of the hot histories, and the sums behind their backoff weights once these are known.
    """

    tokens: int
    distinct: int
    documents: int
    d1: np.ndarray
    d2: np.ndarray
    unknown: float
    spare: int
    hot: np.ndarray
    hot_count: np.ndarray
    hot_mass: np.ndarray | None = None
    hot_below: np.ndarray | None = None

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) by training count; 0 stands for the class of unknown words."""
        known = self.d1[np.minimum(count, GOOD_TURING_LIMIT + 1)] * count / max(self.tokens + self.spare, 1)
        return np.where(count > 0, known, self.unknown)


def model_of(n1: list[int], n2: list[int], tokens: int, distinct: int, documents: int, hot: np.ndarray, hot_count: np.ndarray) -> Model:
    d1, d2 = discounts(n1), discounts(n2)
    freed = sum((1 - d1[r]) * r * n1[r - 1] for r in range(1, GOOD_TURING_LIMIT + 1))
    # Where discounting frees no mass, one token more makes room for the unknown.
    spare = 0 if freed > 0 else 1
    unknown = freed / tokens if freed > 0 else 1 / (tokens + 1)
    return Model(tokens, distinct, documents, d1, d2, unknown, spare, hot, hot_count)


def bucket_stats(hot: np.ndarray):
    """Rows (at, n): sums at fixed places, then the counts of the hot histories in their order."""
    def run(table: pa.Table) -> pa.Table:
        b = bigrams(pairs_in(table))
        apart = held_in(b.h, hot)
        words = b.total[~apart & (b.h != BEGIN)]
        row = [int(words.sum()), int((words > 0).sum()), int(b.total[~apart & (b.h == BEGIN)].sum()), *frequencies(words), *frequencies(b.count)]
        at = np.concatenate([np.arange(len(row)), len(row) + np.searchsorted(hot, b.h[apart])])
        return pa.table({"at": pa.array(at, pa.int64()), "n": pa.array(np.concatenate([row, b.total[apart]]), pa.int64())})
    return run


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Frames built and collected inside delete their shuffle files once the query ends, not at some later collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def learn(blobs: DataFrame, hot: np.ndarray) -> Model:
    """A few sums per bucket, added up in Spark; the hot histories' counts enter once they are whole."""
    width = 3 + 2 * (GOOD_TURING_LIMIT + 1)
    sums = np.zeros(width + len(hot), np.int64)
    with shuffles_released(blobs.sparkSession):
        stats = blobs.select("bucket", *PAIR_COLUMNS[:4]).groupBy("bucket").applyInArrow(trimmed(bucket_stats(hot)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        for r in stats.collect():
            sums[r["at"]] = r["n"]
    tokens, distinct, documents, *n = sums[:width].tolist()
    n1, n2 = n[:GOOD_TURING_LIMIT + 1], n[GOOD_TURING_LIMIT + 1:]
    hot_count = sums[width:]
    documents += int(hot_count[hot == BEGIN].sum())
    known = hot_count[(hot != BEGIN) & (hot_count > 0)]
    tokens, distinct = tokens + int(known.sum()), distinct + len(known)
    n1 = [a + b for a, b in zip(n1, frequencies(known))]
    # The closing token: once in every training document.
    if documents:
        tokens, distinct = tokens + documents, distinct + 1
        if documents <= GOOD_TURING_LIMIT + 1:
            n1[documents - 1] += 1
    return model_of(n1, n2, tokens, distinct, documents, hot, hot_count)


class Followers(NamedTuple):
    """The pairs that training saw, their words once each, and the order in which other buckets are asked for them."""

    kept: np.ndarray
    word_of: np.ndarray
    words: np.ndarray
    order: np.ndarray
    target: np.ndarray


def followers_of(b: Bigrams, buckets: int) -> Followers:
    kept = np.flatnonzero(b.count > 0)
    words, word_of = np.unique(b.pair_w[kept], return_inverse=True)
    target = home(words, buckets)
    order = np.argsort(target, kind="stable")
    return Followers(kept, word_of, words, order, target[order])


def ask(buckets: int):
    """Rows (bucket, source, words, counts): the counts of the bucket's own words, and questions to other buckets."""
    def run(table: pa.Table) -> pa.Table:
        here = int(table.column("bucket")[0].as_py())
        b = bigrams(pairs_in(table))
        rows = [(here, -1, pack(b.h, 6), squeeze(b.total))]
        f = followers_of(b, buckets)
        asked = f.words[f.order]
        for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(f.target)) + 1):
            if len(part):
                rows.append((int(f.target[part[0]]), here, pack(asked[part], 6), None))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "source", "words", "counts"])
    return run


def answer(m: Model):
    """Counts of the asked words, in the order of the question, addressed to the bucket that asked."""
    return lambda table: _answer(table, m)


def _answer(table: pa.Table, m: Model) -> pa.Table:
    rows = list(zip(*[c.to_pylist() for c in table.columns]))
    own = [r for r in rows if r[1] < 0]
    words = unpack(own[0][2], 6) if own else np.zeros(0, np.uint64)
    counts = unsqueeze(own[0][3]).astype(np.int64) if own else np.zeros(0, np.int64)
    out = []
    for bucket, source, asked, _ in rows:
        if source >= 0:
            w = unpack(asked, 6)
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            found = np.where(words[at] == w, counts[at], 0) if len(words) else np.zeros(len(w), np.int64)
            if len(m.hot):
                apart = held_in(w, m.hot)
                found[apart] = m.hot_count[np.searchsorted(m.hot, w[apart])]
            out.append((source, bucket, squeeze(found)))
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], ["bucket", "source", "counts"])


def fixed(values: np.ndarray) -> bytes:
    """Sums as integers of 1e-10, so that small ones take few bytes and their order of addition does not matter."""
    v = np.round(values * FIXED_POINT).astype(np.int64)
    return pack(((v << 1) ^ (v >> 63)).view(np.uint64), 8)


def unfixed(blob: bytes) -> np.ndarray:
    v = unpack(blob, 8)
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def kept_sums(b: Bigrams, kept: np.ndarray, word_counts: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Discounted counts and lower-order probabilities of the kept pairs, and the sums of both per history."""
    low = m.unigram(np.where(b.pair_w[kept] == END, m.documents, word_counts))
    weight = m.d2[np.minimum(b.count[kept], GOOD_TURING_LIMIT + 1)] * b.count[kept]
    at = b.pair_h[kept]
    mass, below = np.zeros(len(b.h)), np.zeros(len(b.h))
    np.add.at(mass, at, weight)
    np.add.at(below, at, low)
    return weight, low, mass, below


def whole_counts(b: Bigrams, m: Model) -> np.ndarray:
    """Training count of each history of a bucket; a hot one's is that of all buckets."""
    total = b.total.copy()
    if len(m.hot):
        apart = held_in(b.h, m.hot)
        total[apart] = m.hot_count[np.searchsorted(m.hot, b.h[apart])]
    return total


def backoff(b: Bigrams, kept: np.ndarray, word_counts: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of a(h) per history, log10 P(w | h) of the kept pairs, and log10 P(w) of their words."""
    weight, low, mass, below = kept_sums(b, kept, word_counts, m)
    at, count = b.pair_h[kept], whole_counts(b, m)
    if len(m.hot):
        apart = held_in(b.h, m.hot)
        place_of = np.searchsorted(m.hot, b.h[apart])
        mass[apart], below[apart] = m.hot_mass[place_of], m.hot_below[place_of]
    # A history whose followers leave no mass gets one token more.
    total = count + (count - mass <= 1e-9 * count)
    left = np.where(count > 0, 1 - mass / np.maximum(total, 1), 1.0)
    return np.log10(left / np.maximum(1 - below, 1e-300)), np.log10(weight / total[at]), np.log10(low)


def replied(answers: pa.Table, f: Followers) -> np.ndarray:
    """Counts of the words of the kept pairs, in the order of the pairs."""
    replies = sorted(zip(answers.column("source").to_pylist(), answers.column("counts").to_pylist()))
    counts = np.zeros(len(f.words), np.int64)
    if replies:
        counts[f.order] = np.concatenate([unsqueeze(c) for _, c in replies]).astype(np.int64)
    return counts[f.word_of]


def hot_sums(m: Model, buckets: int):
    """A bucket's share of the backoff sums of the hot histories."""
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"at": pa.array([], pa.int64()), "mass": pa.array([], pa.float64()), "below": pa.array([], pa.float64())})
        b = bigrams(pairs_in(table))
        f = followers_of(b, buckets)
        _, _, mass, below = kept_sums(b, f.kept, replied(answers, f), m)
        apart = held_in(b.h, m.hot)
        return pa.table({"at": pa.array(np.searchsorted(m.hot, b.h[apart]), pa.int64()), "mass": mass[apart], "below": below[apart]})
    return run


def score_bucket(m: Model, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int32(), *[pa.binary()] * 5]
        names = ["bucket", "docs", "n_tokens", "n_known", "base", "score"]
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        b = bigrams(pairs_in(table))
        holders, row_doc, row_times = documents_in(table)
        del table
        f = followers_of(b, buckets)
        kept = f.kept
        alpha, high, low = backoff(b, kept, replied(answers, f), m)
        gain = np.zeros(len(b.count))
        gain[kept] = high - low - alpha[b.pair_h[kept]]
        begin = b.h == BEGIN
        # A word's own count is that of its history; the opening one stands for the closing token.
        own = np.where(begin, m.documents, whole_counts(b, m))
        with np.errstate(divide="ignore"):
            token, base = np.log10(m.unigram(own)), np.log10((own + 1) / (m.tokens + m.distinct + 1))
        order = np.argsort(row_doc, kind="stable")
        pair = np.repeat(b.row_pair, holders)[order]
        doc, times, h = row_doc[order], row_times[order], b.pair_h[pair]
        del row_doc, row_times, order
        first = heads(doc)
        doc = doc[first]
        sums = [np.add.reduceat(times, first), np.add.reduceat(np.where(own[h] > 0, times, 0), first),
                np.add.reduceat(times * base[h], first), np.add.reduceat(times * ((token + alpha)[h] + gain[pair]), first)]
        target = (doc % buckets).astype(np.int32)
        order = np.argsort(target, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
            rows.append((int(target[part[0]]), pack(np.diff(doc[part], prepend=0).view(np.uint64), 8), pack(sums[0][part], 8),
                         pack(sums[1][part], 8), fixed(sums[2][part]), fixed(sums[3][part])))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return run


def add_up(table: pa.Table) -> pa.Table:
    """Totals per document of one bucket of documents."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for _, docs, tokens, known, base, score in zip(*[c.to_pylist() for c in table.columns]):
        for out, v in zip(parts, (np.cumsum(unpack(docs, 8).view(np.int64)), unpack(tokens, 8).view(np.int64),
                                  unpack(known, 8).view(np.int64), unfixed(base), unfixed(score))):
            out.append(v)
    doc, *values = [np.concatenate(p) for p in parts]
    order = np.argsort(doc, kind="stable")
    first = heads(doc[order])
    doc, (tokens, known, base, score) = doc[order][first], [np.add.reduceat(v[order], first) for v in values]
    return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=doc == LAST), "n_tokens": tokens, "n_known": known,
                     "base_score": base / FIXED_POINT, "score": score / FIXED_POINT})


def in_fold(folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the doc_id's text falls in the held-out fold; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    The model learns from all rows that are not held out. Words are lower-cased (A-Z); each text ends with a closing
    token; a null or empty text is that token alone. Without training texts every token is unknown, with probability 1.
    Rows that share a doc_id are one document: their tokens and scores are added. Other columns are not read; an empty
    table gives no rows.
    """
    held_out = in_fold() if held_out is None else held_out
    buckets = bucket_count(docs, BUCKET_BYTES, 61)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (~held_out).alias("train"))
    hot = hot_histories(rows, buckets)
    blobs = counted(rows, buckets, hot)
    model = learn(blobs, hot)
    of_pairs = blobs.select("bucket", *PAIR_COLUMNS[:4])
    asked = of_pairs.groupBy("bucket").applyInArrow(trimmed(ask(buckets)), "bucket int, source int, words binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(trimmed(answer(model)), "bucket int, source int, counts binary")
    if len(hot):
        parts = of_pairs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(trimmed_pair(hot_sums(model, buckets)), "at long, mass double, below double")
        mass, below = np.zeros(len(hot)), np.zeros(len(hot))
        with shuffles_released(docs.sparkSession):
            for r in parts.groupBy("at").agg(F.sum("mass").alias("mass"), F.sum("below").alias("below")).collect():
                mass[r["at"]], below[r["at"]] = r["mass"], r["below"]
        model = model._replace(hot_mass=mass, hot_below=below)
    sums = blobs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        trimmed_pair(score_bucket(model, buckets)), "bucket int, docs binary, n_tokens binary, n_known binary, base binary, score binary")
    totals = sums.groupBy("bucket").applyInArrow(trimmed(add_up), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return totals.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
