"""Language identification by cross-parsing: fewest phrases of a language's own text that spell out a document.

For each language a suffix automaton is built from a bounded sample of labelled text. A document is read greedily: a
phrase is the longest run that still occurs in the sample; where the automaton has no way on, a new phrase begins. The
language that needs the fewest phrases per byte wins. Texts are cut into segments of `SEGMENT` bytes that are parsed
side by side, one byte of every segment per step, so the work is a few array operations per byte and language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanstrata.llm import memory
from loanstrata.llm.words import LOWER, slices, text_bytes

SEGMENT = 256
# The bound of the fit: rows read of each language, bytes of its sample that enter the automaton, and bytes of all samples.
SAMPLE_ROWS = 200
SAMPLE_BYTES = 24_000
TOTAL_BYTES = 200 * SAMPLE_BYTES
# With more languages than leave this much to each, the fit refuses.
LEAST_BYTES = 1_000
LAST_HASH = (1 << 63) - 1
MARGIN = 4
UNKNOWN = "und"
# A text that needs more phrases than this per byte fits no learned language; the languages here need 0.1 to 0.3.
MAX_PHRASES_PER_BYTE = 0.75

# ASCII letters (lower-cased) and all bytes of other scripts are kept; the rest counts as one separator.
KEEP = np.zeros(256, bool)
KEEP[97:123] = True
KEEP[128:] = True


def symbols(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with everything but letters folded to 0."""
    data = LOWER[data]
    return np.where(KEEP[data], data, np.uint8(0))


def suffix_automaton(data: np.ndarray, width: int) -> np.ndarray:
    """Transitions (states x width, -1 where none) of the automaton that accepts every substring of `data`."""
    limit = 2 * len(data) + 2
    step = np.full((limit, width), -1, np.int32)
    length, link = [0] * limit, [-1] * limit
    last, size = 0, 1
    for c in data.tolist():
        new, size = size, size + 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and step[p, c] < 0:
            step[p, c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy, size = size, size + 1
                length[copy] = length[p] + 1
                step[copy] = step[q]
                link[copy] = link[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step[:size]


def parser(data: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
    """Flat table for cross-parsing: state * width + symbol gives the next state * width, plus 1 if a phrase ended.

    `width` is even, so the low bit is free. A symbol that no phrase can begin with is a phrase of its own.
    """
    step = suffix_automaton(code[data], width)
    fresh = np.maximum(step[0], 0) * width
    return np.where(step >= 0, step * width, fresh[None, :] + 1).astype(np.int32).reshape(-1)


class Model:
    """Automata of all languages over one alphabet: the bytes that occur in any sample, and one symbol for the rest."""

    def __init__(self, samples: dict[str, bytes]):
        texts = {lang: symbols(np.frombuffer(text, np.uint8)) for lang, text in samples.items()}
        seen = np.unique(np.concatenate(list(texts.values()))) if texts else np.zeros(0, np.uint8)
        self.code = np.full(256, len(seen), np.int32)
        self.code[seen] = np.arange(len(seen))
        width = len(seen) + 1 + (len(seen) + 1) % 2
        self.languages = sorted(texts)
        self.tables = [parser(texts[lang], self.code, width) for lang in self.languages]

    def phrases(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per row and language, and the bytes of each row."""
        data, offsets = text_bytes(column)
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.languages)), np.int64)
        if not len(data):
            return out, size
        code = self.code[symbols(data)]
        parts = -(-size // SEGMENT)
        row = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[:-1][row] + number * SEGMENT
        length = np.minimum(offsets[1:][row] - start, SEGMENT)
        order = np.argsort(-length, kind="stable")
        row, start, length = row[order], start[order], length[order]
        # How many segments still have a byte at each step; they come first.
        active = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
            for at, n in enumerate(active.tolist()):
                nxt = table[state[:n] + code[start[:n] + at]]
                ended = nxt & 1
                count[:n] += ended
                state[:n] = nxt - ended
            np.add.at(out[:, k], row, count + 1)
        return out, size


def model(samples: dict[str, bytes]) -> Model:
    return memory.held(hashlib.sha256(repr(sorted(samples.items())).encode()).digest(), lambda: Model(samples))


def in_fold(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the key's text falls in the held-out fold; a null key counts as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Sample text per language, at most `size` bytes, from `rows` distinct texts each.

    Every language is learned: where the samples would exceed TOTAL_BYTES together, all get the same smaller share, and a
    share under LEAST_BYTES raises a ValueError.

    Of equal texts one counts, so copies neither fill the sample nor thin it. The texts with the smallest hashes are taken,
    and of each text at most an eighth of the sample, so that one text does not stand for a language.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col("lang").cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("_order"), "text")
    # Copies are folded first: a language is as large as its distinct texts.
    counts = known.select("lang", "_order").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = TOTAL_BYTES // LEAST_BYTES
    sizes = {r["lang"]: r["n"] for r in counts.limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: their samples do not fit in {TOTAL_BYTES} bytes")
    size = min(size, TOTAL_BYTES // max(len(sizes), 1))
    known = known.withColumn("text", F.expr(f"substring(text, 1, {max(size // 8, 1)})"))
    # Hashes up to the cut hold about MARGIN times the texts wanted, before the exact choice.
    cuts = {lang: min(int(MARGIN * rows) * LAST_HASH // n, LAST_HASH) for lang, n in sizes.items()}
    while True:
        cut = labelled.sparkSession.createDataFrame(list(cuts.items()), "_lang string, _cut long")
        near = known.join(F.broadcast(cut), (F.col("lang") == F.col("_lang")) & (F.col("_order") <= F.col("_cut")))
        once = near.select("lang", "_order", "text").dropDuplicates(["lang", "_order"])
        best = once.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("_order"))).where(F.col("_at") <= rows)
        samples: dict[str, bytearray] = {}
        taken = dict.fromkeys(sizes, 0)
        for r in best.select("lang", "_at", "text").orderBy("lang", "_at").toLocalIterator():
            have = samples.setdefault(r["lang"], bytearray())
            have += (r["text"] + "\n").encode()[:size - len(have)]
            taken[r["lang"]] += 1
        short = [lang for lang, n in sizes.items() if taken[lang] < min(rows, n) and cuts[lang] < LAST_HASH]
        if not short:
            return {lang: bytes(text) for lang, text in samples.items() if text}
        # The cut left too few: it is raised until the smallest hashes are all there.
        cuts |= {lang: min(8 * cuts[lang] + 1, LAST_HASH) for lang in short}


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred and score for every whole text; only the text is looked at.

    `und` with score 0 where the text is null or has no letter, or when nothing was learned. Otherwise the score is
    the share of the runner-up's phrases in those of both, from 0.5 for a tie to near 1; with one language it is 1.
    Ties go to the first language in alphabetical order.
    """
    target = pa.schema([pa.field("doc_id", pa.int64()), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model(samples)
        names = np.array([*fitted.languages, UNKNOWN], object)
        for batch in slices(batches):
            counts, _ = fitted.phrases(batch.column(1))
            usable = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if len(fitted.languages):
                best = counts.argmin(1)
                two = np.sort(counts, 1)[:, :2].astype(float)
                score = two[:, 1] / np.maximum(two.sum(1), 1) if two.shape[1] == 2 else np.ones(len(best))
            else:
                usable, best, score = np.zeros_like(usable), np.zeros(len(usable), int), np.zeros(len(usable))
            best = np.where(usable, best, len(fitted.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()),
                                              pa.array(np.where(usable, score, 0.0))], schema=target)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lettered = rows.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return lettered.mapInArrow(memory.trimmed(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """Rows whose text has a recognised language, unchanged; rejected are null texts and texts without a letter."""
    known = F.col("text").rlike(r"\p{L}")
    schema = docs.schema
    if "text" not in docs.columns:
        raise ValueError("a text column is needed")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model(samples)
        for batch in slices(batches):
            counts, size = fitted.phrases(batch.column(at))
            if not len(fitted.languages):
                continue
            # A text that needs a phrase for nearly every letter fits no learned language.
            ok = counts.min(1) < np.maximum(size, 1) * MAX_PHRASES_PER_BYTE + 1
            yield batch.filter(pa.array(ok))

    return docs.where(known).mapInArrow(memory.trimmed(run), schema)

