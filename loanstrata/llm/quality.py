"""Quality classifier: a sparse ensemble of rules over text statistics, scored by one Spark expression.

Statistics of every whole text are shares and counts of its bytes and words, taken in one pass as numpy arrays. Trees
are grown on a bounded sample of labelled rows; every path from a root is a conjunction of bounds on statistics, a rule.
A lasso logistic regression over all rules keeps few of them, and the kept rules with their weights become a column
expression: scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanstrata.llm.words import slices, text_bytes, words_of
from loanstrata.session import pin

# The bound of the fit: distinct labelled (document, label) rows that trees and weights see.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAF = 24, 4, 20
PENALTY = 0.002
FOLDS = 5

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "letters", "capitals", "digits", "spaces", "breaks", "commas",
    "ends", "shouts", "bars", "symbols", "high", "distinct_words", "top_word", "repeats", "capitalised", "symbol_ends", "end_words",
    "line_words",
]


def byte_class(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


CAPITALS = byte_class(bytes(range(65, 91)))
LETTERS = byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
DIGITS = byte_class(b"0123456789")
BREAKS = byte_class(b"\n")
SPACES = byte_class(b" \t\x0b\x0c\r\n")
COMMAS = byte_class(b",;:")
ENDS = byte_class(b".!?")
SHOUTS = byte_class(b"!")
BARS = byte_class(b"|")
SYMBOLS = byte_class(b"#$%&*+/<=>@\\^_`{}~[]()\"'-")
HIGH = byte_class(bytes(range(128, 256)))


def batch_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text; a null or empty text has 0 everywhere, as has a text without words where words count."""
    data, offsets = text_bytes(column)
    words = words_of(column, False)
    size, count = np.diff(offsets).astype(float), words.counts.astype(float)

    def total(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges]).astype(float)

    over = lambda a, b: np.divide(a, b, out=np.zeros(len(b)), where=b > 0)
    share = lambda table: over(total(table[data], offsets), size)
    per_word = lambda flags: over(total(flags, words.first), count)
    rows, n = len(column), len(words.start)
    length = words.end - words.start
    row = words.row()
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    same = np.zeros(n, bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    keys = np.sort((row.astype(np.uint64) << np.uint64(48)) | (words.hash >> np.uint64(16)))
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    runs = np.diff(np.append(head, n))
    owner = (keys[head] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(rows)
    np.maximum.at(most, owner, runs)
    last = data[words.end - 1] if n else np.zeros(0, np.uint8)
    first = data[words.start] if n else np.zeros(0, np.uint8)
    lines = total(BREAKS[data], offsets) + (size > 0)
    return {
        "log_bytes": np.log1p(size), "log_words": np.log1p(count), "word_bytes": over(total(~SPACES[data], offsets), count),
        "longest_word": np.log1p(longest), "letters": share(LETTERS), "capitals": share(CAPITALS), "digits": share(DIGITS),
        "spaces": share(SPACES), "breaks": share(BREAKS), "commas": share(COMMAS), "ends": share(ENDS), "shouts": share(SHOUTS),
        "bars": share(BARS), "symbols": share(SYMBOLS), "high": share(HIGH),
        "distinct_words": over(np.bincount(owner, minlength=rows).astype(float), count), "top_word": over(most, count),
        "repeats": per_word(same), "capitalised": per_word(CAPITALS[first]), "symbol_ends": per_word(SYMBOLS[last]),
        "end_words": per_word(ENDS[last]), "line_words": np.log1p(over(count, lines)),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """`doc_id` and the statistics of every row's whole text; other columns are left behind."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = batch_statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(found[s], pa.float64()) for s in STATISTICS]],
                                             names=["doc_id", *STATISTICS])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measured, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic the value must exceed the lower and not exceed the upper bound (None: open)."""
    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out = out & (F.col(name) > F.lit(low))
            if high is not None:
                out = out & (F.col(name) <= F.lit(high))
        return out

    def narrowed(self, name: str, low: float | None, high: float | None) -> "Rule":
        held = {n: (a, b) for n, a, b in self.bounds}
        a, b = held.get(name, (None, None))
        low = a if low is None else low if a is None else max(a, low)
        high = b if high is None else high if b is None else min(b, high)
        held[name] = (low, high)
        return Rule(tuple((n, *held[n]) for n in sorted(held)))

    def __str__(self) -> str:
        parts = []
        for name, low, high in self.bounds:
            parts += [f"{name} > {low:g}"] if low is not None else []
            parts += [f"{name} <= {high:g}"] if high is not None else []
        return " and ".join(parts)


@dataclass(frozen=True)
class RuleEnsemble:
    """Kept rules with their weights, and the intercept."""
    rules: tuple[tuple[Rule, float], ...]
    intercept: float
    candidates: int = 0

    def column(self) -> Column:
        """The chance of label 1, from columns that hold the statistics."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-margin))


def tree_rules(model, names: list[str]) -> list[Rule]:
    """All paths that start at the root of a tree of the forest, each rule once, in a fixed order.

    Of two rules that are each other's negation, as below a root, the upper bound stays.
    """
    found: dict[Rule, None] = {}

    def walk(node, rule: Rule) -> None:
        if rule.bounds:
            found.setdefault(rule)
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), rule.narrowed(name, None, threshold))
        walk(node.rightChild(), rule.narrowed(name, threshold, None))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), Rule(()))
    mirrored = lambda b: Rule(((b[0], None, b[1]),))
    return [r for r in found if len(r.bounds) > 1 or r.bounds[0][2] is not None or mirrored(r.bounds[0]) not in found]


def labelled_sample(stats: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Statistics, label and weight of at most `limit` labelled (document, label) rows, the smallest hashes first.

    Labels other than 0 and 1 and null ids do not count. Repeated label rows become a weight of at most 10.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id", "quality").agg(
        F.least(F.count(F.lit(1)), F.lit(10)).cast("double").alias("weight"))
    rows = stats.join(known, "doc_id").select(F.xxhash64("doc_id", *STATISTICS).alias("_hash"), F.col("quality").cast("double").alias("label"),
                                              "weight", *STATISTICS)
    return rows.orderBy("_hash", "label").limit(limit).drop("_hash")


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 12) -> RuleEnsemble:
    """Rules from the trees of a forest, weighted by a lasso logistic regression.

    Without labelled rows the score is 1/2 everywhere; with one class only it is that class's smoothed share.
    """
    spark = sample.sparkSession
    sample = pin(sample.coalesce(spark.sparkContext.defaultParallelism))
    n, ones = sample.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).collect()[0]
    n, ones = n or 0.0, ones or 0.0
    prior = math.log((ones + 0.5) / (n - ones + 0.5))
    if not 0 < ones < n:
        return RuleEnsemble((), prior)
    vectors = sample.select("label", "weight", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, weightCol="weight", seed=seed).fit(vectors)
    rules = tree_rules(forest, STATISTICS)
    if not rules:
        return RuleEnsemble((), prior)
    held = pin(sample.select("label", "weight", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=200, weightCol="weight").fit(held)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(tuple((r, float(w)) for r, w in zip(rules, weights) if w), float(lasso.intercept), len(rules))


def rule_table(model: RuleEnsemble, spark) -> DataFrame:
    """The kept rules, strongest first."""
    rows = sorted(((str(r), w) for r, w in model.rules), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame(rows, "rule string, weight double")


def in_fold() -> Column:
    """Held-out documents: crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row of `docs`, learned from labels outside the held-out fold.

    `labels` holds doc_id and quality (0 or 1). Null and empty texts are scored by their statistics, which are all 0;
    texts count whole, however long. Repeated rows are scored one by one, and each repeats its label. An empty `docs`
    gives no rows, empty labels give 1/2 for all. Other columns of either table are not read.
    """
    stats = pin(statistics(docs))
    model = fit(labelled_sample(stats.where(~in_fold()), labels, limit))
    scored = stats.select("doc_id", in_fold().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
