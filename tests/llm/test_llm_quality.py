"""The rule ensemble: statistics and scores against plain versions, held-out accuracy, odd input."""

from __future__ import annotations

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

import plain
from conftest import SMALL
from loanstrata.llm import quality

LABELS = "doc_id long, quality int"
LARGER = "/root/testdata/sf0.1"


def plain_statistics(text):
    data = (text or "").encode()
    words = [w.encode() for w in plain.words(text)]
    n, size = len(words), len(data)
    share = lambda chars: sum(b in chars for b in data) / size if size else 0.0
    over = lambda x: x / n if n else 0.0
    letters = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
    symbols = b"#$%&*+/<=>@\\^_`{}~[]()\"'-"
    lines = data.count(b"\n") + (size > 0)
    return {
        "log_bytes": math.log1p(size), "log_words": math.log1p(n), "word_bytes": over(sum(map(len, words))),
        "longest_word": math.log1p(max(map(len, words), default=0)), "letters": share(letters), "capitals": share(range(65, 91)),
        "digits": share(b"0123456789"), "spaces": share(b" \t\x0b\x0c\r\n"), "breaks": share(b"\n"), "commas": share(b",;:"),
        "ends": share(b".!?"), "shouts": share(b"!"), "bars": share(b"|"), "symbols": share(symbols), "high": share(range(128, 256)),
        "distinct_words": over(len(set(words))), "top_word": over(max(collections.Counter(words).values(), default=0)),
        "repeats": over(sum(a == b for a, b in zip(words, words[1:]))), "capitalised": over(sum(65 <= w[0] < 91 for w in words)),
        "symbol_ends": over(sum(w[-1] in symbols for w in words)), "end_words": over(sum(w[-1] in b".!?" for w in words)),
        "line_words": math.log1p(n / lines if lines else 0.0)}


def test_statistics_match_plain_version(spark):
    rows = [(i, t) for i, (_, t) in enumerate(plain.odd_rows())] + [(90, "| a | b !! C# d-"), (91, "A A a\n\nb b b.")]
    got = {r.doc_id: r for r in quality.statistics(plain.with_clashes(plain.documents(spark, rows))).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        for name, value in plain_statistics(text).items():
            assert got[doc][name] == pytest.approx(value, abs=1e-12), (doc, name)


def test_column_equals_plain_rules(spark):
    rows = [(1, "one two three"), (2, None), (3, "x " * 40), (4, "A! B! C!")]
    stats = quality.statistics(plain.documents(spark, rows))
    low = quality.Rule((("log_words", 1.0, None),)).narrowed("spaces", None, 0.4).narrowed("log_words", 0.5, 3.0)
    assert low.bounds == (("log_words", 1.0, 3.0), ("spaces", None, 0.4))
    model = quality.RuleEnsemble(((low, 1.5), (quality.Rule((("shouts", 0.1, None),)), -2.0)), 0.25)
    got = {r.doc_id: r.score for r in stats.select("doc_id", model.column().alias("score")).collect()}
    for doc, text in rows:
        s = plain_statistics(text)
        margin = 0.25 + 1.5 * (1.0 < s["log_words"] <= 3.0 and s["spaces"] <= 0.4) - 2.0 * (s["shouts"] > 0.1)
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    for label in (0, 1):
        mine = [r.predicted == label for r in rows if r.quality == label]
        assert sum(mine) / len(mine) > 0.95


def test_only_labels_outside_the_fold_are_learned(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.in_fold(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda t: sorted(map(tuple, quality.classify(docs.drop("lang", "source"), t).collect()))
    assert score(labels) == score(turned)


def test_odd_rows_and_labels(spark):
    docs = plain.with_clashes(plain.documents(spark, plain.odd_rows()))
    none = spark.createDataFrame([], LABELS)
    rows = quality.classify(docs, none).collect()
    assert len(rows) == len(plain.odd_rows()) and {r.score for r in rows} == {0.5}
    assert quality.classify(plain.documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 1), (None, 0), (4, None), (6, 7)], LABELS)
    assert {round(r.score, 6) for r in quality.classify(docs, one).collect()} == {round(4.5 / 5, 6)}
    mixed = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 19)] * 3, LABELS).withColumn("text", F.lit("clash")).withColumn("n", F.lit(1))
    rows = quality.classify(docs, mixed).collect()
    assert len(rows) == len(plain.odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_sample_is_bounded_and_weighted(spark):
    docs = plain.documents(spark, [(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 1)] * 30, LABELS)
    sample = quality.labelled_sample(quality.statistics(docs), labels, 20)
    assert sample.count() == 20
    assert quality.labelled_sample(quality.statistics(docs), labels, 100).agg(F.max("weight")).collect()[0][0] == 10
