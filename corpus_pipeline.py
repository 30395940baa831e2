"""The corpus pipeline: language identification, near-duplicate removal, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, folder) and returns a DataFrame; `run` writes each result as Parquet in the shared
folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanstrata.llm import bpe, decontaminate, jaccard, language, substring
from loanstrata.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# The last stage hashes ids that come from the model; SQL has no byte-pair merges.
ORACLE_SQL: str | None = None


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; texts that are null or have no letter go."""
    return language.keep_known(docs, language.fit(docs.where(~language.in_fold())))


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The smallest doc_id of every group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard.keep_one(docs, 5, 8, 10)


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without runs of 20 words that already occurred; a text of which nothing is left goes with its row."""
    return substring.remove_repeats(docs, 20)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
