"""The registered queries of the training-data operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanstrata.llm import bpe, conversations, decontaminate, hosts, jaccard, katz, language, negatives, quality, shards, substring, vectors, warc
from loanstrata.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op2_katz_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_documents(table(spark, folder, "documents"))


@query(r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k,
  unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda a: w[a:a + least(len(w), 5) - 1])) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda a: w[a:a + k - 1])) AS s
  FROM dw, sizes WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i ON d.k = i.k AND d.s = i.s GROUP BY ALL)
SELECT doc_id, m.item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM m JOIN n ON m.item_id = n.item_id WHERE n_shared >= 0.8 * n_item
""")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op1_pq_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query()
def op4_host_trust(spark: SparkSession, folder: str) -> DataFrame:
    return hosts.judge(table(spark, folder, "pages"))


@query()
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT html, max(page_id) AS kept FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN d ON p.html = d.html
""")
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_archives(spark, archives).drop("url")


@query()
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.removal_report(table(spark, folder, "documents"))


@query()
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = language.fit(docs.where(~language.in_fold()))
    return language.predict(docs, learned).withColumn("held_out", language.in_fold())


@query()
def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"), 3, 90, 100)


@query()
def op10_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_documents(table(spark, folder, "documents"), 16)


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
""")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings").withColumn("label", shifted))


@query()
def op12_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audit_damaged(table(spark, folder, "conversations"))
