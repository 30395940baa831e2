"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents.

Only DataFrame operations. Items are partitioned by size class (powers of two); an item's signature is its smallest
shingle hashes, as many as its class needs: an item of at most u shingles of which a document lacks at most
floor((1 - t) u) must share one of its floor((1 - t) u) + 1 smallest. So the search loses nothing however long the
document is, where a plain Jaccard estimate would fade with its length. Candidates are then verified by the exact
share of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
# Item shingles that may be broadcast: 16 to 40 bytes each, so 80 MB at most. Beyond it the join is shuffled.
BROADCAST_SHINGLES = 2_000_000


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `_words`, the lower-cased runs of letters and digits (none for null text)."""
    raw = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    cut = df.withColumn("_raw", raw)
    # Only the first and the last part can be empty.
    lead = (F.get("_raw", F.lit(0)) == "").cast("int")
    tail = ((F.get("_raw", F.size("_raw") - 1) == "") & (F.size("_raw") > 1)).cast("int")
    return cut.withColumn("_words", F.slice("_raw", lead + 1, F.size("_raw") - lead - tail)).drop("_raw")


def shingles(words: str, size: int) -> Column:
    """Hashes of all runs of `size` words, with repeats; empty for shorter lists."""
    n = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), run)).otherwise(F.array().cast("array<bigint>"))


def item_index(items: DataFrame, key: str, containment: float = CONTAINMENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per item and distinct shingle: words per shingle (`k`), item size, and whether it is in the signature.

    An item shorter than `size` words is one shingle of all its words; an item without words has no row. Rows with
    the same item key are taken together.
    """
    worded = with_words(items.select(F.col(key).alias("item_id"), F.col("text").cast("string").alias("text")))
    worded = worded.withColumn("k", F.least(F.size("_words"), F.lit(size))).where("k > 0")
    listed = F.lit(None).cast("array<bigint>")
    for k in range(1, size + 1):
        listed = F.when(F.col("k") == k, shingles("_words", k)).otherwise(listed)
    rows = worded.select("item_id", "k", F.explode(listed).alias("h")).distinct()
    whole = Window.partitionBy("item_id")
    counted = rows.withColumns({"n_item": F.count(F.lit(1)).over(whole),
                                "_rank": F.row_number().over(whole.orderBy(F.xxhash64("h"), "k"))})
    # The partition's upper size, a power of two, sets the length of the signature.
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double"))))
    length = F.floor(upper * (1 - containment) + 1e-9) + 1
    return counted.select("item_id", "k", "h", "n_item", (F.col("_rank") <= length).alias("in_signature"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least `containment` of the item's distinct shingles.

    Columns: doc_id, item_id, n_shared, n_item, containment. Whole texts are searched, case and punctuation aside.
    Null or empty texts, on either side, match nothing; rows with the same doc_id count as one document; other
    columns are not read. The document side is never shuffled: its shingles meet the broadcast item index in place,
    and only matches are grouped.
    """
    index = item_index(items, "item_id", containment, size)
    known = {r["k"]: r["n"] for r in index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(known.values()) <= BROADCAST_SHINGLES
    worded = with_words(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "_words")
    found = None
    for k in sorted(known) or [size]:
        hashes = worded.select("doc_id", F.explode(shingles("_words", k)).alias("_h"))
        side = index.where(F.col("k") == k)
        side = F.broadcast(side) if small else side
        hit = hashes.join(side, hashes["_h"] == side["h"]).select("doc_id", "item_id", "h", "n_item", "in_signature")
        found = hit if found is None else found.unionByName(hit)
    once = found.groupBy("doc_id", "item_id", "h").agg(F.first("n_item").alias("n_item"), F.first("in_signature").alias("in_signature"))
    pairs = once.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_item").alias("n_item"),
                                                  F.max("in_signature").alias("_candidate"))
    candidates = pairs.where("_candidate").drop("_candidate")
    return candidates.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(
        F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9)


def remove_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """Documents that hold no item, all columns kept; rows with a null doc_id stay."""
    found = contaminated(docs, items, containment, size).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")
