"""Reading, describing, sampling and writing tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statements accepted by `run_sql` and words that make it refuse one.
READ_PREFIXES = ("select", "with")
WRITE_WORDS = ("insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "replace into", "truncate",
               "vacuum", "reindex", "merge")
SQL_ROW_LIMIT = 2000


def ingest_csv(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header to parquet, replacing what was there."""
    spark.read.schema(schema).option("header", True).csv(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def check_read_only(query: str) -> str:
    """The statement, if it is a single SELECT or WITH without a writing word outside quoted text."""
    bare = query.strip().rstrip(";").strip()
    if not bare:
        raise ValueError("a query is required")
    plain = re.sub(r"'(?:[^']|'')*'", "''", bare).lower()
    if ";" in plain:
        raise ValueError("only one statement is allowed")
    if not plain.lstrip("( \n").startswith(READ_PREFIXES):
        raise ValueError("only SELECT and WITH statements are allowed")
    for word in WRITE_WORDS:
        if re.search(rf"\b{word}\b(?!\s*\()", plain):
            raise ValueError(f"the statement contains {word}")
    return bare


def run_sql(spark: SparkSession, query: str, limit: int = 200, **frames: DataFrame) -> DataFrame:
    """A read-only statement with its row limit held between 1 and 2000; `{name}` refers to a passed frame."""
    return spark.sql(check_read_only(query), **frames).limit(max(1, min(int(limit), SQL_ROW_LIMIT)))


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def table_rows(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of the session as rows; columns follow from `schema_rows` of each."""
    rows = [(t.name, t.database or (t.namespace[-1] if t.namespace else None), t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, kind string, temporary boolean")


def schema_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row per column: position, name, type, nullable, key flag."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, f.name == key) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean, is_key boolean")


def describe_table(df: DataFrame, dictionary: DataFrame, key: str | None = None) -> DataFrame:
    """Schema rows with the dictionary text of each column; names match without case and outer blanks.

    Adaptive execution picks the join: the schema side is one row per column.
    """
    texts = dictionary.select(F.lower(F.trim("field")).alias("_f"), "description").dropDuplicates(["_f"])
    columns = schema_rows(df, key)
    return columns.join(texts, F.lower(F.trim("name")) == F.col("_f"), "left").drop("_f")


def dictionary_summary(df: DataFrame, dictionary: DataFrame, first: int = 30) -> DataFrame:
    """How many columns the dictionary explains, and the first columns it does not."""
    described = describe_table(df, dictionary)
    missing = F.sort_array(F.collect_list(F.when(F.col("description").isNull(), F.col("name"))))
    return described.agg(
        F.count("description").alias("matched"),
        F.count(F.when(F.col("description").isNull(), 1)).alias("unmatched"),
        F.slice(missing, 1, first).alias("first_unmatched"))


def dictionary_gaps(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Columns without a text, and dictionary entries without a column; names match without case and outer blanks."""
    tidy = lambda c: F.lower(F.trim(c))
    columns, fields = schema_rows(df).select("name", tidy("name").alias("_n")), dictionary.select(F.trim("field").alias("name"), tidy("field").alias("_n"))
    bare = columns.join(fields.select("_n"), "_n", "left_anti").select(F.lit("undocumented").alias("kind"), "name")
    return bare.unionByName(fields.join(columns.select("_n"), "_n", "left_anti").select(F.lit("unused").alias("kind"), "name").distinct())


def random_sample(df: DataFrame, key: str, n: int = 100_000, seed: int = 42) -> DataFrame:
    """n rows in a repeatable random order of their key; 0 keeps all rows. A top-n: no full sort."""
    if n == 0:
        return df
    ticket = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return df.orderBy(ticket, key).limit(n)


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A Bernoulli sample: one narrow pass for when an exact size is not needed."""
    return df.sample(fraction=fraction, seed=seed)


def preview(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first rows by key; n is held between 1 and 200."""
    return df.orderBy(key).limit(max(1, min(int(n), 200)))


def table_info(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("columns", F.lit(df.columns))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column in one pass."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in df.columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def alignment(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Rows on each side and rows without a partner; features and targets agree when both latter are zero."""
    both = left.select(key, F.lit(1).alias("_l")).join(right.select(key, F.lit(1).alias("_r")), key, "full_outer")
    return both.agg(
        F.count("_l").alias("left_rows"), F.count("_r").alias("right_rows"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
