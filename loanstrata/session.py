"""Session settings and the two ways a frame is pinned between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_ROWS = 100_000
# Values of a look-up table that the driver may hold: rows times columns.
LOOKUP_VALUES = 1_000_000
PINNED: list[str] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loanstrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Recording the Python call site of every column expression costs more than small queries take.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which driver and executors share.

    Only a local master, where all run on one machine, may leave it unset; it then gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loanstrata-"))
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Writes a frame that several later jobs read, and returns the written table.

    Parquet in the shared folder survives the loss of executors, cuts the lineage, and lets each later job read only
    the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    PINNED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, spread over all of them ahead of heavy work per row; others as they are.

    For frames read straight from storage, where the number of splits is known without running anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def release_pins(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the tables written by `pin`, all but the first `keep`, once no frame built on them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while len(PINNED) > keep:
        path = jvm.org.apache.hadoop.fs.Path(PINNED.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def small_table(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame | None:
    """The rows of `df` as a local relation, or None when there are more than `max_rows`.

    `limit` bounds what reaches the driver, so the check is safe on a frame of any size. Every caller passes an
    aggregate, which is reduced on the executors before the limit applies.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row, as literals instead of a join; nulls when it is empty."""
    rows = one.limit(1).collect()
    return df.withColumns({f.name: F.lit(rows[0][f.name] if rows else None).cast(f.dataType) for f in one.schema.fields})


def join_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Joins an aggregate back to the rows it came from, nulls in the keys matching.

    The aggregate is broadcast once a bounded read has shown it to be small. Beyond the bound both sides are
    shuffled on the keys, and adaptive execution splits hot ones.
    """
    renamed = lookup
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_{key}")
    held = small_table(renamed, min(max_rows, LOOKUP_VALUES // max(1, len(renamed.columns))))
    right = renamed if held is None else F.broadcast(held)
    condition: Column | None = None
    for key in keys:
        term = df[key].eqNullSafe(right[f"_{key}"])
        condition = term if condition is None else condition & term
    return df.join(right, condition, how).drop(*[f"_{key}" for key in keys])
