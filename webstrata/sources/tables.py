"""Tables of a data folder, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs up to this size are dealt to all cores before work that is heavy for each row.
SMALL_BYTES = 1 << 30


def spread_out(df: DataFrame) -> DataFrame:
    """A small input in as many partitions as there are cores: a file of one row group is one task otherwise. Larger inputs, and those
    of as many files as cores, stay as they are read, so the shuffle is never of more than SMALL_BYTES."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if size > SMALL_BYTES or len(df.inputFiles()) >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset, on a single machine (tests), a local one is made up."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


#: Parquet for rows of megabytes: sizes are checked at each row, not at each 100 rows, so that writers and readers hold a few rows at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def materialise(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Write a table once to shared storage and read it back: later steps reread it when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # once the table is written, the shuffles behind it have served
    try:
        df.write.option("compression", codec).options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote; nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(conf).delete(path, True)
