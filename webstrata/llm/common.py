"""What the operators share: Arrow batches of bounded size, byte views of texts, rules of the data contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch. Texts can be long, so batches are small; operators gather them up to a byte bound.
BATCH_ROWS = 500
#: Bytes of text that a task works on at once.
BLOCK_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def picked(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others, clashing names included, never reach an operator's plan."""
    prepare(docs.sparkSession)
    return docs.select(*(F.col(c) for c in columns))


#: Columns of documents; others travel as one struct, so that no name of theirs can clash with an operator's.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def bundled(docs: DataFrame) -> DataFrame:
    own = [c for c in DOCUMENT if c in docs.columns]
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")) if rest else docs


def unbundled(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` in their order."""
    return df.select(*(F.col(c) if c in DOCUMENT else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches gathered until their texts exceed `size` bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        n += b.column(text).nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def by_block(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str | StructType, text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """mapInArrow over blocks of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, size):
            yield from pa.Table.to_batches(f(block))

    return df.mapInArrow(run, schema)


#: Rows of one key that a task of a spread join takes; where there are more than SPREAD_KEYS times as many rows, more.
SPREAD_ROWS = 1_000
SPREAD_KEYS = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, key, how) with the rows of frequent keys of `left` dealt to several tasks, by the hash of the columns `by`.

    right's rows of such keys go to each of these tasks. Frequent keys are at most SPREAD_KEYS by definition, so they may be
    collected and broadcast. counts: (key, n) of left, if known."""
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(SPREAD_ROWS, total // SPREAD_KEYS)
    hot = counts.where((F.col("n") > most) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / F.lit(most)).cast("int").alias("_tasks")).collect()
    if not hot:
        return left.join(right, key, how)
    table = F.broadcast(left.sparkSession.createDataFrame(hot, f"{key} {left.schema[key].dataType.simpleString()}, _tasks int"))
    tasks = F.coalesce("_tasks", F.lit(1))
    dealt = left.join(table, key, "left").withColumn("_task", F.pmod(F.xxhash64(*by), tasks).cast("int")).drop("_tasks")
    copied = right.join(table, key, "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    return dealt.join(copied, [key, "_task"], how).drop("_task")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all rows, one row after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
