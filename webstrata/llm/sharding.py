"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into SLOTS virtual slots, which never change. Bytes are summed per slot; a stored map gives each slot a
shard. Version 1 deals the slots in turn; each rebalancing loads the latest version, moves or swaps slots until shards weigh about the same, and
stores the edited map as the next version, so most slots stay where they are.

An id with very many records (HOT times a slot's mean) would outweigh its slot: its records hash by their place in the measured table as well.
Slots with many records are numbered in parts by tasks of their own.

Defined cases: a null text has no bytes and the crc of the empty text; records with a null id hash by text;
equal records are kept, each in a place of its own; ties in the order of records fall by place in the measured table; very long texts count by their bytes;
an empty table gives a map and no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.llm.common import picked
from webstrata.sources.tables import discard, materialise

SLOTS = 4096
SHARDS = 24
#: Rows of a virtual slot that one task numbers; slots with more are split into parts.
PART_ROWS = 20_000
#: An id with so many times the records of a mean slot is spread; there are at most SLOTS / HOT of them.
HOT = 4
#: Difference of the heaviest and the lightest shard, of the mean, that rebalancing stops at.
TOLERANCE = 0.0002
MAP_SCHEMA = "map_version int, virtual_slot int, shard int, bytes long"


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, h, virtual_slot) of each record."""
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), text))
    out = picked(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("h")
    )
    return out.withColumn("virtual_slot", F.pmod("h", F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot; at most `slots` numbers come to the driver."""
    found = {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    return [found.get(k, 0) for k in range(slots)]


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [k % shards for k in range(slots)]


def rebalanced(current: list[int], weights: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """An edited map. Slots of shards that are gone move first; then the heaviest shard gives the lightest that slot, or changes that
    pair of slots with it, which comes nearest to levelling both, until they are within the tolerance or no change helps."""
    w, out = np.array(weights, np.int64), np.array(current, np.int64)
    loads = np.bincount(out, weights=w, minlength=shards).astype(np.int64)
    for k in sorted(np.flatnonzero(out >= shards), key=lambda k: (-w[k], k)):
        out[k] = np.argmin(loads[:shards])
        loads[out[k]] += w[k]
    loads = loads[:shards]
    mean = loads.mean() if shards else 0
    for _ in range(4 * len(out)):
        high, low = int(np.argmax(loads)), int(np.argmin(loads))
        gap = loads[high] - loads[low]
        if gap <= tolerance * mean:
            break
        own, other = np.flatnonzero(out == high), np.append(np.flatnonzero(out == low), -1)  # -1: nothing in return
        gain = w[own][:, None] - np.append(w[other[:-1]], 0)[None, :]
        miss = np.where((gain > 0) & (gain < gap), np.abs(2 * gain - gap), gap)
        i, j = np.unravel_index(int(np.argmin(miss)), miss.shape)
        if miss[i, j] >= gap:
            break
        out[own[i]] = low
        if other[j] >= 0:
            out[other[j]] = high
        loads[high] -= gain[i, j]
        loads[low] += gain[i, j]
    return out.tolist()


def save_map(spark: SparkSession, path: str, version: int, shards: list[int], weights: list[int]) -> None:
    """Add a version to the map's table; older versions stay."""
    rows = [(version, k, s, w) for k, (s, w) in enumerate(zip(shards, weights, strict=True))]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """0 if there is no map yet."""
    try:
        return spark.read.schema("v int").option("basePath", path).parquet(path).agg(F.max("v")).first()[0] or 0
    except AnalysisException:
        return 0


def spread_ids(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows with h of very frequent ids made from the row's place in the stored table, which tasks that run again find unchanged."""
    per_id = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = per_id.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = per_id.where(F.col("n") > max(PART_ROWS, HOT * total // slots)).select("h").collect()  # at most slots / HOT rows
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    if not hot:
        return rows.withColumn("place", place)
    table = F.broadcast(rows.sparkSession.createDataFrame(hot, "h long").withColumn("hot", F.lit(True)))
    rows = rows.withColumn("place", place).join(table, "h", "left")
    rows = rows.withColumn("h", F.when(F.col("hot"), F.xxhash64("h", "place")).otherwise(F.col("h"))).drop("hot")
    return rows.withColumn("virtual_slot", F.pmod("h", F.lit(slots)).cast("int"))


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with shard and position in the shard, gapless from 0.

    Positions run over the virtual slots of a shard, and in each slot over its parts; a part is numbered by one
    task. Offsets of the parts are few rows: a row for each slot, and for each PART_ROWS records."""
    per_slot = rows.groupBy("virtual_slot").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    known = F.broadcast(slot_map.select("virtual_slot", "shard", "map_version").join(per_slot, "virtual_slot"))  # a row a slot
    rows = rows.join(known, "virtual_slot").withColumn("part", F.pmod(F.shiftrightunsigned("h", 16), F.col("parts")).cast("int")).drop("parts")
    counts = rows.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("h", "doc_id", "text_crc32", "size", "place")
    numbered = rows.withColumn("i", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("i")).alias("slot"), "virtual_slot", "map_version"
    )


def shard(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """Measure, weigh the slots, edit the map stored under `path` (begun there if there is none), place the records. The law is `bytes`."""
    spark = docs.sparkSession
    measured_rows = materialise(measured(docs), "slots")
    rows = materialise(spread_ids(measured_rows), "slots")
    path = path or f"{rows._stored_at}-map"
    weights = slot_bytes(rows)
    version = latest_version(spark, path)
    if version == 0:
        version = 1
        save_map(spark, path, version, first_map(shards=shards), weights)
    now = [r["shard"] for r in load_map(spark, path, version).orderBy("virtual_slot").collect()]  # a row a slot
    edited = rebalanced(now, weights, shards)
    if edited != now:
        version += 1
        save_map(spark, path, version, edited, weights)
    discard(measured_rows)
    return placed(rows, load_map(spark, path, version))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version",
    )
