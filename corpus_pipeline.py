"""From raw documents to packed token sequences, one operator a stage, each stage's rows written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import decontam, neardup, packing, pii, quality
from webstrata.sources.tables import materialise, table

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", neardup.stage),
    ("decontamination", decontam.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]

#: SQL expresses neither signatures, suffix arrays nor a tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
