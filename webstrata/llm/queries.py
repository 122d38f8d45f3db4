"""Queries of this package by operator number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import classifier, decontam, extraction, lm, neardup, packing, pii, quality, quotes, sharding
from webstrata.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "op1_katz_backoff": lambda s, d: lm.op1(s, table(s, d, "documents")),
    "op2_probminhash": lambda s, d: neardup.op2(s, table(s, d, "documents")),
    "op3_quality_rules": lambda s, d: quality.op3(s, table(s, d, "documents")),
    "op4_virtual_slots": lambda s, d: sharding.op4(s, table(s, d, "documents")),
    "op5_wrapper_induction": lambda s, d: extraction.op5(s, table(s, d, "pages")),
    "op6_quotation_linking": lambda s, d: quotes.op6(s, table(s, d, "conversations")),
    "op7_weak_supervision": lambda s, d: pii.op7(s, table(s, d, "documents")),
    "op8_online_packing": lambda s, d: packing.op8(s, table(s, d, "documents")),
    "op9_suffix_arrays": lambda s, d: decontam.op9(s, table(s, d, "documents"), table(s, d, "benchmark")),
    "op10_subword_embeddings": lambda s, d: classifier.op10(s, table(s, d, "documents"), table(s, d, "labels")),
}
SQL: dict[str, str] = {"op6_quotation_linking": quotes.SQL}
