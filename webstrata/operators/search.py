"""Ranked search over tree paths: bounded heaps in each task, one merge of the tops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.fuzzy import SEARCH_THRESHOLD, similarity, similarity_udf


def scored(paths: DataFrame, query: str, fuzzy: bool = False, path: str = "path") -> DataFrame:
    """All matches with their scores."""
    c = F.col(path)
    if fuzzy:
        # A score costs far more than its path's shuffle; without this, small partitions of paths are merged into few tasks.
        paths = paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # As a generator the score is computed once a row; a filter over it would be pushed below and compute it again.
        good = F.filter(F.array(similarity(query, c)), lambda x: x >= SEARCH_THRESHOLD)
        return paths.select(*paths.columns, F.explode(good).alias("score"))
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return paths.where(F.contains(low(c), low(F.lit(query)))).withColumn("score", F.lit(1.0))


def search(paths: DataFrame, query: str, fuzzy: bool = False, top: int = 50, path: str = "path", spans: bool = False) -> DataFrame:
    """The best `top` paths, score then path deciding; spans are found for those alone."""
    best = scored(paths, query, fuzzy, path).orderBy(F.desc("score"), F.asc(path)).limit(top)
    return best.withColumn("span", similarity_udf(query)(F.col(path))) if spans else best


def match_count(paths: DataFrame, query: str, fuzzy: bool = False, path: str = "path") -> DataFrame:
    return scored(paths, query, fuzzy, path).agg(F.count("*").alias("matches"))
