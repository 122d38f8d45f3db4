"""Breadth-first crawl of a link graph, one level a round, in the order of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.functions.robots import robots_gate
from webstrata.functions.urls import parse_url
from webstrata.sources.tables import discard, materialise


def crawl(spark: SparkSession, edges: DataFrame, start: str, depth: int = 1, max_pages: int = 50,
          same_domain: bool = False, rules: DataFrame | None = None) -> DataFrame:
    """(rank, url, depth, allowed): pages in visiting order.

    edges (src, pos, dst) hold normalised URLs. At most max_pages are visited, those that robots rules stop
    included; at most 4 * max_pages are ever queued. Both bounds keep a level small; they are the crawl's own
    parameters, and ordering a level needs no more rows than that. Each level is written to shared storage."""
    edges = materialise(edges.select("src", "pos", "dst"), "edges")  # read in every level: pages are not parsed again
    seed = spark.range(1).select(F.lit(0).alias("rank"), F.lit(start).alias("url"), F.lit(0).alias("depth"))
    queued = materialise(seed, "crawl")
    level, total = queued, 1
    host = spark.range(1).select(parse_url(F.lit(start))["host"].alias("h")).first()["h"]
    for d in range(1, depth + 1):
        if same_domain or rules is not None:
            parts = level.withColumn("_u", parse_url(F.col("url")))
            if rules is not None:
                gated = robots_gate(parts.select("rank", "url", F.col("_u.host").alias("host"), F.col("_u.path").alias("path")), rules)
                level = gated.where(F.col("allowed") | (F.col("host") != host)).select("rank", "url")
        found = F.broadcast(level.where(F.col("rank") < max_pages).select(F.col("rank").alias("_r"), F.col("url").alias("src"))).join(edges, "src")
        if same_domain:
            found = found.where(parse_url(F.col("dst"))["host"] == host)
        first = found.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("_r", "pos")).alias("at"))
        fresh = first.join(queued.select("url"), "url", "left_anti").orderBy("at", "url").limit(max_pages * 4 - total)
        w = Window.orderBy("at", "url")
        fresh = fresh.select((F.row_number().over(w) + total - 1).cast("int").alias("rank"), "url", F.lit(d).alias("depth"))
        level = materialise(fresh, "crawl")
        n = level.count()
        if n == 0:
            break
        total += n
        queued = materialise(queued.unionByName(level), "crawl")
        if total >= max_pages * 4:
            break
    discard(edges)
    out = queued.where(F.col("rank") < max_pages).withColumn("_u", parse_url(F.col("url")))
    out = out.select("rank", "url", "depth", F.col("_u.host").alias("host"), F.col("_u.path").alias("path"))
    if rules is None:
        return out.select("rank", "url", "depth", F.lit(True).alias("allowed"))
    gated = robots_gate(out, rules)
    return gated.select("rank", "url", "depth", (F.col("allowed") | (F.col("host") != host)).alias("allowed"))
