"""robots.txt: rules of the groups for `*` and for one agent, and the path test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT = "webstrata"


def robots_rules(bodies: DataFrame, agent: str = AGENT, host: str = "host", body: str = "body") -> DataFrame:
    """(host, disallow, crawl_delay_ms) for every host. A User-agent line starts a group for that name alone."""
    lines = bodies.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(body), r"[\r\n]+")).alias("pos", "raw"))
    text = F.regexp_replace(F.substring_index(F.col("raw"), "#", 1), r"^\s+|\s+$", "")
    lines = lines.select("host", "pos", text.alias("line")).where("instr(line, ':') > 0")
    key = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.regexp_replace(F.expr("substring(line, instr(line, ':') + 1)"), r"^\s+|\s+$", "")
    lines = lines.select("host", "pos", key.alias("key"), value.alias("value"))
    group = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True)
    lines = lines.withColumn("group", group.over(Window.partitionBy("host").orderBy("pos")))
    mine = lines.where(F.col("group").isin("*", agent.lower()))
    delay = F.regexp_extract("value", r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    rules = mine.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when((F.col("key") == "disallow") & (F.col("value") != ""), F.struct("pos", "value")))).alias("r"),
        F.min_by(
            F.when((F.col("key") == "crawl-delay") & (delay > 0), (delay * 1000).cast("int")),
            F.when((F.col("key") == "crawl-delay") & (delay > 0), F.col("pos")),
        ).alias("delay"),
    )
    return (
        bodies.select(F.col(host).alias("host")).distinct().join(rules, "host", "left")
        .select(
            "host",
            F.coalesce(F.col("r.value"), F.array().cast("array<string>")).alias("disallow"),
            F.coalesce("delay", F.lit(0)).alias("crawl_delay_ms"),
        )
    )


def robots_allowed(path: Column, disallow: Column) -> Column:
    """True unless a rule is a literal prefix of the path; no rules allow all."""
    return F.coalesce(~F.exists(disallow, lambda r: F.startswith(path, r)), F.lit(True))


def robots_gate(pages: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """pages with a column `allowed`; hosts without rules are open."""
    return (
        pages.join(rules.select(F.col("host").alias(host), "disallow"), host, "left")
        .withColumn("allowed", robots_allowed(F.col(path), F.col("disallow"))).drop("disallow")
    )
