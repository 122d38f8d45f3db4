"""Links and assets of a page, by the JVM's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import asset_basename, parse_url, resolve_url

ANCHOR = r"(?i)<a\s([^>]*)>"
ASSET = r"(?i)(<(?:img|link)[^>]*)>"


def _value(tag: Column, name: str) -> Column:
    """Value of the first `name=` in a tag, quoted or bare."""
    pattern = rf"(?i){name}=\s*(?:\"([^\"]*)|'([^']*)|([^\s>\"'][^\s>]*))"
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def hrefs(html: Column) -> Column:
    """Usable link targets as written, in page order, repeats kept."""
    tags = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    values = F.transform(tags, lambda t: _value(t, "href"))
    return F.filter(
        values,
        lambda v: (v != "")
        & ~F.startswith(v, F.lit("#"))
        & ~F.startswith(v, F.lit("javascript:"))
        & ~F.startswith(v, F.lit("mailto:")),
    )


def outgoing_links(html: Column, base: Column) -> Column:
    """Resolved links in first-seen order without repeats; `base` is the parsed page URL."""
    return F.array_distinct(F.transform(hrefs(html), lambda v: resolve_url(base, v)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, pos, dst, dst_host): one row per link, both ends normalised, text that is no URL left out."""
    page = pages.select(parse_url(F.col(url)).alias("p"), F.col(html).alias("h")).where("p is not null")
    links = page.select(
        F.col("p.normalized_url").alias("src"), F.posexplode(outgoing_links(F.col("h"), F.col("p"))).alias("pos", "link")
    )
    out = links.withColumn("d", parse_url(F.col("link"))).where("d is not null")
    return out.select("src", "pos", F.col("d.normalized_url").alias("dst"), F.col("d.host").alias("dst_host"))


def page_assets(pages: DataFrame, limit: int = 16, same_host_only: bool = True, url: str = "url", html: str = "html") -> DataFrame:
    """(src, pos, asset_url, basename): assets of a page in order; at most `limit` (the feature's own bound) a page."""
    page = pages.select(parse_url(F.col(url)).alias("p"), F.col(html).alias("h")).where("p is not null")
    tags = F.regexp_extract_all(F.col("h"), F.lit(ASSET), F.lit(1))

    def target(t: Column) -> Column:
        src = _value(t, "src")
        return F.when(src != "", src).otherwise(_value(t, "href"))

    found = F.filter(F.transform(tags, target), lambda v: v != "")
    parsed = F.filter(
        F.transform(found, lambda v: parse_url(resolve_url(F.col("p"), v))),
        lambda a: a.isNotNull() & ((a["host"] == F.col("p.host")) if same_host_only else F.lit(True)),
    )
    return page.select(
        F.col("p.normalized_url").alias("src"), F.posexplode(F.slice(parsed, 1, limit)).alias("pos", "a")
    ).select("src", "pos", F.col("a.normalized_url").alias("asset_url"), asset_basename(F.col("a.normalized_url")).alias("basename"))
