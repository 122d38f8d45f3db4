"""Reading history: show, log, diff, list."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webstrata.functions.rows import row_udf
from webstrata.operators.store import as_of


def show(captures: DataFrame, md_path: str, commit_seq: int | None = None, form: str = "md") -> DataFrame:
    """One file of one path at a commit; an unknown form means Markdown. The path filter reaches the scan."""
    column = {"html": "html_gz", "gz": "html_gz", "json": "metadata"}.get(form, "markdown")
    state = as_of(captures.where(F.col("md_path") == md_path), commit_seq)
    return state.select("md_path", "commit_seq", F.col(column).alias("data"))


def change_log(captures: DataFrame, md_path: str | None = None, limit: int | None = None) -> DataFrame:
    """Commits that changed a path, newest first, with lines before and after."""
    rows = captures if md_path is None else captures.where(F.col("md_path") == md_path)
    w = Window.partitionBy("branch", "md_path").orderBy("commit_seq")
    # Only ids and line counts are shuffled, never the documents.
    rows = rows.select("branch", "md_path", "commit_seq", "md_sha", F.size(F.split("markdown", "\n")).alias("lines"))
    rows = rows.withColumn("before", F.lag("md_sha").over(w)).withColumn("lines_before", F.coalesce(F.lag("lines").over(w), F.lit(0)))
    changed = rows.where("before is null or before <> md_sha")
    out = changed.select("branch", "md_path", "commit_seq", "md_sha", "lines", "lines_before").orderBy(F.desc("commit_seq"), "md_path")
    return out if limit is None else out.limit(limit)


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(md_path, added, removed): lines, as multisets, that one version has and the other has not."""
    def lines(df: DataFrame, sign: int) -> DataFrame:
        return df.select("md_path", F.explode(F.split("markdown", "\n")).alias("line"), F.lit(sign).alias("n"))

    net = lines(after, 1).unionByName(lines(before, -1)).groupBy("md_path", "line").agg(F.sum("n").alias("n"))
    return net.groupBy("md_path").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed")
    )


def hunks(texts: dict[str, str | None]) -> str:
    a, b = ((texts[c] or "").splitlines() for c in ("before", "after"))
    return "\n".join(list(difflib.unified_diff(a, b, lineterm="", n=3))[2:])


_hunks = row_udf(hunks, StringType())


def unified_hunks(before: str, after: str) -> Column:
    return _hunks(F.struct(F.col(before).alias("before"), F.col(after).alias("after")))


def diff(captures: DataFrame, md_path: str, newer: int, older: int | None = None) -> DataFrame:
    """Unified diff of a path between two commits; without `older`, against the commit before `newer`."""
    one = captures.where(F.col("md_path") == md_path)
    a = as_of(one, newer - 1 if older is None else older).select("branch", F.col("markdown").alias("a"))
    b = as_of(one, newer).select("branch", F.col("markdown").alias("b"))
    return a.join(b, "branch", "full").select("branch", F.lit(md_path).alias("md_path"), unified_hunks("a", "b").alias("hunks"))


def list_archived(captures: DataFrame) -> DataFrame:
    return as_of(captures).where(F.contains("md_path", F.lit("/index.md"))).select("branch", "md_path", "commit_seq")
