"""The version store: append-only captures, states of any version, content-addressed blobs, compaction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from webstrata.functions.extract import outgoing_links, page_assets
from webstrata.functions.markdown import html_to_markdown, to_markdown
from webstrata.functions.metadata import blob_sha, commit_message, compressed, gzip_bytes, metadata_json, stored_etag
from webstrata.functions.rows import row_udf
from webstrata.functions.sanitize import sanitize_html
from webstrata.functions.urls import parse_url, storage_paths
from webstrata.sources.tables import materialise

BRANCH = "main"


def texts(page: dict[str, str | None]) -> dict[str, str | bytes | None]:
    return {"markdown": to_markdown(page["sanitized"]), "html_gz": compressed(page["html"])}


_texts = row_udf(texts, StructType().add("markdown", StringType()).add("html_gz", BinaryType()))


def ingest(pages: DataFrame, branch: str = BRANCH, with_gzip: bool = True, with_markdown: bool = True, together: bool = False) -> DataFrame:
    """Captures from pages (url, html, commit_seq, committed_at): paths, clean text, Markdown, links, metadata.

    Text that is no URL is left out. The Markdown UDF runs once, after the native columns. together: one Python worker a task makes
    Markdown and gzip, for callers that read both; else each has a worker of its own, and one that is not read is not made."""
    p = pages.withColumn("u", parse_url(F.col("url"))).where("u is not null").withColumn("s", storage_paths(F.col("u")))
    p = p.withColumn("sanitized", sanitize_html(F.col("html"))).withColumn("links", outgoing_links(F.col("sanitized"), F.col("u")))
    if together and with_gzip and with_markdown:
        p = p.withColumn("t", _texts(F.struct("sanitized", "html"))).withColumns({"markdown": F.col("t.markdown"), "html_gz": F.col("t.html_gz")})
    else:
        p = p.withColumn("markdown", html_to_markdown("sanitized") if with_markdown else F.lit(""))
        p = p.withColumn("html_gz", gzip_bytes("html") if with_gzip else F.lit(None).cast("binary"))
    md_bytes = F.octet_length("markdown")
    etag = F.coalesce("etag", F.lit("")) if "etag" in pages.columns else None
    meta = metadata_json(F.col("u.normalized_url"), F.col("html"), md_bytes, F.col("committed_at"), etag=etag)
    return p.select(
        F.lit(branch).alias("branch"), "commit_seq", "committed_at", F.col("u.normalized_url").alias("url"),
        F.col("u.host").alias("host"), F.col("s.md_path").alias("md_path"), F.col("s.gz_path").alias("gz_path"),
        F.col("s.json_path").alias("json_path"), F.col("html").alias("raw_html"), "markdown", "links",
        "html_gz", meta.alias("metadata"),
        blob_sha(F.col("markdown")).alias("md_sha"), F.octet_length("html").cast("long").alias("raw_bytes"),
        md_bytes.cast("long").alias("markdown_bytes"),
    )


def append_captures(captures: DataFrame, path: str, batch_id: int | None = None) -> None:
    """One transaction: a batch of captures. With a batch id, writing it again replaces it."""
    if batch_id is None:
        captures.write.mode("append").partitionBy("branch").parquet(path)
    else:
        captures.write.mode("overwrite").partitionBy("branch").parquet(f"{path}/batch={batch_id}")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_of(captures: DataFrame, commit_seq: int | None = None, key: str = "md_path") -> DataFrame:
    """State of the tree at a commit (None: now): the last version of each path.

    Keys and commit numbers alone are aggregated; the captures themselves, documents included, meet them in one join."""
    seen = captures if commit_seq is None else captures.where(F.col("commit_seq") <= commit_seq)
    newest = seen.groupBy("branch", key).agg(F.max("commit_seq").alias("commit_seq"))
    state = seen.join(newest, ["branch", key, "commit_seq"], "left_semi")
    return state.dropDuplicates(["branch", key]).select("branch", key, *(c for c in seen.columns if c not in ("branch", key)))


def unchanged_skipped(captures: DataFrame, key: str = "md_path", content: str = "md_sha") -> DataFrame:
    """Without captures whose content equals the path's version before."""
    w = Window.partitionBy("branch", key).orderBy("commit_seq")
    return captures.withColumn("_before", F.lag(content).over(w)).where(
        "_before is null or _before <> " + content
    ).drop("_before")


def blobs(captures: DataFrame) -> DataFrame:
    """(sha, bytes, refs): every distinct content once."""
    return captures.groupBy(F.col("md_sha").alias("sha")).agg(F.first("markdown_bytes").alias("bytes"), F.count("*").alias("refs"))


def new_blobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.dropDuplicates(["sha"]).join(stored.select("sha"), "sha", "left_anti")


def tree_entries(captures: DataFrame) -> DataFrame:
    """(path, md_path, commit_seq): three files for each live path."""
    state = as_of(captures).select("md_path", "gz_path", "json_path", "commit_seq")
    files = F.explode(F.array("md_path", "gz_path", "json_path")).alias("path")
    return state.select(files, "md_path", "commit_seq")


def update_ref(refs: DataFrame, name: str, new_seq: int, old_seq: int | None = None) -> DataFrame:
    """Compare-and-swap on a table of refs (name, commit_seq): a stale `old_seq` leaves it as it was."""
    free = F.lit(True) if old_seq is None else F.col("commit_seq") == old_seq
    moved = refs.withColumn("commit_seq", F.when((F.col("name") == name) & free, F.lit(new_seq)).otherwise(F.col("commit_seq")))
    if old_seq is not None:
        return moved
    fresh = refs.sparkSession.createDataFrame([(name, new_seq)], refs.select("name", "commit_seq").schema)
    return moved.unionByName(fresh.join(refs.select("name"), "name", "left_anti").select("name", "commit_seq"))


def compact(captures: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite a store into few files, rows of a path together. Ranges of paths split a large host over many tasks."""
    captures.repartitionByRange("branch", "md_path", "commit_seq").sortWithinPartitions("branch", "md_path", "commit_seq").write.mode("overwrite").option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy("branch").parquet(path)


def prune_blobs(blob_table: DataFrame, captures: DataFrame) -> DataFrame:
    """Blobs that some capture still refers to."""
    return blob_table.join(captures.select(F.col("md_sha").alias("sha")).distinct(), "sha", "left_semi")


COMMITS = "branch string, commit_seq long, tree string, parent long, message string, committed_at timestamp, author string"
REFS = "name string, commit_seq long"
AUTHOR = "webstrata <archive@localhost>"
EMPTY_MESSAGE = "snapshot"


def commits(captures: DataFrame, message: str | None = None) -> DataFrame:
    """(branch, commit_seq, tree, parent, message, committed_at, author): one commit a capture. The tree is the id of what the commit
    adds; the parent is the commit before it on the branch. A message of one's own serves all commits, an empty one becomes a fixed text."""
    w = Window.partitionBy("branch").orderBy("commit_seq")
    text = commit_message(F.col("url"), F.col("markdown_bytes")) if message is None else F.lit(message or EMPTY_MESSAGE)
    tree = F.sha1(F.concat_ws("\n", F.concat_ws(" ", "md_sha", "md_path"), F.concat_ws(" ", F.sha1(F.col("metadata").cast("binary")), "json_path")).cast("binary"))
    rows = captures.select("branch", "commit_seq", tree.alias("tree"), text.alias("message"), "committed_at")
    return rows.select("branch", "commit_seq", "tree", F.lag("commit_seq").over(w).alias("parent"), "message", "committed_at", F.lit(AUTHOR).alias("author"))


def init_store(spark: SparkSession, root: str, captures: DataFrame | None = None) -> None:
    """Tables of an empty store; what exists is left as it is."""
    for name, schema in (("commits", COMMITS), ("refs/v=0", REFS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
    if captures is not None:
        captures.limit(0).write.mode("ignore").partitionBy("branch").parquet(f"{root}/captures")


def refs(spark: SparkSession, root: str) -> DataFrame:
    """(name, commit_seq) as last written: refs are whole small tables, one a version."""
    every = spark.read.schema(REFS + ", v int").option("basePath", f"{root}/refs").parquet(f"{root}/refs")
    newest = every.agg(F.max("v")).first()[0]
    return every.where(F.col("v") == newest).drop("v") if newest is not None else every.drop("v")


def ref_commit(spark: SparkSession, root: str, name: str) -> int | None:
    """The commit a branch stands at, None if there is no such branch."""
    row = refs(spark, root).where(F.col("name") == name).first()
    return None if row is None else row["commit_seq"]


def save_ref(spark: SparkSession, root: str, name: str, new_seq: int, old_seq: int | None = None) -> bool:
    """Compare-and-swap by creating the next version of the refs; false if the branch stands elsewhere or another writer came first."""
    now = refs(spark, root)
    moved = update_ref(now, name, new_seq, old_seq)
    if old_seq is not None and ref_commit(spark, root, name) != old_seq:
        return False
    version = spark.read.schema("v int").option("basePath", f"{root}/refs").parquet(f"{root}/refs").agg(F.max("v")).first()[0]
    try:
        moved.coalesce(1).write.mode("error").parquet(f"{root}/refs/v={(version or 0) + 1}")
    except AnalysisException:
        return False
    return True


def stored_etags(captures: DataFrame) -> DataFrame:
    """(url, etag) of the last version of each path, for conditional requests; none where the server gave none."""
    last = captures.groupBy("branch", "md_path").agg(F.max_by(F.struct("url", "metadata"), "commit_seq").alias("c"))
    return last.select("c.url", stored_etag(F.col("c.metadata")).alias("etag")).where("etag <> ''")


def not_modified(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """pages (url, etag, ...) without those whose etag is the stored one: they make no new version."""
    p = pages.withColumn("_u", parse_url(F.col("url"))["normalized_url"])
    known = stored_etags(captures).select(F.col("url").alias("_known"), F.col("etag").alias("_e"))
    return p.join(known, (F.col("_u") == F.col("_known")) & (F.col("etag") == F.col("_e")), "left_anti").drop("_u")


def archive(spark: SparkSession, root: str, pages: DataFrame, branch: str = BRANCH, message: str | None = None,
            asset_data: DataFrame | None = None, asset_limit: int = 16) -> DataFrame:
    """End to end: pages (url, html, commit_seq, committed_at, etag) that changed become captures, commits, assets and the branch's new head.

    asset_data (asset_url, data) holds downloads; of assets of one name the last on the page stays. Returns the new captures."""
    fresh = pages
    init_store(spark, root)
    stored = f"{root}/captures"
    known = ref_commit(spark, root, branch)
    if known is not None and "etag" in pages.columns:
        fresh = not_modified(pages, open_store(spark, stored).where(F.col("branch") == branch))
    batch = materialise(ingest(fresh, branch, together=True), "archive")
    append_captures(batch, stored)
    commits(batch, message).withColumn("parent", F.coalesce("parent", F.lit(known).cast("long"))).write.mode("append").parquet(f"{root}/commits")
    if asset_data is not None:
        found = page_assets(batch.select("url", F.col("raw_html").alias("html")), asset_limit)
        data = found.join(asset_data.where("octet_length(data) > 0"), "asset_url").groupBy("src", "basename").agg(F.max_by("data", "pos").alias("data"))
        paths = storage_paths(parse_url(F.col("src")))["sharded_dir"]
        data.select(F.concat(paths, F.lit("/assets/"), "basename").alias("path"), "data").write.mode("append").parquet(f"{root}/assets")
    head = batch.agg(F.max("commit_seq")).first()[0]
    if head is not None and not save_ref(spark, root, branch, head, known):
        raise RuntimeError(f"{branch} moved while the batch was written")
    return batch
