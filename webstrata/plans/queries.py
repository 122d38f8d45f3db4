"""Queries over the test tables by operator, with SQL twins."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.functions import extract, fuzzy, metadata, robots, urls
from webstrata.functions.markdown import decode_entities, html_to_markdown
from webstrata.functions.sanitize import sanitize_html
from webstrata.operators import crawl, history, search, store
from webstrata.plans import sql
from webstrata.sources.tables import materialise, shared_dir, spread_out, table
from webstrata.streaming import capture_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FUZZY = "blog/en"
FUZZY_TYPO = "exmaple.org"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread_out(table(spark, d, "pages"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).withColumn("u", urls.parse_url(F.col("url"))).where("u is not null")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("page_id", urls.storage_paths(F.col("u")).alias("s")).select("page_id", "s.*")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Pages as commits in page order; the content id is that of the clean text."""
    p = _parsed(spark, d).select("page_id", "u", sanitize_html(F.col("html")).alias("markdown"))
    return p.select(
        F.lit(store.BRANCH).alias("branch"), F.col("page_id").alias("commit_seq"),
        urls.storage_paths(F.col("u"))["md_path"].alias("md_path"), "markdown",
        F.sha1(F.col("markdown").cast("binary")).alias("md_sha"), F.octet_length("markdown").cast("long").alias("markdown_bytes"),
    )


_P = sql.parsed_ctes("pages", "page_id, url, html")
_V = (
    f"{_P}, versions AS (SELECT page_id AS commit_seq, {sql.directory()} || '/index.md' AS md_path, {sql.sanitized()} AS markdown FROM parsed)"
)


@query(f"WITH {_P} SELECT page_id, scheme, host, port, path, query, normalized_url FROM parsed")
def url_normalize(spark, d):
    return _parsed(spark, d).select("page_id", "u.*")


@query(f"WITH {_P} SELECT page_id, q0 AS query_before, query AS query_after FROM parsed WHERE q0 <> ''")
def url_tracking_strip(spark, d):
    raw = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    return _pages(spark, d).select("page_id", raw.alias("query_before"), urls.normalize_query(raw).alias("query_after")).where(
        "query_before <> ''"
    )


@query(f"WITH {_P}, x AS (SELECT page_id, {sql.directory()} AS sharded_dir FROM parsed) SELECT page_id, sharded_dir, sharded_dir || '/index.md' AS md_path, sharded_dir || '/index.html.gz' AS gz_path, sharded_dir || '/metadata.json' AS json_path FROM x")
def shard_paths(spark, d):
    return _paths(spark, d)


@query(f"WITH {_P} SELECT host, count(*) AS pages, sum(strlen(html))::BIGINT AS html_bytes FROM parsed GROUP BY host")
def host_partition_counts(spark, d):
    return _parsed(spark, d).groupBy(F.col("u.host").alias("host")).agg(
        F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("html_bytes")
    )


@query(f"WITH {_P} SELECT page_id, scheme || '://' || host || {sql.path_of(chr(39) + '/up/' + chr(39) + ' || page_id')} AS rooted, scheme || '://' || host || {sql.path_of('''regexp_extract(path, '^(.*/)', 1) || 'x/./y' ''')} AS sibling, 'https://cdn.example.org/a' AS schemeless FROM parsed")
def resolve_links(spark, d):
    u = F.col("u")
    return _parsed(spark, d).select(
        "page_id", urls.resolve_url(u, F.concat(F.lit("/up//"), F.col("page_id").cast("string"))).alias("rooted"),
        urls.resolve_url(u, F.lit("x/./z/../y")).alias("sibling"), urls.resolve_url(u, F.lit("//cdn.example.org/a")).alias("schemeless"),
    )


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '\\?.*$', ''), '[^A-Za-z0-9._-]', '_', 'g') AS raw, CASE WHEN raw = '' THEN 'asset.bin' ELSE raw END AS basename FROM pages")
def asset_basename(spark, d):
    name = urls.asset_basename(F.col("url"))
    return _pages(spark, d).select("page_id", F.when(name == "asset.bin", "").otherwise(name).alias("raw"), name.alias("basename"))


@query(f"SELECT page_id, {sql.sanitized()} AS sanitized_html FROM pages")
def sanitize(spark, d):
    return _pages(spark, d).select("page_id", sanitize_html(F.col("html")).alias("sanitized_html"))


@query(f"SELECT page_id, strlen(html) - strlen({sql.sanitized()}) AS noise_bytes FROM pages")
def noise_bytes_removed(spark, d):
    n = F.octet_length("html") - F.octet_length(sanitize_html(F.col("html")))
    return _pages(spark, d).select("page_id", n.cast("long").alias("noise_bytes"))


@query(f"WITH {sql.links_ctes()} SELECT page_id, pos, dst AS link FROM links")
def extract_links(spark, d):
    p = _parsed(spark, d)
    return p.select("page_id", F.posexplode(extract.outgoing_links(sanitize_html(F.col("html")), F.col("u"))).alias("pos", "link"))


@query(f"WITH {sql.links_ctes()} SELECT src, pos, dst FROM links")
def link_edges_same_host(spark, d):
    e = extract.link_edges(_pages(spark, d).withColumn("html", sanitize_html(F.col("html"))))
    return e.where(F.col("dst_host") == urls.parse_url(F.col("src"))["host"]).select("src", "pos", "dst")


@query(f"SELECT page_id, {sql.entities('html')} AS decoded FROM pages")
def entity_decode(spark, d):
    return _pages(spark, d).select("page_id", decode_entities(F.col("html")).alias("decoded"))


@query(f"SELECT page_id, {sql.markdown(sql.sanitized())} AS markdown FROM pages")
def markdown(spark, d):
    clean = _pages(spark, d).select("page_id", sanitize_html(F.col("html")).alias("h"))
    return clean.select("page_id", html_to_markdown("h").alias("markdown"))


@query(f"""WITH {_P} SELECT page_id, '{{"url":"' || normalized_url || '","status_code":200,"crawled_at":"2024-01-01T00:00:00Z","content_type":"text/html; charset=utf-8","etag":"","last_modified":"","server":"","raw_bytes":' || strlen(html) || ',"markdown_bytes":' || strlen({sql.sanitized()}) || ',"asset_count":0}}' AS metadata, '' AS etag FROM parsed""")
def capture_metadata_json(spark, d):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    json = metadata.metadata_json(F.col("u.normalized_url"), F.col("html"), F.octet_length(sanitize_html(F.col("html"))), at)
    out = _parsed(spark, d).select("page_id", json.alias("metadata"))
    return out.withColumn("etag", metadata.stored_etag(F.col("metadata")))


@query("SELECT page_id, 200 + page_id % 2 * 204 AS status_code, 'text/html' AS content_type, '\"v' || page_id || '\"' AS etag, html AS body FROM pages")
def response_parse(spark, d):
    code = F.when(F.col("page_id") % 2 == 0, "200 OK").otherwise("404 Not Found")
    raw = F.concat(
        F.lit("HTTP/1.1 301 Moved\r\nLocation: /x\r\nETag: old\r\n\r\nHTTP/2 "), code,
        F.lit('\r\ncontent-type: text/html\r\nETAG: "v'), F.col("page_id").cast("string"), F.lit('"\r\n\r\n'), F.col("html"),
    )
    p = _pages(spark, d).select("page_id", metadata.response_parts(raw).alias("r"))
    return p.select("page_id", F.col("r.status_code").cast("long").alias("status_code"), "r.content_type", "r.etag", "r.body")


@query("SELECT page_id, sha1(encode('blob ' || strlen(html)) || '\\x00'::BLOB || encode(html)) AS sha, sha256(encode('blob ' || strlen(html)) || '\\x00'::BLOB || encode(html)) AS sha256 FROM pages")
def blob_sha(spark, d):
    return _pages(spark, d).select(
        "page_id", metadata.blob_sha(F.col("html")).alias("sha"), metadata.blob_sha(F.col("html"), 256).alias("sha256")
    )


@query("SELECT sha1(text) AS sha, min(strlen(text)) AS bytes, count(*) AS refs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_dedupe(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return store.blobs(t.select(F.sha1(F.col("text").cast("binary")).alias("md_sha"), F.octet_length("text").cast("long").alias("markdown_bytes")))


@query("SELECT page_id, strlen(html)::INTEGER AS raw_bytes, sha1(html) AS raw_sha, true AS smaller FROM pages")
def gzip_roundtrip(spark, d):
    """Compressed, decompressed, and the digest of what comes back."""
    p = _pages(spark, d).select("page_id", F.octet_length("html").alias("raw_bytes"), metadata.gzip_bytes("html").alias("gz"))
    return p.select("page_id", "raw_bytes", F.sha1(metadata.gunzip_bytes("gz")).alias("raw_sha"), (F.octet_length("gz") < F.col("raw_bytes")).alias("smaller"))


_MD = f"(SELECT *, {sql.markdown(sql.sanitized())} AS md FROM parsed)"
_CAPTURES = f"""{_P}, captures AS (SELECT page_id AS commit_seq, normalized_url AS url, {sql.directory()} || '/index.md' AS md_path,
  sha1(encode('blob ' || strlen(md)) || '\\x00'::BLOB || encode(md)) AS md_sha, strlen(html) AS raw_bytes, strlen(md) AS markdown_bytes FROM {_MD})"""


@query(f"WITH {_CAPTURES} SELECT commit_seq, lag(commit_seq) OVER (ORDER BY commit_seq) AS parent, 'archive: ' || url || ' (' || markdown_bytes || ' bytes md)' AS message FROM captures")
def commit_log(spark, d):
    return store.commits(_captures(spark, d)).select("commit_seq", "parent", "message")


@query(f"WITH {_CAPTURES} SELECT md_path, max(commit_seq) AS commit_seq, arg_max(md_sha, commit_seq) AS md_sha FROM captures GROUP BY md_path")
def latest_markdown(spark, d):
    return store.as_of(_captures(spark, d)).select("md_path", "commit_seq", "md_sha")


@query(f"WITH {_CAPTURES} SELECT 'main' AS name, max(commit_seq) AS commit_seq, count(*) AS commits FROM captures")
def archive_end_to_end(spark, d):
    """All pages through one transaction; then the branch's head as stored, and the stored commits."""
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    pages = _pages(spark, d).select("url", "html", F.col("page_id").alias("commit_seq"), F.lit("2024-01-01").cast("timestamp").alias("committed_at"))
    store.archive(spark, root, pages)
    n = spark.read.parquet(f"{root}/commits").agg(F.count("*").alias("commits"))
    return store.refs(spark, root).crossJoin(F.broadcast(n))  # one row each


@query(f"WITH {_P}, v AS (SELECT arg_max(normalized_url, page_id) AS last_url, max(page_id) AS last FROM parsed GROUP BY {sql.directory()}) SELECT page_id FROM parsed LEFT JOIN v ON last_url = normalized_url WHERE last IS NULL OR last % 2 = 1")
def recrawl_not_modified(spark, d):
    """A second crawl: pages whose last stored version has an even number come with the same etag, others with a new one."""
    p = _pages(spark, d).withColumn("commit_seq", F.col("page_id")).withColumn("committed_at", F.lit("2024-01-01").cast("timestamp"))
    stored = store.ingest(p.withColumn("etag", F.concat(F.lit("v"), F.col("page_id").cast("string"))), with_gzip=False, with_markdown=False)
    parsed = _parsed(spark, d).select("page_id", F.col("u.normalized_url").alias("url"), urls.storage_paths(F.col("u"))["md_path"].alias("p"))
    last = parsed.groupBy("p").agg(F.max(F.struct("page_id", "url")).alias("m")).select("m.url", F.col("m.page_id").alias("last"))
    again = parsed.select("page_id", "url").join(last, "url", "left")
    etag = F.concat(F.when(F.col("last") % 2 == 0, "v").otherwise("w"), F.col("last").cast("string"))
    return store.not_modified(again.select("page_id", "url", etag.alias("etag")), stored).select("page_id")


@query(f"""WITH {_P}, t AS (SELECT page_id, normalized_url AS src, scheme, host, regexp_extract_all({sql.sanitized()} || '<img src="/i/' || page_id || '.png?w=2"><IMG alt="" src="https://cdn.example.org/x.png"><link rel="icon" href="/favicon.ico">', '(?i)<(?:img|link)[^>]*>') AS tags FROM parsed),
u AS (SELECT page_id, src, scheme, host, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM t),
v AS (SELECT *, coalesce(nullif(regexp_extract(tag, '(?i)src="([^"]*)', 1), ''), regexp_extract(tag, '(?i)href="([^"]*)', 1)) AS a FROM u)
SELECT src, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, regexp_replace(regexp_replace(a, '^.*/', ''), '\\?.*$', '') AS basename FROM v
WHERE a LIKE '/%' AND a NOT LIKE '//%' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) <= 16""")
def page_assets(spark, d):
    """The test pages have no images, so each gets two, of which one is on another host, and an icon."""
    more = F.concat(F.lit('<img src="/i/'), F.col("page_id").cast("string"), F.lit('.png?w=2"><IMG alt="" src="https://cdn.example.org/x.png"><link rel="icon" href="/favicon.ico">'))
    clean = _pages(spark, d).select("url", F.concat(sanitize_html(F.col("html")), more).alias("html"))
    return extract.page_assets(clean).select("src", "pos", "basename")


def _captures(spark, d):
    p = _pages(spark, d).withColumn("commit_seq", F.col("page_id")).withColumn("committed_at", F.lit("2024-01-01").cast("timestamp"))
    return store.ingest(p, with_gzip=False)


@query(f"""WITH {_CAPTURES} SELECT 'main' AS branch, commit_seq, url, md_path, md_sha, raw_bytes, markdown_bytes,
'{{"url":"' || url || '","status_code":200,"crawled_at":"2024-01-01T00:00:00Z","content_type":"text/html; charset=utf-8","etag":"","last_modified":"","server":"","raw_bytes":' || raw_bytes || ',"markdown_bytes":' || markdown_bytes || ',"asset_count":0}}' AS metadata,
(SELECT count(*) FROM (SELECT DISTINCT src, dst FROM (WITH {sql.links_ctes()} SELECT page_id, src, dst FROM links) l WHERE l.page_id = commit_seq))::INTEGER AS links FROM captures""")
def ingest_captures(spark, d):
    p = _pages(spark, d).withColumn("commit_seq", F.col("page_id")).withColumn("committed_at", F.lit("2024-01-01").cast("timestamp"))
    return store.ingest(p).select("branch", "commit_seq", "url", "md_path", "md_sha", "raw_bytes", "markdown_bytes", "metadata", F.size("links").alias("links"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/1 # old\nDisallow:\nCrawl-delay: 1.5\nUser-agent: WebStrata\nDisallow: /de/\n"


def _rules(spark, d):
    hosts = _parsed(spark, d).select(F.col("u.host").alias("host"), F.lit(ROBOTS).alias("body")).distinct()
    return robots.robots_rules(hosts)


@query(f"WITH {_P} SELECT DISTINCT host, '/en/1|/de/' AS rules, 1500 AS crawl_delay_ms FROM parsed")
def robots_parse(spark, d):
    return _rules(spark, d).select("host", F.array_join("disallow", "|").alias("rules"), "crawl_delay_ms")


@query(f"WITH {_P} SELECT page_id, host, path, NOT (starts_with(path, '/en/1') OR starts_with(path, '/de/')) AS allowed FROM parsed")
def robots_gate(spark, d):
    p = _parsed(spark, d).select("page_id", "u.host", "u.path")
    return robots.robots_gate(p, _rules(spark, d)).select("page_id", "host", "path", "allowed")


_TREE = f"{_P}, tree AS (SELECT DISTINCT {sql.directory()} || '/index.md' AS path FROM parsed)"


def _tree(spark, d):
    return _paths(spark, d).select(F.col("md_path").alias("path")).distinct()


@query(f"WITH {_TREE} SELECT path, 1.0::DOUBLE AS score FROM tree WHERE contains(lower(path), 'blog') ORDER BY path LIMIT 50")
def search_substring(spark, d):
    return search.search(_tree(spark, d), "BLOG")


@query(f"WITH {_TREE} SELECT path, score FROM ({sql.fuzzy_scores(FUZZY_TYPO, 'tree', 'path')}) WHERE score >= {sql.THRESHOLD} ORDER BY score DESC, path LIMIT 50")
def search_fuzzy_top50(spark, d):
    return search.search(_tree(spark, d), FUZZY_TYPO, fuzzy=True)


@query(f"WITH {_TREE} SELECT count(*) AS matches FROM ({sql.fuzzy_scores(FUZZY_TYPO, 'tree', 'path')}) WHERE score >= {sql.THRESHOLD}")
def search_match_count(spark, d):
    return search.match_count(_tree(spark, d), FUZZY_TYPO, fuzzy=True)


@query(f"SELECT page_id, score FROM ({sql.fuzzy_scores(FUZZY, 'pages', 'url', 'levenshtein')})")
def fuzzy_substring_score(spark, d):
    return _pages(spark, d).select("page_id", fuzzy.similarity(FUZZY, F.col("url"), swaps=False).alias("score"))


@query(f"SELECT page_id, CAST(floor(score * 100 + 0.5) AS INTEGER) AS match_score FROM ({sql.fuzzy_scores(FUZZY, 'pages', 'url')})")
def fuzzy_match_score(spark, d):
    return _pages(spark, d).select("page_id", fuzzy.match_score(FUZZY, F.col("url")).alias("match_score"))


@query("SELECT page_id, 1 - levenshtein('https://www.example.org/en/1', lower(url)) / greatest(28, length(url))::DOUBLE AS score FROM pages")
def fuzzy_exact_score(spark, d):
    s = fuzzy.similarity("https://www.example.org/en/1", F.col("url"), swaps=False, exact=True)
    return _pages(spark, d).select("page_id", s.alias("score"))


@query()
def fuzzy_spans(spark, d):
    return search.search(_tree(spark, d), FUZZY_TYPO, fuzzy=True, spans=True).select("path", "score", "span.mstart", "span.mend")


@query("SELECT page_id, split_part(url, '/', 4) AS field4, coalesce(regexp_extract(regexp_replace(url, '/', ' ', 'g'), '^\\S+ +(\\S+)', 1), '') AS word2 FROM pages")
def extract_field(spark, d):
    return _pages(spark, d).select(
        "page_id", fuzzy.extract_field(F.col("url"), "/", 4).alias("field4"),
        fuzzy.extract_field(F.replace(F.col("url"), F.lit("/"), F.lit(" ")), None, 2).alias("word2"),
    )


@query(f"WITH {_V} SELECT md_path, max(commit_seq) AS commit_seq, arg_max(sha1(markdown), commit_seq) AS md_sha FROM versions GROUP BY md_path")
def latest_version(spark, d):
    return store.as_of(_versions(spark, d)).select("md_path", "commit_seq", "md_sha")


_MIDDLE = "(SELECT max(commit_seq) // 2 FROM versions)"


def _middle(versions: DataFrame) -> int:
    """The commit half way to the last one; 0 for an empty store."""
    return (versions.agg(F.max("commit_seq").alias("last")).first()["last"] or 0) // 2


@query(f"WITH {_V} SELECT md_path, max(commit_seq) AS commit_seq, arg_max(sha1(markdown), commit_seq) AS md_sha FROM versions WHERE commit_seq <= {_MIDDLE} GROUP BY md_path")
def as_of_version(spark, d):
    v = _versions(spark, d)
    return store.as_of(v, _middle(v)).select("md_path", "commit_seq", "md_sha")


@query(f"WITH {_V}, w AS (SELECT *, sha1(markdown) AS md_sha, lag(markdown) OVER (PARTITION BY md_path ORDER BY commit_seq) AS b FROM versions) SELECT md_path, commit_seq, md_sha, len(string_split(markdown, chr(10)))::INTEGER AS lines, coalesce(len(string_split(b, chr(10))), 0)::INTEGER AS lines_before FROM w WHERE b IS NULL OR b <> markdown")
def version_log_changes(spark, d):
    return history.change_log(_versions(spark, d)).drop("branch")


_EV = "SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events"


@query(f"SELECT user_id, event_id, event_type FROM ({_EV}) WHERE before IS NULL OR before <> event_type")
def unchanged_skipped(spark, d):
    e = table(spark, d, "events").select(F.lit("main").alias("branch"), "user_id", F.col("event_id").alias("commit_seq"), "event_type")
    kept = store.unchanged_skipped(e, key="user_id", content="event_type")
    return kept.select("user_id", F.col("commit_seq").alias("event_id"), "event_type")


@query(f"""WITH {_V},
old AS (SELECT md_path, unnest(string_split(arg_max(markdown, commit_seq), chr(10))) AS line FROM versions WHERE commit_seq <= {_MIDDLE} GROUP BY md_path),
new AS (SELECT md_path, unnest(string_split(arg_max(markdown, commit_seq), chr(10))) AS line FROM versions GROUP BY md_path),
n AS (SELECT md_path, line, sum(s) AS n FROM (SELECT md_path, line, 1 AS s FROM new UNION ALL SELECT md_path, line, -1 FROM old) GROUP BY md_path, line)
SELECT md_path, sum(greatest(n, 0))::BIGINT AS added, sum(greatest(-n, 0))::BIGINT AS removed FROM n GROUP BY md_path""")
def version_diff_counts(spark, d):
    v = _versions(spark, d)
    return history.line_changes(store.as_of(v, _middle(v)), store.as_of(v))


@query()
def version_diff_hunks(spark, d):
    v = _versions(spark, d)
    twice = v.groupBy("md_path").agg(F.max("commit_seq").alias("new"), F.min("commit_seq").alias("old"), F.max_by("markdown", "commit_seq").alias("b"), F.min_by("markdown", "commit_seq").alias("a")).where("new > old")
    return twice.select("md_path", "old", "new", history.unified_hunks("a", "b").alias("hunks"))


@query(f"WITH {_V} SELECT md_path, arg_max(markdown, commit_seq) AS data, max(commit_seq) AS commit_seq FROM versions WHERE md_path LIKE 'archive/blog.%' GROUP BY md_path")
def show_version(spark, d):
    v = _versions(spark, d).where(F.startswith("md_path", F.lit("archive/blog.")))
    return store.as_of(v).select("md_path", F.col("markdown").alias("data"), "commit_seq")


@query(f"WITH {_V} SELECT DISTINCT md_path, max(commit_seq) OVER (PARTITION BY md_path) AS commit_seq FROM versions WHERE contains(md_path, '/index.md')")
def list_archived(spark, d):
    return history.list_archived(_versions(spark, d)).drop("branch")


@query(f"WITH {_P}, t AS (SELECT DISTINCT {sql.directory()} AS d FROM parsed) SELECT d || f AS path FROM t, (VALUES ('/index.md'), ('/index.html.gz'), ('/metadata.json')) AS x(f)")
def tree_scan(spark, d):
    s = _paths(spark, d)
    captures = s.select(F.lit("main").alias("branch"), F.col("page_id").alias("commit_seq"), "md_path", "gz_path", "json_path")
    return store.tree_entries(captures).select("path")


@query(f"WITH {_V} SELECT count(DISTINCT md_path) AS paths, count(*) AS captures FROM versions")
def compaction(spark, d):
    v = _versions(spark, d).withColumn("host", F.split_part("md_path", F.lit("/"), F.lit(2)))
    path = materialise(v, "store")._stored_at + "-compact"
    store.compact(v, path)
    return store.open_store(spark, path).agg(F.countDistinct("md_path").alias("paths"), F.count("*").alias("captures"))


_BFS = f"""WITH {sql.links_ctes()}, s AS (SELECT arg_min(src, page_id) AS src FROM links),
n AS (SELECT dst, min(pos) AS pos FROM links WHERE src = (SELECT src FROM s) AND dst <> src GROUP BY dst)
SELECT 0 AS rank, src AS url, 0 AS depth, true AS allowed FROM s UNION ALL
SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER), dst, 1, true FROM n"""


@query(_BFS)
def crawl_bfs(spark, d):
    e = extract.link_edges(_pages(spark, d).withColumn("html", sanitize_html(F.col("html")))).select("src", "pos", "dst")
    first = _pages(spark, d).select(F.min_by("url", "page_id").alias("url")).select(urls.parse_url(F.col("url"))["normalized_url"].alias("u")).first()["u"]
    return crawl.crawl(spark, e, first, depth=1, max_pages=50, same_domain=True)


@query("""WITH RECURSIVE e AS (SELECT nation.n_nationkey AS a, (n_nationkey * 7 + k) % 25 AS b, k AS pos FROM nation, range(1, 4) AS r(k)),
r AS (SELECT 0::BIGINT AS v, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = v WHERE depth < 2)
SELECT 'http://n/' || v AS url, min(depth)::INTEGER AS depth FROM r GROUP BY v""")
def crawl_reachability(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    e = n.select("a", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos"))
    name = lambda c: F.concat(F.lit("http://n/"), c.cast("string"))
    edges = e.select(name(F.col("a")).alias("src"), "pos", name((F.col("a") * 7 + F.col("pos")) % 25).alias("dst"))
    return crawl.crawl(spark, edges, "http://n/0", depth=2).select("url", "depth")


# Extensions over captures and events: not in the inventory's core, free with the engine.


@query(f"WITH {_P} SELECT host, scheme, count(*) AS pages, sum(strlen(html))::BIGINT AS html_bytes FROM parsed GROUP BY ROLLUP (host, scheme)")
def ext_rollup_host_scheme(spark, d):
    p = _parsed(spark, d).select(F.col("u.host").alias("host"), F.col("u.scheme").alias("scheme"), F.octet_length("html").alias("b"))
    return p.rollup("host", "scheme").agg(F.count("*").alias("pages"), F.sum("b").alias("html_bytes"))


@query("SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (source, lang)")
def ext_cube_source_lang(spark, d):
    return table(spark, d, "documents").cube("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, event_id, ts, row_number() OVER w::INTEGER AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 0 AS positive FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("row_number() OVER w::INTEGER", "CAST(row_number() OVER w AS INTEGER)"))
def ext_window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        "user_id", "event_id", "ts", F.row_number().over(w).alias("n"), (F.sum("value").over(w.rowsBetween(-2, 0)) > 0).alias("positive")
    )


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def ext_join_labels(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 0"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def ext_set_except(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id").distinct()).distinct()


@query("SELECT a.user_id, a.event_id, max(b.event_id) AS last_signup FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'signup' AND b.event_id < a.event_id WHERE a.event_type = 'purchase' GROUP BY ALL")
def ext_asof_join(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").withColumn("last_signup", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w))
    return e.where("event_type = 'purchase'").select("user_id", "event_id", "last_signup")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_streaming_windows(spark, d):
    return _streamed(spark, d, lambda s: capture_log.windowed_counts(s, "1 hour"), "complete")


@query("""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 30 minutes THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 minutes AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, d):
    s = capture_log.sessions(table(spark, d, "events"))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def _streamed(spark: SparkSession, d: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a streaming plan over all of `events` once; each batch's whole result replaces the one before in shared storage."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*") if os.path.isfile(f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = plan(stream).writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).outputMode(mode)
    q.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
