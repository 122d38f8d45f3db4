import datetime as dt

import pytest
from pyspark.sql import functions as F

from webstrata.functions.robots import robots_rules
from webstrata.operators import crawl, history, search, store
from webstrata.plans import queries
from webstrata.sources import pages as sources
from webstrata.sources.tables import shared_dir
from webstrata.streaming import capture_log

V1 = "<h2>River levels</h2><p>Morning report.</p>"
V2 = V1 + "<p>Evening: rising slowly.</p>"
URL = "https://strata.test/river-report"


def captures(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return store.ingest(spark.createDataFrame([(u, h, n, at) for n, (u, h) in enumerate(rows, 1)], "url string, html string, commit_seq long, committed_at timestamp"))


def test_two_versions_show_log_diff_search(spark, tmp_path):
    store.append_captures(captures(spark, [(URL, V1), (URL + "#x", V2), ("https://strata.test/other", V1), (URL, V2), ("://bad", V1)]), str(tmp_path / "s"))
    c = store.open_store(spark, str(tmp_path / "s"))
    path = "archive/strata.test/river-report/index.md"
    assert c.count() == 4
    assert "Evening: rising slowly." in history.show(c, path).first().data
    assert "Evening" not in history.show(c, path, 1).first().data
    assert history.show(c, path, form="json").first().data.startswith('{"url":"https://strata.test/river-report"')
    assert [r.commit_seq for r in history.change_log(c, path).collect()] == [2, 1]
    assert "+Evening: rising slowly." in history.diff(c, path, 2).first().hunks
    assert {r.md_path for r in history.list_archived(c).collect()} == {path, "archive/strata.test/other/index.md"}
    top = search.search(store.tree_entries(c), "river-reprot", fuzzy=True).first()
    assert "river-report" in top.path
    assert [r.commit_seq for r in store.unchanged_skipped(c).orderBy("commit_seq").collect()] == [1, 2, 3]
    assert {r.refs for r in store.blobs(c).collect()} == {2}
    store.compact(c, str(tmp_path / "t"))
    assert store.open_store(spark, str(tmp_path / "t")).count() == 4


def test_line_changes_and_refs(spark):
    a = spark.createDataFrame([("p", "x\ny\ny")], "md_path string, markdown string")
    b = spark.createDataFrame([("p", "x\ny\nz\nw")], "md_path string, markdown string")
    assert [tuple(r) for r in history.line_changes(a, b).collect()] == [("p", 2, 1)]
    refs = spark.createDataFrame([("main", 3)], "name string, commit_seq long")
    assert store.update_ref(refs, "main", 4, 2).first().commit_seq == 3
    assert store.update_ref(refs, "main", 4, 3).first().commit_seq == 4
    assert store.update_ref(refs, "dev", 1).count() == 2


def test_empty_store(spark):
    none = captures(spark, [(URL, V1)]).where("false")
    assert store.as_of(none).count() == history.change_log(none).count() == history.list_archived(none).count() == 0


EDGES = [(f"http://n/{a}", p, f"http://{h}/{b}") for a, p, h, b in [(0, 0, "n", 1), (0, 1, "n", 2), (0, 2, "o", 9), (1, 0, "n", 2), (1, 1, "n", 3), (2, 0, "n", 0), (2, 1, "n", 4), (3, 0, "n", 5)]]


def test_crawl_order_domain_robots_caps(spark):
    e = spark.createDataFrame(EDGES, "src string, pos int, dst string")
    order = lambda df: [r.url.split("//")[1] for r in df.orderBy("rank").collect()]
    assert order(crawl.crawl(spark, e, "http://n/0", depth=2)) == ["n/0", "n/1", "n/2", "o/9", "n/3", "n/4"]
    assert order(crawl.crawl(spark, e, "http://n/0", depth=9, same_domain=True)) == ["n/0", "n/1", "n/2", "n/3", "n/4", "n/5"]
    assert order(crawl.crawl(spark, e, "http://n/0", depth=2, max_pages=2)) == ["n/0", "n/1"]
    rules = robots_rules(spark.createDataFrame([("n", "User-agent: *\nDisallow: /1")], "host string, body string"))
    got = crawl.crawl(spark, e, "http://n/0", depth=3, rules=rules).orderBy("rank").collect()
    assert [(r.url, r.allowed) for r in got] == [("http://n/0", True), ("http://n/1", False), ("http://n/2", True), ("http://o/9", True), ("http://n/4", True)]


def test_text_and_binary_sources(spark, tmp_path):
    (tmp_path / "p.html").write_text(V1)
    assert sources.pages_from_text(spark, str(tmp_path / "p.html")).first().html == V1
    (tmp_path / "e").write_bytes(b"")
    assert [(r.rel_path, r.len) for r in sources.assets_from_files(spark, str(tmp_path)).collect()] == [("p.html", len(V1))]


def test_http_source_of_no_server(spark):
    spark.dataSource.register(sources.HttpPages)
    r = spark.read.format("http_pages").option("urls", "http://127.0.0.1:9/x").load().first()
    assert (r.url, r.status_code, r.html) == ("http://127.0.0.1:9/x", 0, None)


def test_streaming_changed_only_and_store(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u", "a", 1), ("u", "a", 2), ("u", "b", 3), ("v", "a", 4)], "url string, etag string, commit_seq long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("url string, etag string, commit_seq long").parquet(src)
    q = capture_log.changed_only(stream).writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.commit_seq for r in spark.table("changed").collect()) == [1, 3, 4]
    to_store = stream.withColumn("branch", F.lit("main"))
    capture_log.write_store(to_store, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_registered_queries_have_unique_columns(spark):
    for name in ("url_normalize", "shard_paths", "robots_gate"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_archive_end_to_end(spark, tmp_path):
    root, at = str(tmp_path / "root"), dt.datetime(2024, 5, 1)
    schema = "url string, html string, etag string, commit_seq long, committed_at timestamp"
    batch = lambda *rows: spark.createDataFrame([(*r, at) for r in rows], schema)
    image = "<img src='/i/a.png'><img src='/j/a.png'>"
    data = spark.createDataFrame([("https://strata.test/i/a.png", b"1"), ("https://strata.test/j/a.png", b"2"), ("https://strata.test/k.png", b"")], "asset_url string, data binary")
    store.archive(spark, root, batch((URL, V1 + image, "e1", 1), ("https://strata.test/x", V1, "e9", 2)), asset_data=data)
    assert store.ref_commit(spark, root, "main") == 2 and store.ref_commit(spark, root, "dev") is None
    assert [(r.path, bytes(r.data)) for r in spark.read.parquet(f"{root}/assets").collect()] == [("archive/strata.test/river-report/assets/a.png", b"2")]
    again = store.archive(spark, root, batch((URL, V2, "e2", 3), ("https://strata.test/x", V1, "e9", 4)), message="evening")
    assert [r.commit_seq for r in again.collect()] == [3] and store.ref_commit(spark, root, "main") == 3
    text = "## River levels\n\nMorning report.\n\n![](/i/a.png)![](/j/a.png)"
    log = {r.commit_seq: (r.parent, r.message) for r in spark.read.parquet(f"{root}/commits").collect()}
    assert log[2][0] == 1 and log[3] == (2, "evening") and log[1] == (None, f"archive: {URL} ({len(text)} bytes md)")
    assert not store.save_ref(spark, root, "main", 9, 2) and store.save_ref(spark, root, "main", 9, 3)
    store.archive(spark, root, batch(("https://strata.test/y", V1, None, 1)), branch="dev", message="")
    assert {r.name: r.commit_seq for r in store.refs(spark, root).collect()} == {"main": 9, "dev": 1}
    c = store.open_store(spark, f"{root}/captures")
    kept = store.prune_blobs(spark.createDataFrame([(c.first().md_sha,), ("0",)], "sha string"), c)
    assert kept.count() == 1 and store.new_blobs(store.blobs(c), kept).count() == 2


def test_shared_dir_must_be_shared():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, other: other)})
        sparkContext = type("S", (), {"master": "spark://m:7077", "applicationId": "a"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_robots_source_of_no_server(spark):
    spark.dataSource.register(sources.HttpRobots)
    rows = spark.read.format("http_robots").option("sites", "http://127.0.0.1:9").load()
    assert [tuple(r) for r in rows.collect()] == [("127.0.0.1:9", "")]
    assert robots_rules(rows).first().disallow == []
