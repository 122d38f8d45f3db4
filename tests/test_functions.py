import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from webstrata.functions import extract, fuzzy, metadata, robots, urls
from webstrata.functions.markdown import decode_reference, to_markdown
from webstrata.functions.sanitize import sanitize_html

URLS = [
    ("https://wiki.strata.test/guide/first-steps.htm?utm_medium=mail&view=full&q=7&p=3#top",
     "https://wiki.strata.test/guide/first-steps.htm?p=3&q=7&view=full", "archive/wiki.strata.test/guide/first-steps/q_p-3_q-7_view-full"),
    ("https://[fe80::a:1]:9090/status", "https://[fe80::a:1]:9090/status", "archive/[fe80%3A%3Aa%3A1]/status"),
    ("https://fe80::a:1/up", "https://[fe80::a:1]/up", "archive/[fe80%3A%3Aa%3A1]/up"),
    ("https://me:word@strata.test/inner", "https://strata.test/inner", "archive/strata.test/inner"),
    ("HTTP://Strata.TEST:443/Shop/List/?z=1&y=2&gclid=k9", "http://strata.test:443/Shop/List/?y=2&z=1", "archive/strata.test/Shop/List/q_y-2_z-1"),
    ("https://strata.test////a////b", "https://strata.test////a////b", "archive/strata.test/a////b"),
    ('https://strata.test/run?cmd=";rm+-r;"', 'https://strata.test/run?"&cmd="&rm+-r', "archive/strata.test/run/q_%22_cmd-%22_rm+-r"),
    ("https://strata.test/t?" + "utm_term=x&" * 70 + "a=1", "https://strata.test/t?a=1", "archive/strata.test/t/q_a-1"),
    ("https://strata.test/n?" + "&".join(f"k{i:02}" for i in range(70)), "https://strata.test/n?" + "&".join(f"k{i:02}" for i in range(64)), "archive/strata.test/n/q_" + "_".join(f"k{i:02}" for i in range(64))),
    ("ftp://f/y", "ftp://f:443/y", "archive/f/y"), ("box:port/y", "https://box:0/y", "archive/box/y"), ("http://f/?_ga=2", "http://f/", "archive/f/index"),
    ("https://f/index.html", "https://f/index.html", "archive/f/index"), ("https://f/b/", "https://f/b/", "archive/f/b"),
    ("://nothing", None, None), ("https://", None, None), ("", None, None), ("strata.test/?to=https://y", None, None), (None, None, None),
]
RESOLVE = [
    ("https://strata.test/news/today.html", "older.html", "https://strata.test/news/older.html"), ("https://strata.test/news/today.html", "/feed/all", "https://strata.test/feed/all"),
    ("https://strata.test/x/y/z/", "../w", "https://strata.test/x/y/w"), ("http://strata.test:81/x/y", "/q/", "http://strata.test/q"),
    ("http://strata.test/x", "//files.strata.test/y", "https://files.strata.test/y"), ("https://strata.test/x/y", "?page=2", "https://strata.test/x/?page=2"),
    ("https://strata.test/x/y", "../../../../w", "https://strata.test/w"), ("https://strata.test/x/y", "tel:5", "https://strata.test/x/tel:5"), ("https://strata.test/x/y", "", "https://strata.test/x"),
]
CLEAN = [
    ("<p>Kept</p><script>run(1)</script><p>Too</p>", "<p>Kept</p><p>Too</p>"), ("<div>Body<style>y</style><noscript>No scripts</noscript></div>", "<div>Body</div>"),
    ('<form id=f><input name="my_csrf" value="9"><input name="city"></form>', '<form id=f><input name="city"></form>'), ("<svg><path d=1/></svg><p>Shown</p>", "<p>Shown</p>"),
    ("<!-- c <script>s</script> --><h2>T</h2>", "<h2>T</h2>"), ("<p>u</p><script>v</scripts>w", "<p>u</p>w"), ("<!-->r-->s", "s"), ("b<!-- no end", "b"),
    ("<svg/><p>gone</p>", ""), ("<IMG src=p HEIGHT='1'>u", "u"), ("<div title='<style>'>m</style>n", "<div title='<style>'>m</style>n"), ("1 < 2 <p", "1 < 2 <p"),
    ("<script>endless", ""), ("<scripts>w</scripts>", "<scripts>w</scripts>"), ('<div class="consent-banner">y</div>', '<div class="consent-banner">y</div>'), ("", ""), (None, None),
]
MARKDOWN = [
    ("<blockquote>Said by someone.</blockquote>", "> Said by someone.\n\n"), ("<pre><code>for x in y:\n    z(x)\n</code></pre>", "```\nfor x in y:\n    z(x)\n\n```\n\n"),
    ("<p>Signs: &lt;&gt; &amp; &#65; &#x2013; &euro; &hellip;</p>", "Signs: <> & A – € …\n\n"), ("<ul><li>p<ol><li>q</li><li>r</li></ol></li><li>s</li></ul>", "- p\n  1. q\n  2. r\n\n\n- s\n\n"),
    ("<ol><li>p</li></ol><li>q</li>", "1. p\n\n2. q\n"), ("x < i > y", "x * y"), ('<a id=v>n</a><a href="/to">m</a>', "n[m](/to)"), ('<img src=/p.gif alt="pic">', "![pic](/p.gif)"),
    ("<pre>&gt;y&lt;</pre>", "```\n&gt;y&lt;\n```\n\n"), ("<title>Head</title><h3>Sub</h3>", "Head\n\n### Sub\n\n"), ("u&nbsp;&nbsp;v &middot; &#34;&#x42;", 'u  v &middot; "B'), ("&q&lt;<i>", "&q<*"),
    ("", ""), (None, None), ("<table><tr><th>X</th></tr><tr><td>5</td></tr></table>", "| X |\n|---|\n| 5 |\n\n\n"),
]


def one(spark, rows, names, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, names).select(*columns).collect()]


def test_urls(spark):
    p = urls.parse_url(F.col("raw"))
    df = spark.createDataFrame([(r,) for r, _, _ in URLS], "raw string").select("raw", p.alias("u"))
    got = df.select("raw", "u.normalized_url", urls.storage_paths(F.col("u"))["sharded_dir"]).collect()
    assert [tuple(r) for r in got] == URLS
    again = df.select("u.normalized_url", urls.parse_url(F.col("u.normalized_url"))["normalized_url"].alias("twice")).collect()
    assert all(r[0] == r[1] for r in again)


def test_resolve(spark):
    got = one(spark, RESOLVE, "b string, r string, w string", urls.resolve_url(urls.parse_url(F.col("b")), F.col("r")), "w")
    assert all(g == w for g, w in got), got


def test_asset_basename(spark):
    rows = [("https://h/a/b.png?x=1", "b.png"), ("https://h/", "asset.bin"), ("https://h/é b", "___b")]
    assert one(spark, rows, "u string, w string", urls.asset_basename(F.col("u"))) == [(w,) for _, w in rows]


def test_sanitize(spark):
    assert one(spark, CLEAN, "h string, w string", sanitize_html(F.col("h"))) == [(w,) for _, w in CLEAN]


@pytest.mark.parametrize(("html", "want"), MARKDOWN)
def test_markdown(html, want):
    assert to_markdown(html) == want


def test_markdown_deep_and_giant():
    assert to_markdown("<section id=s>" * 1500 + "bottom" + "</section>" * 1500).strip() == "bottom"
    assert to_markdown(f"<p data-x='{'z' * 90_000}'>wide</p>") == "wide\n\n"
    assert decode_reference("&#xD800;") is None and decode_reference("&#0;") is None


def test_links_and_assets(spark):
    html = "<a href='/x'>1</a><A\nHREF=b>2</A><a href='#t'><a href=\"mailto:a\"><a href='/x'><img src=/i.png><link href='http://o/c.css'>"
    df = spark.createDataFrame([("http://h/d/p", html), ("http://h/q", None)], "url string, html string")
    assert [(r.pos, r.dst) for r in extract.link_edges(df).orderBy("pos").collect()] == [(0, "http://h/x"), (1, "http://h/d/b")]
    assert [r.basename for r in extract.page_assets(df).collect()] == ["i.png"]
    assert [r.basename for r in extract.page_assets(df, same_host_only=False).orderBy("pos").collect()] == ["i.png", "c.css"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /admin\nDisallow: /cache\nCrawl-delay: 0.25\n\nUser-agent: webstrata\nDisallow: /drafts"
    rules = robots.robots_rules(spark.createDataFrame([("h", body), ("none", None)], "host string, body string"))
    got = {r.host: (r.disallow, r.crawl_delay_ms) for r in rules.collect()}
    assert got == {"h": (["/admin", "/cache", "/drafts"], 250), "none": ([], 0)}
    pages = spark.createDataFrame([("h", "/"), ("h", "/news/1"), ("h", "/admin/users"), ("h", "/drafts"), ("x", "/admin")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in robots.robots_gate(pages, rules).collect()} == {
        ("h", "/"): True, ("h", "/news/1"): True, ("h", "/admin/users"): False, ("h", "/drafts"): False, ("x", "/admin"): True,
    }


FUZZY = [
    ("first-steps-guide", "first-steps-guide", 100), ("first-step", "first-steps-guide", 100), ("qqq777zz", "first-steps-guide", 0), ("FIRST", "first-steps-guide", 100),
    ("ba", "yaby", 50), ("frist steps", "archive/wiki.strata.test/guide/first-steps/index.md", 82),
]


@pytest.mark.parametrize(("pattern", "text", "want"), FUZZY)
def test_fuzzy(spark, pattern, text, want):
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(fuzzy.match_score(pattern, F.col("t"))).collect()] == [want, 0, None]


def test_fuzzy_spans_and_models_agree(spark):
    assert fuzzy.similarity_span("first steps", FUZZY[-1][1])[1:] == (31, 41)
    assert fuzzy.similarity_span("exact", "an exact one") == (1.0, 3, 7)
    texts = ["ca", "abc", "abcabc", "acb", "xyzzy", "aabbcc", "cba", "bca bac", "A"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("abc", "ca", "bacb", "x" * 70):
        for swaps in (True, False):
            for exact in (True, False):
                got = [r[0] for r in df.select(fuzzy.similarity(pattern, F.col("t"), swaps, exact)).collect()]
                assert got == pytest.approx([fuzzy.similarity_span(pattern, t, swaps, exact)[0] for t in texts]), (pattern, swaps, exact)


def test_metadata(spark):
    rows = [("## Notes\n\n* one\n* two\n",)]
    want = hashlib.sha1(f"blob {len(rows[0][0])}\0{rows[0][0]}".encode()).hexdigest()
    assert one(spark, rows, "t string", metadata.blob_sha(F.col("t"))) == [(want,)]
    packed = one(spark, rows, "t string", metadata.gzip_bytes("t"))[0][0]
    assert gzip.decompress(bytes(packed)).decode() == rows[0][0]
    raw = 'HTTP/1.1 302 F\r\nETag: a\r\n\r\nHTTP/1.1 404 N\r\nServer: s\r\nETag: "b"\r\n\r\nbody HTTP/1.1 \r\n\r\nrest'
    r = spark.createDataFrame([(raw,)], "t string").select(metadata.response_parts(F.col("t")).alias("r")).select("r.*").first()
    assert (r.status_code, r.etag, r.server, r.body) == (404, '"b"', "s", "body HTTP/1.1 \r\n\r\nrest")


def test_extract_field(spark):
    df = spark.createDataFrame([("a b\tc",)], "t string")
    got = df.select(*(fuzzy.extract_field(F.col("t"), None, k) for k in (0, 1, 3, 4)), fuzzy.extract_field(F.col("t"), " ", 2)).first()
    assert tuple(got) == ("a b\tc", "a", "c", "", "b\tc")
