"""Main text of web pages by wrapper induction.

Pages become trees of elements, runs of like siblings taken as one node. For every host a wrapper is learned: the
trees of all its pages, aligned by simple tree matching and united. Then each page is aligned with its host's wrapper,
and all pages' texts are counted by the wrapper's node they stand in. A text that is the same on SHARE of the pages with the node
(LEAST_PAGES at least; pages of the same content count once) belongs to the template, other texts of the node are in a slot.
The wrapper decides first, in all parts of a page. Of the slots, those in parts whose element or name says that they are
menus, adverts, forms, comments and the like (what varies from page to page without being the article) are left out. Article and main marks are a
hint among slots: a page's only marked part is taken alone if it has half of the page's text in slots at least.

Pages are read in one pass; elements nested deeper than DEPTH become siblings there, as in browsers, so no depth of nesting matters.

Defined cases: null html is empty and gives empty text; a host with one page has no template; a page whose url
has no host belongs to host ''; repeated pages are extracted each, equal ones alike; an empty table gives no rows; very long pages are read
whole; of other columns none is read, whatever its name.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import by_block, picked
from webstrata.sources.tables import materialise

#: Pages of a host with different content that a text must be the same on before it counts as template, and their share of
#: the pages with its node.
LEAST_PAGES = 3
SHARE = 0.9
#: A host's shapes are united in so many parts by tasks of their own, then the parts.
PARTS = 64
#: Levels of a page's tree.
DEPTH = 150
#: Wrappers of so many hosts are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 2_000

#: Elements whose text is never shown or never content.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "canvas", "head", "title", "object", "select", "button", "textarea"}
OTHER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2",
    "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | OTHER
#: Parts of class and id names that tell what a part is.
NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav|"
    r"navbar|navigation|newsletter|notice|pagination|popup|promo|promotion|related|replies|respond|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[^a-z])"
)
_TEXT = re.compile(r"[^<]++|<!--.*?(?:-->|\Z)|<[!?][^>]*+>", re.S)
# A quote counts right after an equals sign, and only if it is closed; where that leaves a tag without end, tags end at the next >.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "name", "kids", "texts", "shape")

    def __init__(self, tag: str, name: str) -> None:
        self.tag, self.name = tag, name
        self.kids: list[Node] = []
        self.texts: list[tuple[int, str]] = []  # (number of children before, text)

    def sign(self) -> str:
        return f"{self.tag}.{self.name}"


def tokens(page: str) -> Iterator[tuple[str | None, str, str, int]]:
    """(tag, slash, attributes, end) of each tag, or (None, text, "", end); the reader may send where to go on.

    Linear: a tag that quotes leave without end makes tags end at the next > from there on, and what has no > ahead is text."""
    at, end, last, pattern = 0, len(page), page.rfind(">"), _TAG
    while at < end:
        m = _TEXT.match(page, at)
        if m is not None:
            at = m.end()
            if m[0][0] != "<":
                yield None, m[0], "", at
            continue
        if at > last:
            yield None, page[at:], "", end
            return
        m = pattern.match(page, at)
        if m is None and pattern is _TAG and page[at + 1 : at + 2].strip("/").isalpha() | (page[at + 1 : at + 2] == "/"):
            if (m := _PLAIN_TAG.match(page, at)) is not None:
                pattern = _PLAIN_TAG
        if m is None:
            at += 1
            yield None, "<", "", at
            continue
        at = m.end()
        at = (yield m[2].lower(), m[1], m[3], at) or at


def parse(page: str) -> Node:
    """A tree of block elements; inline elements dissolve into the text of their block."""
    stack = [Node("html", "")]
    opened: Counter[str] = Counter()

    def place() -> Node:
        """The node that takes text: beyond DEPTH a fresh one if others have followed, so that order holds."""
        node = stack[-1]
        if len(stack) > DEPTH and stack[DEPTH - 1].kids[-1] is not node:
            node = stack[-1] = Node(node.tag, node.name)
            stack[DEPTH - 1].kids.append(node)
        return node

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    reader = tokens(page)
    token = next(reader, None)
    while token is not None:
        tag, slash, rest, at = token
        goto = None
        if tag is None:
            node = place()
            node.texts.append((len(node.kids), slash))
        elif tag == "br":
            node = place()
            node.texts.append((len(node.kids), " "))
        elif slash:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
        elif tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            goto = end.end() if end else len(page)
        elif tag in SILENT or tag in BLOCKS and (tag not in VOID or tag == "hr"):
            if tag not in ("html", "body") and len(stack) > 1:
                if stack[-1].tag == "p" and tag in BLOCKS:
                    close(len(stack) - 1)
                if stack[-1].tag in _CLOSED_BY.get(tag, ()):
                    close(len(stack) - 1)
            name = " ".join(sorted({x for g in _NAMED.findall(rest) for x in "".join(g).lower().split()})) if rest else ""
            node = Node(tag, name)
            if len(stack) > DEPTH and is_other(stack[-1]):
                node = Node(stack[-1].tag, stack[-1].name)  # becomes a sibling of its parent, with what that says
            stack[min(len(stack), DEPTH) - 1].kids.append(node)
            if tag != "hr" and not rest.endswith("/"):
                stack.append(node)
                opened[node.tag] += 1
        try:
            token = reader.send(goto)
        except StopIteration:
            token = None
    return stack[0]


def clean(s: str) -> str:
    return " ".join(_html.unescape(s).split())


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """Children with like neighbours together."""
    out: list[tuple[str, list[Node]]] = []
    for k in node.kids:
        if k.tag in SILENT:
            continue
        s = k.sign()
        if out and out[-1][0] == s:
            out[-1][1].append(k)
        else:
            out.append((s, [k]))
    return out


# A shape: (sign, shape) of every run of like children, in order. A host's wrapper is a shape.


@lru_cache(20_000)
def matching(a: tuple, b: tuple) -> tuple[int, tuple]:
    """Simple tree matching of two shapes: the nodes of an order-preserving match with most of them, and its pairs at the top."""
    if not a or not b:
        return 0, ()
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            gain = 1 + matching(a[i][1], b[j][1])[0] if a[i][0] == b[j][0] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain)
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[n][m], tuple(pairs[::-1])


def united(a: tuple, b: tuple) -> tuple:
    """A shape with all nodes of both; matching ones are one."""
    if a == b or not b:
        return a
    out, i, j = [], 0, 0
    for x, y in (*matching(a, b)[1], (len(a), len(b))):
        out += a[i:x] + b[j:y]
        if x < len(a):
            out.append((a[x][0], united(a[x][1], b[y][1])))
        i, j = x + 1, y + 1
    return tuple(out)


def shaped(node: Node) -> tuple:
    """The shape of a node, also noted at it and below."""
    out = []
    for s, nodes in runs(node):
        kids: tuple = ()
        for x in nodes:
            kids = united(kids, shaped(x))
        out.append((s, kids))
    node.shape = tuple(out)
    return node.shape


def as_shape(x: list) -> tuple:
    """A shape from what JSON made of it."""
    return tuple((s, as_shape(kids)) for s, kids in x)


def number(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def find_article(node: Node) -> list[Node]:
    """Outermost article or main parts outside of other parts."""
    if node.tag in ("article", "main"):
        return [node]
    if is_other(node):
        return []
    return [x for k in node.kids for x in find_article(k)]


def is_other(node: Node) -> bool:
    return node.tag in OTHER or node.tag in SILENT or bool(node.name and node.tag not in ("html", "body", "article", "main") and NAMES.search(node.name))


@dataclass
class Block:
    path: str  # of the wrapper's node, empty where the wrapper has no such node
    text: str
    part: Node | None  # the outermost article or main part around it
    named: bool  # in a part whose element or name tells what it is


def blocks(node: Node, wrapper: tuple, path: str, out: list[Block], present: set[str], part: Node | None = None, named: bool = False) -> None:
    """Adds a page's blocks in order; present gets the paths of all nodes."""
    if node.tag in SILENT:
        return
    named = named or is_other(node)
    if part is None and not named and node.tag in ("article", "main"):
        part = node
    present.add(path)
    of: dict[int, int] = {}
    groups = runs(node)
    for i, j in matching(wrapper, node.shape)[1]:
        of.update((id(x), i) for x in groups[j][1])
    text, at = [], 0

    def flush() -> None:
        if s := clean("".join(text)):
            out.append(Block(path, s, part, named))
        text.clear()

    for k, kid in enumerate(node.kids):
        while at < len(node.texts) and node.texts[at][0] <= k:
            text.append(node.texts[at][1])
            at += 1
        flush()
        i = of.get(id(kid))
        blocks(kid, *((), "") if i is None else (wrapper[i][1], f"{path}.{i}"), out, present, part, named)
    text += [s for _, s in node.texts[at:]]
    flush()


def read(page: str, wrapper: tuple) -> tuple[Node, list[Block], set[str]]:
    """A page's tree, its blocks and the nodes of the wrapper on it."""
    tree, out, present = parse(page), [], set()
    shaped(tree)
    blocks(tree, wrapper, "0", out, present)
    return tree, out, present - {""}


def content(page: str, wrapper: tuple, constant: set[tuple[int, int]]) -> tuple[list[str], int, int]:
    """Blocks of a page's main text in order, number of blocks that are template, and of slots left out for their part's name.
    constant: (node, text) of the template, as numbers. If one article or main part has half of the slots' text at least, it is
    the main text; else all of them are."""
    tree, found, _ = read(page, wrapper)
    slots = [x for x in found if (number(x.path), number(x.text)) not in constant]
    left = [x for x in slots if not x.named]
    counts = len(found) - len(slots), len(slots) - len(left)
    marked = [x for x in find_article(tree) if x.kids or x.texts]
    mains = [x for x in marked if x.tag == "main"]
    if len(marked) == 1 or len(mains) == 1:
        mark = (mains if len(mains) == 1 else marked)[0]
        inside = [x.text for x in left if x.part is mark]
        if inside and 2 * sum(map(len, inside)) >= sum(len(x.text) for x in left):
            return inside, *counts
    return [x.text for x in left], *counts


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON): the shapes of all pages of a host united, those of a part of them first."""

    def shapes(t: pa.Table) -> pa.Table:
        each = {(h, json.dumps(shaped(parse(x)))): None for h, x in zip(t.column("host").to_pylist(), t.column("html").to_pylist(), strict=True)}
        return pa.table([pa.array([h for h, _ in each], pa.string()), pa.array([w for _, w in each], pa.string())], names=["host", "wrapper"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        every: tuple = ()
        for w in sorted(pdf["wrapper"], key=lambda w: (-len(w), w)):
            every = united(every, as_shape(json.loads(w)))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(every)]})

    found = by_block(pages.select("host", "html"), shapes, "host string, wrapper string", text="html", size=2 << 20).distinct()
    parts = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))).groupBy("host", "part").applyInPandas(unite, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(unite, "host string, wrapper string")


def with_wrappers(rows: DataFrame, learned: DataFrame) -> DataFrame:
    small = learned.count() <= BROADCAST_HOSTS
    return rows.join(F.broadcast(learned) if small else learned, "host", "left")


def templates(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """(host, constant): (node, text) numbers of the texts that are the same on nearly all pages with their node. Pages count once
    for each different content."""

    def run(t: pa.Table) -> pa.Table:
        known: dict[str, tuple] = {}
        out: set[tuple] = set()
        for h, w, page in zip(t.column("host").to_pylist(), t.column("wrapper").to_pylist(), t.column("html").to_pylist(), strict=True):
            if w not in known:
                known[w] = as_shape(json.loads(w))
            _, found, present = read(page, known[w])
            sign = number("\n".join(x.text for x in found if not x.named))
            out.update((h, number(path), None, sign) for path in present)
            out.update((h, number(x.path), number(x.text), sign) for x in found if x.path)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "node", "text", "sign"])

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    each = by_block(with_wrappers(rows, learned).select("host", "wrapper", "html"), run, "host string, node long, text long, sign long", text="html", size=2 << 20)
    counts = each.distinct().groupBy("host", "node", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    counts = materialise(counts, "counts")
    pages = counts.where("text is null").select("host", "node", F.col("n").alias("pages"))
    same = counts.where("text is not null").join(pages, ["host", "node"]).where(F.col("n") >= SHARE * F.col("pages"))
    return same.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("constant"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_template, n_named) of every page."""
    host = F.lower(F.regexp_extract("url", r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = picked(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    learned = materialise(wrappers(rows), "wrappers")
    learned = materialise(learned.join(templates(rows, learned), "host", "left"), "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        known: dict[str, tuple] = {}
        out = []
        for i, (host, page) in enumerate(zip(t.column("host").to_pylist(), t.column("html").to_pylist(), strict=True)):
            if host not in known:
                same = t.column("constant")[i].as_py() or []
                known[host] = as_shape(json.loads(t.column("wrapper")[i].as_py())), {(x["node"], x["text"]) for x in same}
            texts, template, named = content(page, *known[host])
            out.append(("\n".join(texts), template, named))
        columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.table([t.column("page_id"), t.column("url"), *columns], names=["page_id", "url", "text", "n_template", "n_named"])

    joined = with_wrappers(rows, learned).select("page_id", "url", "host", "html", "wrapper", "constant")
    return by_block(joined, run, f"page_id {kind}, url string, text string, n_template long, n_named long", text="html", size=2 << 20)


def op5(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """n_template: blocks of the page that the wrapper calls template; n_named: slots left out for the name of their part."""
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_named")
