"""Near duplicates by ProbMinHash.

Shingles of five lower-cased words have equal weights, however often a text repeats them, as links are defined by sets. Each shingle is a stream of exponential arrivals at
random components of the signature; a shingle stops as soon as its next arrival can't be the first of any
component. Two signatures agree in a component with the probability Jaccard of the sets, which at equal weights is their Jaccard similarity. BANDS of
ROWS components make bucket keys. A pair is a link if the exact Jaccard similarity of
the shingle sets is 0.8 or more. Linked texts form classes.

Bands come in a few batches. In a bucket, each text is compared with the bucket's text of the least class, unless
both are in one class already; links then unite classes, and the next batch sees classes, not texts. So a large group of near copies, whose
texts share most buckets, has few pairs a text, not one for each band. Where a bucket still holds texts of different classes, its
texts are joined again by prefix filtering: two sets that similar share one of their rarest shingles. Rounds compare
more and more of such a group's texts with the others of it, until no two of different classes are left that sizes and
places of shingles don't already tell apart. So no two texts in a common bucket that are similar enough end in different classes.
Joins on buckets, classes, compared texts and shingles deal frequent keys to several tasks (`spread_join`).

Defined cases: copies of a text share its class without being compared; texts of one to four words are one
shingle; null and blank texts are alone in a class of their own id; texts
without an id are linked like others, in a class without a name if no row of it has one; repeated rows are copies; empty tables
give no rows; very long texts are worked on one by one; of other columns none is read, whatever its name. A class is named by its
least doc_id; of equal least ids the text with the least hash stands for it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import bundled, by_block, mix, picked, ragged, spread_join, texts_of, unbundled
from webstrata.sources.tables import discard, materialise

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40
SIZE = ROWS * BANDS
#: Node lists of so many rows (8 bytes each) may be broadcast to filter a scan; longer ones are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: So many edges (16 bytes each) may be united on the driver; more are united by rounds of joins.
DRIVER_EDGES = 250_000
#: A round compares about so many texts of each group with the others of it, the next one so many times more.
GROWTH = 8
#: Bands of a batch: from, to. The first ones unite most near copies, so that later ones have little to compare.
BATCHES = [(0, 1), (1, 4), (4, 12), (12, 40)]

_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, mixed 64-bit hashes of all words): lower-cased, cut at ASCII white space; a distinct word is hashed once."""
    chunks = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    distinct = chunks.flatten().dictionary_encode()
    words = distinct.dictionary.view(pa.large_binary()).to_pylist()
    hashed = mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    at = distinct.indices.to_numpy()
    real = np.array([w != b"" for w in words], bool)[at]  # what stands before and after outer white space is no word
    upto = np.append(0, np.cumsum(real))[chunks.offsets.to_numpy()]
    return np.diff(upto), hashed[at[real]]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted by the first: the distinct shingles of each text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes, flat = word_hashes(texts)
    n = np.where(sizes >= WORDS, sizes - WORDS + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(sizes) - sizes
    at = ragged(first, n)
    padded = np.append(flat, np.zeros(WORDS, np.uint64))
    h = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        h += padded[at + k] * _P[k]
    short = np.flatnonzero((sizes < WORDS)[doc])  # texts of fewer words: theirs alone
    left = sizes[doc[short]]
    h[short] = 0
    for k in range(WORDS - 1):
        h[short] += np.where(k < left, padded[at[short] + k], np.uint64(0)) * _P[k]
    h = mix(h)
    key = h ^ mix(doc.astype(np.uint64))
    order = np.argsort(key)
    key = key[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    one, count = order[begins], np.diff(np.append(begins, len(key)))
    place = np.argsort(one)
    one = one[place]
    return doc[one], h[one], count[place]


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash of n weighted sets at once: the shingle that comes first in each component.

    The i-th arrival of a shingle lies in [(i-1)/w, i/w), exponential there, at a random component."""
    rate = np.log1p(1 / (size - 1))
    scale = -np.expm1(-rate)
    first = np.full((n, size), np.inf)
    who = np.zeros(n * size, np.uint64)
    flat = first.reshape(-1)
    inverse = 1 / weight
    i = 0
    while len(doc):
        random = mix(shingle + np.uint64((i * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF))
        component = (mix(random) % np.uint64(size)).astype(np.int64)
        x = -np.log1p(-(random >> np.uint64(11)).astype(np.float64) * (2.0**-53) * scale) / rate
        when = (i + x) * inverse
        place = doc * size + component
        np.minimum.at(flat, place, when)
        won = flat[place] == when
        who[place[won]] = shingle[won]
        i += 1
        # Only sets that still have arrivals are looked at: small ones need many rounds.
        live = np.flatnonzero(np.bincount(doc, minlength=n))
        last = np.zeros(n)
        last[live] = first[live].max(axis=1)
        go = i * inverse < last[doc]
        doc, shingle, inverse = doc[go], shingle[go], inverse[go]
    return who.reshape(n, size)


def band_keys(who: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key a band."""
    bands = who.shape[1] // rows
    parts = who.reshape(len(who), bands, rows)
    key = np.zeros((len(who), bands), np.uint64)
    for k in range(rows):
        key = mix(key + parts[:, :, k])
    return mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, node, keys): node is the text's 64-bit hash (Spark's xxhash64), null where it has no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        texts = texts_of(t.column("text"))
        doc, shingle, _ = shingles(texts)
        has = np.zeros(len(texts), bool)
        has[doc] = True
        keys = band_keys(signatures(doc, shingle, np.ones(len(doc)), len(texts)) if len(doc) else np.zeros((len(texts), SIZE), np.uint64))
        hashed = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in texts], np.uint64).view(np.int64)
        node = pa.array(hashed, mask=~has)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
        return pa.table([t.column("doc_id"), node, lists], names=["doc_id", "node", "keys"])

    return by_block(picked(docs, "doc_id", "text"), run, f"doc_id {kind}, node long, keys array<long>", size=4 << 20)


def texts_for(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given (node, doc_id). Few nodes filter the scan; many join it by shuffle."""
    small = nodes.count() <= BROADCAST_NODES
    rows = picked(docs, "doc_id", "text").withColumn("node", F.xxhash64("text"))
    nodes = nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    found = rows.join(F.broadcast(nodes) if small else nodes, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.dropDuplicates(["node"]).select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, x, y) whose texts' shingle sets are similar enough. One b can be in very many pairs."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = spread_join(both, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b", ["a"], counts=pairs.groupBy("b").agg(F.count("*").alias("n")))

    def run(t: pa.Table) -> pa.Table:
        ta, tb = texts_of(t.column("ta")), texts_of(t.column("tb"))
        index: dict[bytes, int] = {}
        at = np.array([[index.setdefault(x, len(index)), index.setdefault(y, len(index))] for x, y in zip(ta, tb, strict=True)])
        doc, shingle, _ = shingles(list(index))
        cut = np.searchsorted(doc, np.arange(len(index) + 1))
        keep = []
        for x, y in at:
            u, v = shingle[cut[x] : cut[x + 1]], shingle[cut[y] : cut[y + 1]]
            common = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(common >= SIMILARITY * (len(u) + len(v) - common) - 1e-9)
        return t.select(["a", "b", "x", "y"]).filter(pa.array(keep))

    return by_block(both.select("a", "b", "x", "y", "ta", "tb"), run, "a long, b long, x long, y long", text="ta", size=2 << 20)


def looked_up(rows: DataFrame, names: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows with what `names`, one row a key, says of the key. Few names are broadcast, more are joined by shuffle."""
    return rows.join(F.broadcast(names), key, how) if names.count() <= BROADCAST_NODES else spread_join(rows, names, key, by, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node that the edges (x, y) lead to."""
    if edges.count() > DRIVER_EDGES:
        return components_by_joins(edges)
    x, y = (c.to_numpy() for c in edges.select("x", "y").toArrow().columns)
    node, label = least_reached(x, y)
    return edges.sparkSession.createDataFrame(pa.table({"node": node, "class": label}))


def least_reached(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the least one that each leads to."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        u, v = label[a[apart]], label[b[apart]]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))  # a root hangs below a lesser one
        while len(np.flatnonzero(label[label] != label)):
            label = label[label]
    return nodes, nodes[label]


def components_by_joins(edges: DataFrame) -> DataFrame:
    """The same of any number of edges. Labels spread over edges and jump along themselves."""
    both = materialise(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(edges.select(F.col("y").alias("a"), F.col("x").alias("b"))), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), "labels")
    while True:
        near = looked_up(both, labels.withColumnRenamed("node", "b"), "b", ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("class", "near").alias("next"), F.col("class").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("class").alias("over"))
        new = looked_up(spread, jump, "next", ["node"])
        new = materialise(new.select("node", F.least("next", "over").alias("class"), (F.least("next", "over") != F.col("was")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.drop("moved")
        labels._stored_at = new._stored_at
        if not moved:
            discard(both)
            return labels


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, class) after links between the classes x and y."""
    between = links.select("x", "y").distinct()
    if not links.limit(1).count():
        return labels
    new = components(between).select(F.col("node").alias("class"), F.col("class").alias("_new"))
    out = looked_up(labels, new, "class", ["node"], "left")
    return materialise(out.select("node", F.coalesce("_new", "class").alias("class")), "classes")


def paired(members: DataFrame, labels: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(a, b, x, y): members (key, node) of a bucket beside the bucket's member b of the least class y, if theirs (x) is another."""
    now = materialise(members.join(labels, "node"), "members")
    heads = now.groupBy("key").agg(F.min(F.struct("class", "node")).alias("h"), F.max("class").alias("top")).where("h.class < top")
    heads = heads.select("key", F.col("h.node").alias("b"), F.col("h.class").alias("y"))
    both = spread_join(now, heads, "key", ["node"]).where(F.col("class") != F.col("y"))
    return untried(both.select(F.col("node").alias("a"), "b", F.col("class").alias("x"), "y"), tried)


def untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    pairs = pairs.distinct()
    if tried is not None:
        pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(tried, ["lo", "hi"], "left_anti").drop("lo", "hi")
    return materialise(pairs, "pairs")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, node, size, left): for each text its rarest shingles, as many as no set similar enough can all miss.

    Rarity is the number of the given texts with the shingle, counted beforehand by hash. size: the text's shingles; left:
    those of them, from this one to the most frequent, that other texts have as well."""

    def run(t: pa.Table) -> pa.Table:
        doc, shingle, _ = shingles(texts_of(t.column("text")))
        return pa.table([pa.array(np.asarray(t.column("node"))[doc]), pa.array(shingle.view(np.int64))], names=["node", "key"])

    every = materialise(by_block(texts, run, "node long, key long", size=2 << 20), "shingles")
    counts = materialise(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # A shingle of one text alone joins nothing, but takes a place in the prefix.
    sizes = every.groupBy("node").agg(F.count("*").alias("size"))
    shared = spread_join(every, counts, "key", ["node"], counts=counts)
    listed = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("s")).join(sizes, "node")
    take = F.col("size") - F.ceil(F.lit(SIMILARITY) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("s"))
    first = F.posexplode(F.slice("s", F.lit(1), F.greatest(take, F.lit(0)).cast("int"))).alias("at", "x")
    listed = listed.select("node", "size", F.size("s").alias("shared"), first)
    return listed.select("x.key", "node", "size", (F.col("shared") - F.col("at")).alias("left"))


def compared(texts: DataFrame, labels: DataFrame, tried: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """New links, and labels completed by all links between texts of different classes.

    Each text has a random place in [0, 1). A round takes a group's texts below a bound that fits the group's size, and
    pairs them with its texts of other classes beyond the bound before; when the bound has passed 1, nothing is left."""
    groups = materialise(prefixes(texts), "prefixes")
    counts = materialise(groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    groups = spread_join(groups, counts, "key", ["node"], counts=counts)
    groups = materialise(groups.withColumn("place", F.xxhash64("node") / F.lit(2.0**64) + 0.5), "groups")
    reach, found = 1, []
    while True:
        classed = materialise(groups.where(F.col("n") > reach).join(labels, "node"), "classed")
        mixed = classed.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key")
        rest = materialise(spread_join(classed, mixed, "key", ["node"], "left_semi"), "mixed")
        if not rest.limit(1).count():
            return found, labels
        done = F.lit(0.0) if reach == 1 else F.lit(float(reach)) / F.col("n")
        rest = rest.where(F.col("place") >= done)
        reach *= GROWTH
        now = rest.where(F.col("place") < F.lit(float(reach)) / F.col("n")).select(
            "key", F.col("node").alias("rep"), F.col("size").alias("rsize"), F.col("left").alias("rleft"), F.col("class").alias("rclass")
        )
        # In the group of their rarest common shingle, two texts have no more in common than follows it in either.
        enough = F.least("left", "rleft") * (1 + SIMILARITY) >= SIMILARITY * (F.col("size") + F.col("rsize")) - 1e-6
        both = spread_join(rest, now, "key", ["node"]).where((F.col("class") != F.col("rclass")) & enough)
        # Of a pair that meets twice, once from either side, one is enough.
        pair = F.col("node") < F.col("rep")
        both = both.select(
            F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"),
            F.when(pair, F.col("class")).otherwise(F.col("rclass")).alias("x"), F.when(pair, F.col("rclass")).otherwise(F.col("class")).alias("y"),
        )
        pairs = untried(both, tried)
        more = materialise(verified(pairs, texts), "links")
        tried = tried.unionByName(ordered(pairs))
        found.append(more)
        labels = united(labels, more)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, links, node, head) for every document; head is the node that stands for the class, with class_id."""
    rows = materialise(sketched(docs), "sketch")
    # One document stands for the copies of a text.
    first = rows.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))
    nodes = materialise(first, "nodes")
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    counts = materialise(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    crowd = materialise(spread_join(members, counts, "key", ["node"], counts=counts), "crowd")
    discard(counts)
    used = materialise(crowd.select("node").distinct(), "used")
    texts = materialise(texts_for(docs, used.join(nodes.select("node", "doc_id"), "node")), "texts")
    labels = used.select("node", F.col("node").alias("class"))
    tried, edges = None, []
    for lo, hi in BATCHES:
        pairs = paired(crowd.where(F.col("band").between(lo, hi - 1)).select("key", "node"), labels, tried)
        links = materialise(verified(pairs, texts), "links")
        tried = ordered(pairs) if tried is None else tried.unionByName(ordered(pairs))
        edges.append(links)
        labels = united(labels, links)
    # Buckets whose texts are in several classes: three texts at least, as one pair alone has been tried.
    named = materialise(crowd.where("n > 2").select("key", "node").join(labels, "node"), "named")
    mixed = named.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key")
    open_nodes = materialise(spread_join(named, mixed, "key", ["node"], "left_semi").select("node").distinct(), "open")
    discard(crowd)
    discard(named)
    if open_nodes.limit(1).count():
        more, labels = compared(texts.join(open_nodes, "node", "left_semi"), labels, tried)
        edges += more
    links = reduce(DataFrame.unionByName, edges).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = nodes.select("node", "doc_id").join(labels, "node", "left").join(links, "node", "left")
    named = named.select("node", "doc_id", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    named = materialise(named, "named")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    heads = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), least["node"].alias("head"), F.count("*").alias("n"))
    # Most classes are of one text, which is its own head.
    large = materialise(heads.where("n > 1").drop("n"), "heads")
    table = looked_up(named, large, "class", ["node"], "left").select(
        "node", F.coalesce("class_id", "doc_id").alias("class_id"), "links", F.coalesce("head", "node").alias("head")
    )
    table = materialise(table, "classes")
    for x in (nodes, texts, named, large):
        discard(x)
    copies = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"))
    out = spread_join(rows.select("doc_id", "node"), table, "node", ["doc_id"], "left", counts=copies)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), "node", "head")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """verified_links: compared pairs of the text that are links. Pairs inside a class are mostly not compared, so a text can have
    more links than that."""
    return classes(docs).select("doc_id", "class_id", F.col("links").alias("verified_links"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies: of each class one text stays, that of the least id, or one without an id if none has any;
    of repeated rows one. Rows are told apart by id and text, as ids can be missing or not unique."""
    found = materialise(classes(docs), "classes")
    stays = (F.col("node") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = materialise(found.where(F.col("node").isNotNull() & ~stays).select(F.col("doc_id").alias("_gone"), "node").distinct(), "gone")
    repeated = found.where("node is not null").groupBy("doc_id", "node").count().where("count > 1").limit(1).count()
    small = gone.count() <= BROADCAST_NODES
    gone = F.broadcast(gone) if small else gone
    rows = bundled(docs).withColumn("_node", F.xxhash64("text"))
    left = rows.join(gone, (F.col("_node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    left = unbundled(left, docs)
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
