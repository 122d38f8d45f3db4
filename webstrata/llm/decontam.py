"""Benchmark decontamination with suffix arrays of the training text.

A shard is a block of whole documents of bounded size: its words as numbers of a dictionary of its own, each document closed by an end
mark of its own, and the suffix array of all of it, built by prefix doubling. Shards don't depend on the benchmark; they are stored as a table. Every
suffix of a benchmark item is looked up in every shard by binary search, word by word: the run of suffixes that start with its first j words
narrows as j grows, until it is empty. At the window's length the run holds all places of the window; where it is
last not empty, the longest verbatim matches. Results are the places, the items, and each document's longest match.

A large benchmark is searched in blocks of bounded size, one after the other; only one is on the driver's way to the executors.

Defined cases: null text has no words; items without words, or without an id, are never found; items with
equal words are all found; an item found often counts once; repeated documents get equal results each; of equally long matches the first in the
document is reported; an empty benchmark or table gives no hits or no
rows; very long texts are a shard by themselves; other columns pass through the stage, whatever their names. Words are lower-cased A-Z and made of
digits, a-z and characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import bundled, by_block, picked, ragged, texts_of, unbundled
from webstrata.sources.tables import LARGE_ROWS, materialise, table

WINDOW = 8
#: A document with windows of so many items is contaminated.
LEAST_ITEMS = 2
#: A document with the whole of a shorter item leaks it if the item has so many words at least.
LEAST_WHOLE = 4
#: Bytes of text of a shard.
SHARD_BYTES = 4 << 20
#: Hashes of so many leaked texts (8 bytes each) may be broadcast; more are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Bytes of benchmark text sent to the executors at once; a larger benchmark is searched in several passes.
BENCHMARK_BLOCK = 16 << 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass
class Benchmark:
    """Items as word numbers from 1, with the places where their windows start."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    item_ids: list
    starts: np.ndarray  # of windows, in tokens
    lengths: np.ndarray  # of windows, WINDOW or the whole of a shorter item
    ends: np.ndarray  # of their items, in tokens
    items: np.ndarray  # of windows, in item_ids


def prepared(rows: list[tuple], window: int = WINDOW) -> Benchmark:
    vocabulary: dict[bytes, int] = {}
    tokens: list[int] = []
    ids, found = [], []
    for item_id, text in rows:
        words = words_of(text.encode() if text else b"")
        if item_id is None or not words:
            continue
        first = len(tokens)
        tokens += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        n = min(window, len(words))
        found += [(first + k, n, len(tokens), len(ids)) for k in range(len(words) - n + 1)]
        ids.append(item_id)
    at = np.array(found, np.int64).reshape(-1, 4).T
    return Benchmark(vocabulary, np.array(tokens, np.int64), ids, at[0], at[1], at[2], at[3])


@dataclass
class Shard:
    """Documents' words and end marks as numbers. Document d ends with number d; words have the numbers after those."""

    tokens: np.ndarray
    order: np.ndarray  # the suffix array: places by the suffixes that start there
    words: list[bytes]
    sizes: np.ndarray  # words of each document


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(tokens, words, sizes) of a shard."""
    chunks = pc.ascii_split_whitespace(pa.array([t.translate(_WORD_BYTES) for t in texts], pa.large_binary()).view(pa.large_string()))
    distinct = chunks.flatten().dictionary_encode()
    words = distinct.dictionary.view(pa.large_binary()).to_pylist()
    at = distinct.indices.to_numpy()
    real = np.array([w != b"" for w in words], bool)[at]  # what stands before and after outer separators is no word
    sizes = np.diff(np.append(0, np.cumsum(real))[chunks.offsets.to_numpy()])
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.empty(int(sizes.sum()) + len(texts), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[ends] = np.arange(len(texts))
    tokens[inside] = at[real] + len(texts)
    return tokens, words, sizes


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Prefix doubling. A suffix's rank is where its group of still equal ones begins; only groups of several are sorted again, by the rank
    k places on. End marks differ, so all suffixes do."""
    n = len(tokens)
    count = np.bincount(tokens) if n else np.zeros(0, np.int64)
    rank = (np.cumsum(count) - count)[tokens]
    open_ = np.flatnonzero(count[tokens] > 1)
    k = 1
    while len(open_):
        key = rank[open_] << 32 | rank[np.minimum(open_ + k, n - 1)]  # a group's members all have a place k on
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        at = np.arange(len(key))
        starts = np.append(True, key[1:] != key[:-1])
        groups = np.append(True, key[1:] >> 32 != key[:-1] >> 32)
        first = np.maximum.accumulate(np.where(starts, at, 0))
        rank[open_] = (key >> 32) + first - np.maximum.accumulate(np.where(groups, at, 0))
        alone = starts & np.append(starts[1:], True)
        open_ = open_[~alone]
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def shard_of(texts: list[bytes]) -> Shard:
    tokens, words, sizes = numbered(texts)
    return Shard(tokens, suffix_array(tokens), words, sizes)


def narrowed(shard: Shard, low: np.ndarray, high: np.ndarray, depth: int, token: np.ndarray, after: bool) -> np.ndarray:
    """In each run [low, high) of suffixes, equal in `depth` words and sorted by the next, the first whose next word is not before the
    token (or is after it)."""
    low, high = low.copy(), high.copy()
    last = len(shard.tokens) - 1
    while (go := low < high).any():
        middle = (low + high) >> 1
        next_word = shard.tokens[np.minimum(shard.order[np.minimum(middle, last)] + depth, last)]
        right = go & ((next_word <= token) if after else (next_word < token))
        low = np.where(right, middle + 1, low)
        high = np.where(go & ~right, middle, high)
    return low


def runs_of(shard: Shard, bench: Benchmark) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(j, windows, low, high) for j = 1, 2, ...: the runs of suffixes that start with the first j words of the item from the window on."""
    number = np.full(len(bench.vocabulary) + 1, -1, np.int64)
    get = bench.vocabulary.get
    for i, w in enumerate(shard.words):
        if (v := get(w)) is not None:
            number[v] = i + len(shard.sizes)
    pattern = number[bench.tokens]
    which = np.arange(len(bench.starts))
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(shard.tokens))
    j = 0
    while len(which):
        place = bench.starts[which] + j
        token = np.where(place < bench.ends[which], pattern[np.minimum(place, len(pattern) - 1)], -1)
        live = token >= 0
        which, low, high, token = which[live], low[live], high[live], token[live]
        low, high = narrowed(shard, low, high, j, token, False), narrowed(shard, low, high, j, token, True)
        live = low < high
        which, low, high = which[live], low[live], high[live]
        j += 1
        if len(which):
            yield j, which, low, high


def search(shard: Shard, bench: Benchmark) -> tuple[list[int], list[list[int]], list[list[int]], list[int], list[int], list[int]]:
    """Per document: words, hit runs as [start, end, ...], numbers of the items found, words of the longest match, its first word, its item."""
    docs = len(shard.sizes)
    first = np.cumsum(shard.sizes + 1) - shard.sizes - 1
    doc = np.repeat(np.arange(docs), shard.sizes + 1)
    mark = np.zeros(len(shard.tokens) + 1, np.int64)
    best, best_at, best_item = np.zeros(docs, np.int64), np.full(docs, -1, np.int64), np.full(docs, -1, np.int64)
    pairs = []
    for j, which, low, high in runs_of(shard, bench):
        long = bench.lengths[which] <= j
        which, low, n = which[long], low[long], (high - low)[long]
        place, window = shard.order[ragged(low, n)], np.repeat(which, n)
        new = bench.lengths[window] == j
        np.add.at(mark, place[new], 1)
        np.add.at(mark, place[new] + j, -1)
        pairs.append(np.stack([doc[place[new]], bench.items[window[new]]]))
        by = np.lexsort((bench.items[window], place))[::-1]  # the first place wins: it is written last
        place, window = place[by], window[by]
        best[doc[place]], best_at[doc[place]], best_item[doc[place]] = j, place - first[doc[place]], bench.items[window]
    runs: list[list[int]] = [[] for _ in range(docs)]
    items: list[list[int]] = [[] for _ in range(docs)]
    hit = np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]])
    begins, stops = np.flatnonzero((hit[1:] == 1) & (hit[:-1] == 0)), np.flatnonzero((hit[1:] == 0) & (hit[:-1] == 1))
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):  # end marks are never hit, so a run never leaves its document
        runs[doc[a]] += [a - int(first[doc[a]]), b - int(first[doc[a]])]
    for k, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T if pairs else ():
        items[k].append(int(i))
    return shard.sizes.tolist(), runs, items, best.tolist(), best_at.tolist(), best_item.tolist()


def search_block(texts: list[bytes], bench: Benchmark) -> tuple[list[int], list[list[int]], list[list[int]], list[int]]:
    return search(shard_of(texts), bench)[:4]


def shards(docs: DataFrame, keep: str) -> DataFrame:
    """The stored table of shards: (ids, sizes, words, tokens, suffixes), arrays of 32-bit numbers as bytes."""
    kind = docs.schema[keep].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        s = shard_of(texts_of(t.column("text")))
        ids = pa.array([t.column(keep).combine_chunks().to_pylist()], pa.list_(t.schema.field(keep).type))
        packed = [pa.array([np.ascontiguousarray(x, "<i4").tobytes()], pa.binary()) for x in (s.sizes, s.tokens, s.order)]
        return pa.table([ids, packed[0], pa.array([s.words], pa.list_(pa.binary())), *packed[1:]], names=["ids", "sizes", "words", "tokens", "suffixes"])

    schema = f"ids array<{kind}>, sizes binary, words array<binary>, tokens binary, suffixes binary"
    return materialise(by_block(picked(docs, keep, "text"), run, schema, size=SHARD_BYTES), "suffix-arrays", options=LARGE_ROWS)


def benchmark_blocks(benchmark: DataFrame, size: int = BENCHMARK_BLOCK) -> Iterator[list[tuple]]:
    """Items in blocks of about `size` bytes, read one at a time."""
    rows = picked(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def found(docs: DataFrame, benchmark: DataFrame, keep: list[str], block: int = BENCHMARK_BLOCK) -> DataFrame:
    """The kept column with n_words, n_hit, items (sorted as strings), longest, longest_at, longest_item: one row a document."""
    (key,) = keep
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "runs", "items", "longest", "longest_at", "longest_item"]
    schema = f"`{key}` {kind}, n_words long, runs array<long>, items array<string>, longest long, longest_at long, longest_item string, _shard long, _pos int"
    stored = shards(docs, key).withColumn("_shard", F.monotonically_increasing_id())
    id_type = [None]

    def searched(rows: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(rows)  # of about `block` bytes of text
        state: dict[str, Benchmark] = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                id_type[0] = batch.schema.field("ids").type.value_type
                for k in range(batch.num_rows):  # a row is a shard
                    row = {c: batch.column(c)[k] for c in batch.schema.names}
                    if "b" not in state:
                        state["b"] = prepared(shared.value)
                    b = state["b"]
                    sizes, tokens, order = (np.frombuffer(row[c].as_buffer(), "<i4").astype(np.int64) for c in ("sizes", "tokens", "suffixes"))
                    n, runs, items, best, at, item = search(Shard(tokens, order, row["words"].as_py(), sizes), b)
                    name = lambda i: str(b.item_ids[i])
                    columns = [
                        pa.array(row["ids"].as_py(), id_type[0]), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted({name(i) for i in x}) for x in items], pa.list_(pa.string())),
                        pa.array(best, pa.int64()), pa.array([x if x >= 0 else None for x in at], pa.int64()), pa.array([name(i) if i >= 0 else None for i in item], pa.string()),
                        pa.array([row["_shard"].as_py()] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)),
                    ]
                    yield from pa.table(columns, names=[*names, "_shard", "_pos"]).to_batches(10_000)

        return stored.mapInArrow(run, schema)

    every, parts = None, 0
    for rows in benchmark_blocks(benchmark, block):
        one, parts = searched(rows), parts + 1
        every = one if every is None else every.unionByName(one)
    if parts > 1:
        top = F.max_by(F.struct("longest", "longest_at", "longest_item"), F.struct("longest", -F.col("longest_at"), "longest_item"))
        every = every.groupBy("_shard", "_pos").agg(
            F.first(key).alias(key), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), top.alias("top"),
        ).select(key, "n_words", "runs", "items", "top.*")
    return _with_hits(every, [key])


def _with_hits(df: DataFrame, keep: list[str]) -> DataFrame:
    """Words covered by runs that may overlap: pairs sorted by start, counted beyond the furthest end so far."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("runs") / 2 - 1, F.lit(0)).cast("int")),
        lambda i: F.struct(F.get("runs", 2 * i).alias("a"), F.get("runs", 2 * i + 1).alias("b")),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(
        F.array_sort(pairs), start,
        lambda s, p: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(p["a"], s["end"]))).alias("n"), F.greatest(s["end"], p["b"]).alias("end")
        ),
        lambda s: s["n"],
    )
    return df.select(*keep, "n_words", F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(total).alias("n_hit"), "items", "longest", "longest_at", "longest_item")


def op9(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return found(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= LEAST_ITEMS).alias("contaminated"), "longest", "longest_at", "longest_item",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: a full window of one item is enough to leak it, or the whole
    of an item shorter than that. Items of fewer than LEAST_WHOLE words can be common phrases, so a document goes for them only if
    it holds LEAST_ITEMS."""
    source = docs.select(F.xxhash64("text").alias("node"), "text")
    leaked = (F.col("longest") >= LEAST_WHOLE) | (F.size("items") >= LEAST_ITEMS)
    gone = materialise(found(source, table(spark, sf_dir, "benchmark"), ["node"]).where(leaked).select(F.col("node").alias("_gone")).distinct(), "leaked")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    rows = bundled(docs)
    return unbundled(rows.join(gone, F.xxhash64("text") == F.col("_gone"), "left_anti"), docs)
