"""Katz backoff language model, order two, counted and evaluated over the whole corpus.

Tables: words (hash, count, number by falling count), bigram counts by bucket (packed, sorted), backoff weights by
word. A word seen r <= TOP times is discounted by Good-Turing, the mass goes to the one unknown word. After a
history h seen c(h) times, a word seen with it r times has d(r) * r / (c(h) + 1), any other has
a(h) * P(word): one count is held back beside the Good-Turing discounts, so that backing off is never
impossible, and a(h) makes the sum over all words and the unknown one exactly 1. Histories never seen back off with
weight 1. A text's first history is a start mark; its last token is an end mark.

How it runs: a task turns a block of texts (BLOCK_BYTES) into numbers of a dictionary of its own. Dictionaries meet in one
aggregation, words are numbered by falling count, numbers go back to the blocks. A block sends each of its distinct bigrams once, with its
training count there, to a bucket by history (histories that could fill a bucket: by both words), as sorted, compressed arrays. So the
most frequent bigram costs its bucket one entry a block, not one an occurrence. A bucket adds up and returns to each block
the totals of its bigrams, in the order they came; the block then scores its documents and lists what backs
off. Counts of counts have at most sqrt(2 N) rows, so the count of a word follows from its number everywhere.

Defined cases: null text is empty and has the end mark alone; a null id counts as empty text for the fold; repeated rows are
learned and scored each; with no training rows every text has probability 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from webstrata.llm.common import BLOCK_BYTES, blocks, mix, picked, remainder, texts_of
from webstrata.sources.tables import discard, materialise

FOLDS, HELD_OUT = 5, 1
TOP = 5
#: Tokens a bucket is meant to hold.
BUCKET_TOKENS = 1_500_000
TOTALS, HISTORY, MODEL, COUNTS = range(4)
SCORE, BACK = range(2)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b""
PART = {"kind": pa.int32(), "bucket": pa.int64(), "block": pa.int64(), "h": pa.int64(), "n": pa.int64(), "x": pa.list_(pa.int64()), "s": pa.float64(), "data": pa.binary()}
PART_SCHEMA = "kind int, bucket long, block long, h long, n long, x array<long>, s double, data binary"
SCORED = {"kind": pa.int32(), "block": pa.int64(), "doc": pa.int32(), "h": pa.int64(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "s": pa.float64()}
SCORED_SCHEMA = "kind int, block long, doc int, h long, n long, known long, base double, s double"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Equally long 32-bit arrays, byte planes apart, compressed."""
    m = np.stack([a.astype("<u4") for a in arrays]) if arrays else np.zeros((0, 0), "<u4")
    planes = m.reshape(len(arrays), -1, 1).view(np.uint8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(data: bytes, arrays: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(arrays, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(arrays, -1).astype(np.int64)


def wide(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit counts as two 32-bit arrays: a bigram can be seen more than 2 ** 32 times."""
    return x & 0xFFFFFFFF, x >> 32


def narrow(halves: np.ndarray) -> np.ndarray:
    return halves[0] | halves[1] << 32


def discounts(n: list[float], top: int = TOP) -> np.ndarray:
    """d(0) to d(top) from the counts of counts n[1] to n[top + 1].

    Where those don't fall as Good-Turing needs, their log-linear fit over log r serves; where that doesn't either
    (few words, or a corpus of copies), (r - 1/2) / r."""
    r = np.arange(1, top + 2)
    if min(n[1 : top + 2]) > 0:
        slope, level = np.polyfit(np.log(r), np.log(n[1 : top + 2]), 1)
        for m in (np.array(n[1 : top + 2]), np.exp(level + slope * np.log(r))):
            common = (top + 1) * m[top] / m[0]
            d = (r[1:] * m[1:] / (r[:-1] * m[:-1]) - common) / (1 - common) if common < 1 else np.zeros(top)
            if ((d > 0) & (d < 1)).all():
                return np.append(1.0, d)
    return np.append(1.0, (r[:-1] - 0.5) / r[:-1])


@dataclass
class Unigrams:
    """Counts and probabilities of word numbers, which fall by count. len = vocabulary; that number is the unknown word."""

    values: np.ndarray  # distinct counts, falling
    ends: np.ndarray  # numbers up to which each reaches
    docs: int  # training documents: the count of the start mark

    def __post_init__(self) -> None:
        per = np.diff(np.concatenate([[0], self.ends]))
        self.size = int(self.ends[-1]) if len(self.ends) else 0
        if self.size > 2**31 - 2:
            raise ValueError("word numbers take 31 bits")
        self.total = int((self.values * per).sum())
        n = [0.0] * (TOP + 2)
        for v, k in zip(self.values, per, strict=True):
            if v <= TOP + 1:
                n[int(v)] = float(k)
        d = discounts(n)
        kept = np.where(self.values <= TOP, d[np.minimum(self.values, TOP)], 1.0) * self.values
        left = self.total - float((kept * per).sum())
        held = left if left > 1e-9 else 1.0
        whole = float((kept * per).sum()) + held
        self.log = np.log10(np.append(kept, held) / whole) if whole else np.zeros(1)
        base = self.total + 0.5 * (self.size + 1)
        self.base = np.log10((np.append(self.values, 0) + 0.5) / base)

    def level(self, number: np.ndarray) -> np.ndarray:
        """Which count a number has; the last level is that of the unknown word."""
        return np.searchsorted(self.ends, number, "right")

    def count(self, number: np.ndarray) -> np.ndarray:
        """Counts, the start mark's (size + 1) included."""
        return np.where(number > self.size, self.docs, np.append(self.values, 0)[self.level(np.minimum(number, self.size))])


def blocked(docs: DataFrame) -> DataFrame:
    """One row a block: ids and folds of its documents, their lengths, tokens, and the dictionary with training counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = picked(docs, "doc_id", "text").withColumn("train", remainder(F.col("doc_id"), FOLDS) != HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 12  # a task has fewer than 4096 blocks, a block fewer than 2 ** 23 words
        for k, t in enumerate(blocks(batches, size=BLOCK_BYTES)):
            words: dict[bytes, int] = {}
            number, tokens, lengths = words.setdefault, [], []
            for x in texts_of(t.column("text")):
                split = x.translate(_LOWER).split()
                split.append(_END)
                tokens.append(np.array([number(w, len(words)) for w in split], np.int64))
                lengths.append(len(split))
            train = np.array(t.column("train").to_pylist(), bool)
            if k >= 1 << 12 or len(words) > 1 << 23:
                raise ValueError("more than 4,096 blocks in a task or 2 ** 23 words in a block: use more, smaller partitions")
            flat = np.concatenate(tokens)
            counts = np.bincount(flat[np.repeat(train, lengths)], minlength=len(words))
            hashed = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)
            one = lambda v, kind: pa.array([v], pa.list_(kind))
            yield from pa.table(
                [pa.array([part + k]), pa.array([t.column("doc_id").combine_chunks().to_pylist()], pa.list_(t.schema.field("doc_id").type)), one(train, pa.bool_()),
                 one(lengths, pa.int32()), pa.array([squeezed(flat)]), one(hashed, pa.int64()), one(counts, pa.int64())],
                names=["block", "ids", "train", "lengths", "tokens", "words", "counts"],
            ).to_batches()

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, lengths array<int>, tokens binary, words array<long>, counts array<long>")


def numbered(words: DataFrame) -> DataFrame:
    """(word, c, number): numbers from 0 by falling count, from a range partitioning and the partitions' sizes."""
    spark = words.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = words.repartitionByRange(parts, F.desc("c"), "word").sortWithinPartitions(F.desc("c"), "word")
    ranged = materialise(ranged.withColumn("m", F.monotonically_increasing_id()), "words")
    ranged = ranged.select("word", "c", F.shiftright("m", 33).alias("p"), F.col("m").bitwiseAND((1 << 33) - 1).alias("i"))
    sizes = sorted((r["p"], r["count"]) for r in ranged.groupBy("p").count().collect())  # one row a partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "p long, before long")
    return ranged.join(F.broadcast(offsets), "p").select("word", "c", (F.col("before") + F.col("i")).alias("number"))


def tabled(types: dict, kind: int, rows: int, **columns) -> pa.Table:
    """Rows of one kind; columns not given are null."""
    columns["kind"] = np.full(rows, kind, np.int32)
    return pa.table([pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in types.items()], names=list(types))


def is_hot(uni: Unigrams, buckets: int, h: np.ndarray) -> np.ndarray:
    """Histories that could fill a bucket."""
    return uni.count(h) > max(1, uni.total // (8 * buckets))


@dataclass
class Bigrams:
    """A block's tokens after seen histories, and its distinct bigrams by bucket, history and word."""

    doc: np.ndarray  # of each token
    at: np.ndarray  # each token's bigram
    h: np.ndarray  # of each bigram
    w: np.ndarray
    bucket: np.ndarray


def bigrams_of(uni: Unigrams, buckets: int, doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> Bigrams:
    seen = uni.count(h) > 0
    doc = doc[seen]
    pair, at = np.unique(h[seen] << 32 | w[seen], return_inverse=True)
    h, w = pair >> 32, pair & 0xFFFFFFFF
    key, hot = h.astype(np.uint64), is_hot(uni, buckets, h)
    key[hot] ^= mix(w[hot].astype(np.uint64))
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return Bigrams(doc, rank[at], h[order], w[order], bucket[order])


def histories(uni: Unigrams, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths of a block's documents, document, history and word of each token)."""
    lengths = np.array(row["lengths"], np.int64)
    w = unsqueezed(row["tokens"], 1)[0]
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.cumsum(lengths) - lengths] = uni.size + 1
    return lengths, np.repeat(np.arange(len(lengths)), lengths), h, w


def sent(uni: Unigrams, buckets: int, row: dict) -> Iterator[tuple[int, bytes]]:
    """What a block sends to a bucket: its bigrams with their training counts."""
    g = bigrams_of(uni, buckets, *histories(uni, row)[1:])
    count = np.bincount(g.at, weights=np.array(row["train"], bool)[g.doc], minlength=len(g.h)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(g.bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(g.bucket)), strict=True):
        yield int(g.bucket[a]), squeezed(np.diff(g.h[a:b], prepend=0), g.w[a:b], count[a:b])


def counted(uni: Unigrams, buckets: int, t: pa.Table, keep_model: bool) -> list[pa.Table]:
    """A bucket's answer: to each block the totals of its bigrams, and what the histories' weights need."""
    parts = [unsqueezed(d, 3) for d in t.column("data").to_pylist()]
    names, bucket = t.column("block").to_pylist(), t.column("bucket")[0].as_py()
    key = np.concatenate([np.cumsum(p[0]) << 32 | p[1] for p in parts])
    pair, which = np.unique(key, return_inverse=True)
    r = np.bincount(which, weights=np.concatenate([p[2] for p in parts]), minlength=len(pair)).astype(np.int64)
    cut = np.append(0, np.cumsum([p.shape[1] for p in parts]))
    data = [squeezed(*wide(r[which[a:b]])) for a, b in zip(cut, cut[1:], strict=False)]
    out = [tabled(PART, TOTALS, len(parts), bucket=[bucket] * len(parts), block=names, data=data)]
    # Histories that need a weight, as they back off: of seen words, the tally by r and the probability without history.
    h, w, seen = pair >> 32, pair & 0xFFFFFFFF, r > 0
    need = seen & (is_hot(uni, buckets, h) | np.isin(h, h[~seen]))
    hs, place = np.unique(h[need], return_inverse=True)
    share = np.bincount(place, weights=10.0 ** uni.log[uni.level(w[need])], minlength=len(hs))
    tally = np.stack([np.bincount(place, weights=r[need] == k, minlength=len(hs)) for k in range(1, TOP + 1)]).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tally.size + 1, TOP), pa.int32()), pa.array(np.ascontiguousarray(tally.T).ravel()))
    out.append(tabled(PART, HISTORY, len(hs), h=hs, n=uni.count(hs), s=share, x=lists))
    out.append(tabled(PART, COUNTS, 1, x=[[int((r == k).sum()) for k in range(1, TOP + 2)]]))
    if keep_model:
        data = squeezed(np.diff(h[seen], prepend=0), w[seen], *wide(r[seen]))
        out.append(tabled(PART, MODEL, 1, bucket=[bucket], n=[int(seen.sum())], data=[data]))
    return out


def judged(uni: Unigrams, buckets: int, d: np.ndarray, row: dict) -> list[pa.Table]:
    """A block's documents: figures without backoff weights, and how often which history backs off.

    A bigram seen r times adds log10(d(r) r / (c(h) + 1)), another the word's own probability."""
    lengths, doc, h, w = histories(uni, row)
    n, level = len(lengths), uni.level(w)
    known = np.bincount(doc, weights=level < len(uni.values), minlength=n).astype(np.int64)
    base = np.bincount(doc, weights=uni.base[level], minlength=n)
    lost = uni.count(h) == 0  # histories never seen
    score = np.bincount(doc[lost], weights=uni.log[level[lost]], minlength=n).astype(float)  # an empty count is of integers
    g = bigrams_of(uni, buckets, doc, h, w)
    parts = sorted(row["totals"] or [], key=lambda x: x["bucket"])
    r = np.concatenate([narrow(unsqueezed(x["data"], 2)) for x in parts]) if parts else np.zeros(0, np.int64)
    if len(r) != len(g.h):
        raise ValueError("totals don't fit the block's bigrams")
    kept = np.where(r <= TOP, d[np.minimum(r, TOP)], 1.0) * r
    with np.errstate(divide="ignore"):
        value = np.where(r > 0, np.log10(kept) - np.log10(uni.count(g.h) + 1.0), uni.log[uni.level(g.w)])
    score += np.bincount(g.doc, weights=value[g.at], minlength=n)
    off = r[g.at] == 0
    back, times = np.unique(g.h[g.at[off]] << 32 | g.doc[off], return_counts=True)
    block = row["block"]
    return [
        tabled(SCORED, SCORE, n, block=[block] * n, doc=np.arange(n), n=lengths, known=known, base=base, s=score),
        tabled(SCORED, BACK, len(back), block=[block] * len(back), doc=back & 0xFFFFFFFF, h=back >> 32, n=times),
    ]


def by_row(df: DataFrame, f: Callable[[dict], Iterator[pa.Table]], schema: str) -> DataFrame:
    """mapInArrow over single rows, each a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for t in f(b.slice(k, 1).to_pylist()[0]):
                    yield from t.to_batches()

    return df.mapInArrow(run, schema)


@dataclass
class Model:
    """The stored tables: words (word, c, number), parts (kind MODEL: bigram counts by bucket, TOTALS: what blocks are told), weights
    (h, log_alpha), blocks (ids, folds, lengths and word numbers of their documents)."""

    words: DataFrame
    parts: DataFrame
    weights: DataFrame
    blocks: DataFrame
    uni: Unigrams
    d: np.ndarray
    buckets: int


def fitted(docs: DataFrame, keep_model: bool = True, bucket_tokens: int = BUCKET_TOKENS) -> Model:
    spark = docs.sparkSession
    block_rows = materialise(blocked(docs), "lm-blocks")
    entries = block_rows.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
    words = materialise(numbered(entries.where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))), "lm-words")
    # Distinct counts: at most sqrt(2 N) rows.
    levels = sorted(((r["c"], r["count"]) for r in words.groupBy("c").count().collect()), reverse=True)
    figures = block_rows.select(
        F.sum(F.size(F.filter("train", lambda x: x))).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")
    ).first()
    uni = Unigrams(np.array([c for c, _ in levels], np.int64), np.cumsum([n for _, n in levels], dtype=np.int64), figures["docs"] or 0)
    buckets = max(1, -(-(figures["tokens"] or 0) // bucket_tokens))
    # A word's place in its block goes with the block's number in one long, then with the word's own.
    asked = block_rows.select("block", F.posexplode("words").alias("at", "word"))
    asked = asked.select((F.shiftleft("block", 24) + F.col("at")).alias("place"), "word").join(words.select("word", "number"), "word")
    told = asked.select(F.shiftright("place", 24).alias("block"), (F.shiftleft(F.col("place").bitwiseAND((1 << 24) - 1), 40) + F.col("number")).alias("e"))
    told = told.groupBy("block").agg(F.collect_list("e").alias("told"))
    full = block_rows.select("block", "lengths", "tokens", F.size("words").alias("size")).join(told, "block", "left")
    shared = spark.sparkContext.broadcast(uni)

    def renumber(row: dict) -> Iterator[pa.Table]:
        numbers = np.full(row["size"], shared.value.size, np.int64)
        told = np.array(row["told"] or [], np.int64)
        numbers[told >> 40] = told & ((1 << 40) - 1)
        tokens = squeezed(numbers[unsqueezed(row["tokens"], 1)[0]])
        yield pa.table([pa.array([row["block"]]), pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([tokens])], names=["block", "lengths", "tokens"])

    numbers = by_row(full, renumber, "block long, lengths array<int>, tokens binary").withColumnRenamed("block", "_block")
    ids = block_rows.select("block", "ids", "train")
    numbers = materialise(ids.join(numbers, F.col("block") == F.col("_block")).drop("_block"), "lm-numbers")
    discard(block_rows)

    def send(row: dict) -> Iterator[pa.Table]:
        for bucket, data in sent(shared.value, buckets, row):
            yield pa.table([pa.array([bucket]), pa.array([row["block"]]), pa.array([data])], names=["bucket", "block", "data"])

    def count(t: pa.Table) -> pa.Table:
        return pa.concat_tables(counted(shared.value, buckets, t, keep_model))

    pairs = by_row(numbers.select("block", "train", "lengths", "tokens"), send, "bucket long, block long, data binary")
    parts = materialise(pairs.groupBy("bucket").applyInArrow(count, PART_SCHEMA), "lm-parts")
    sums = parts.where(F.col("kind") == COUNTS).agg(*(F.coalesce(F.sum(F.col("x")[k]), F.lit(0)) for k in range(TOP + 1))).first()
    d = discounts([0.0, *map(float, sums)])
    held = sum((F.sum(F.col("x")[k - 1]) * float(k * (1 - d[k])) for k in range(1, TOP + 1)), F.lit(1.0))
    alpha = (held / (F.max("n") + 1.0)) / (1.0 - F.sum("s"))
    weights = parts.where(F.col("kind") == HISTORY).groupBy("h").agg(F.log10(alpha).alias("log_alpha"))
    return Model(words, parts, weights, numbers, uni, d, buckets)


def bigrams(model: Model) -> DataFrame:
    """(bucket, h, w, c): the model's bigram counts as a plain table. h and w are numbers of words; the start mark is V + 1."""

    def unpack(row: dict) -> Iterator[pa.Table]:
        x = unsqueezed(row["data"], 4)
        yield pa.table([pa.array(np.full(x.shape[1], row["bucket"])), pa.array(np.cumsum(x[0])), pa.array(x[1]), pa.array(narrow(x[2:]))], names=["bucket", "h", "w", "c"])

    return by_row(model.parts.where(F.col("kind") == MODEL).select("bucket", "data"), unpack, "bucket long, h long, w long, c long")


def scored(model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    shared = model.blocks.sparkSession.sparkContext.broadcast((model.uni, model.buckets, model.d))
    totals = model.parts.where(F.col("kind") == TOTALS).groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("totals"))
    rows = model.blocks.select("block", "lengths", "tokens").join(totals, "block", "left")
    every = materialise(by_row(rows, lambda row: judged(*shared.value, row), SCORED_SCHEMA), "lm-scored")
    back = every.where(F.col("kind") == BACK).select("h", "block", "doc", "n").join(model.weights, "h", "left")
    # A history without seen words has given all its mass away: the start mark of a corpus without training texts.
    back = back.groupBy("block", "doc").agg(F.sum(F.col("n") * F.coalesce("log_alpha", F.lit(0.0))).alias("b"))
    sums = every.where(F.col("kind") == SCORE).select("block", "doc", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.col("base").alias("base_score"), "s")
    ids = model.blocks.select("block", F.posexplode(F.arrays_zip("ids", "train")).alias("doc", "e"))
    out = ids.join(sums, ["block", "doc"]).join(back, ["block", "doc"], "left")
    return out.select(
        F.col("e.ids").alias("doc_id"), (~F.col("e.train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.uni.total).cast("long").alias("train_tokens"),
        "base_score", (F.col("s") + F.coalesce("b", F.lit(0.0))).alias("score"),
    )


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scored(fitted(docs))
