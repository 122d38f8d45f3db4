"""Quality by supervised subword embeddings.

Every word, character trigram (of bytes) and pair of equal neighbours has a hashed vector; a document is the average
of its vectors, a softmax over two classes follows. Vectors and output are learned by stochastic gradient descent in
numpy, with AdaGrad steps, on at most TRAIN_ROWS labelled documents (those with the least hashes of their
ids), which bounds what reaches the driver. All documents are scored whole.

As the output is linear in the average, each bucket's vector is folded with the output weights into one number
before scoring, which gives the same scores.

Defined cases: null and empty texts have no vectors and score by the bias alone; labels that are null, or of
held-out rows, are never read; without labels of both classes the score is the bias of the one seen, or one
half; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import by_block, picked, ragged, remainder, texts_of

FOLDS, HELD_OUT = 3, 1
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS + 1  # the last: a word equal to the one before
DIM = 8
TRAIN_ROWS = 4000
EPOCHS, BATCH, RATE = 12, 32, 0.3


def _word_buckets(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        b = known.get(w)
        if b is None:
            if len(known) > 500_000:
                known.clear()
            b = known[w] = xxhash.xxh32_intdigest(w) % WORD_BUCKETS
        out[i] = b
    return out


def text_buckets(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Bucket of every feature of a text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    own = _word_buckets(words, known)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    gram = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    gram = (gram * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64) % GRAM_BUCKETS + WORD_BUCKETS
    same = sum(x == y for x, y in zip(words, words[1:], strict=False))
    return np.concatenate([own, gram, np.full(same, BUCKETS - 1, np.int64)])


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: its vector times the difference of the output rows
    bias: float

    def scores(self, texts: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            f = text_buckets(t, known)
            if len(f):
                z[i] += self.weights[f].mean()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def trained(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """features: buckets and counts of each document. Weighted so that both classes count the same."""
    counts = np.bincount(labels, minlength=2) if len(labels) else np.zeros(2)
    if not counts.all():
        return Model(np.zeros(BUCKETS), 0.0 if not counts.any() else 4.0 if counts[1] else -4.0)
    keep = [i for i, (b, _) in enumerate(features) if len(b)]
    features, labels = [features[i] for i in keep], labels[keep]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    sums = [np.full(BUCKETS, 1e-6), np.full((2, DIM), 1e-6), np.full(2, 1e-6)]
    importance = len(labels) / (2 * counts)
    size = np.array([len(b) for b, _ in features])
    start = np.cumsum(size) - size
    buckets = np.concatenate([b for b, _ in features])
    share = np.concatenate([c / c.sum() for _, c in features])
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            at = ragged(start[rows], size[rows])
            b, s = buckets[at], share[at, None]
            doc = np.repeat(np.arange(len(rows)), size[rows])
            hidden = np.add.reduceat(vectors[b] * s, np.cumsum(size[rows]) - size[rows], axis=0)
            logits = hidden @ out.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= importance[labels[rows], None] / len(rows)
            slope = (p @ out)[doc] * s
            unique, back = np.unique(b, return_inverse=True)
            grad = np.stack([np.bincount(back, weights=slope[:, d], minlength=len(unique)) for d in range(DIM)], axis=1)
            sums[0][unique] += (grad**2).mean(axis=1)
            vectors[unique] -= RATE * grad / np.sqrt(sums[0][unique])[:, None]
            for value, g, total in ((out, p.T @ hidden, sums[1]), (bias, p.sum(axis=0), sums[2])):
                total += g**2
                value -= RATE * g / np.sqrt(total)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of at most `rows` labelled documents outside the held-out fold."""
    told = picked(labels, "doc_id", "quality").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).where("quality in (0, 1)")
    told = told.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = picked(docs, "doc_id", "text").join(F.broadcast(told), "doc_id").where("text is not null")  # at most `rows` ids

    def run(t: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        each = [np.unique(text_buckets(x, known), return_counts=True) for x in texts_of(t.column("text"))]
        b = pa.array([np.ascontiguousarray(x, "<i4").tobytes() for x, _ in each], pa.binary())
        c = pa.array([np.ascontiguousarray(x, "<i4").tobytes() for _, x in each], pa.binary())
        return pa.table([t.column("doc_id"), t.column("quality"), b, c], names=["doc_id", "quality", "b", "c"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Repeated documents and copies of an id may exceed the bound again: the least hashes win once more.
    got = by_block(chosen.select("doc_id", F.col("quality").cast("int").alias("quality"), "text"), run, f"doc_id {kind}, quality int, b binary, c binary")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "b").limit(rows).toLocalIterator()
    features, y = [], []
    for r in got:
        features.append((np.frombuffer(r["b"], "<i4").astype(np.int64), np.frombuffer(r["c"], "<i4").astype(np.float64)))
        y.append(r["quality"])
    return features, np.array(y, np.int64)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    known: dict[bytes, int] = {}

    def run(t: pa.Table) -> pa.Table:
        s = Model(*shared.value).scores(texts_of(t.column("text")), known)
        return pa.table([t.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return by_block(picked(docs, "doc_id", "text"), run, f"doc_id {kind}, score double", size=4 << 20)


def op10(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs, trained(*sample(docs, labels)))
    return rows.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
