"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets whole-text counts. A feature is a number of events (symbols, doubled words and so on) out of a number of
places (words, lines, letters); its share goes into a sketch, and so do the numbers of places: counts by bucket, whose
width grows with the value (128 buckets an octave, so a quantile is at most 0.8 % off). Sketches merge by
adding counts, so they come from one partially aggregated groupBy, in any order, with the same result. A
group's fence for a feature is a rate read off its sketches alone: the median share plus SPREAD times the distance to the upper quartile,
plus one event in a document of median size. A group's fences are drawn towards its language's, and those towards
all documents', as if WEIGHT documents of the wider sketch belonged to the group; no size switches anything. Documents
join the fences of their group and fail if any feature has more events than the fence's rate makes likely: more than ERRORS standard
errors above it.

Defined cases: null or blank text has no words and fails the base rule; null language or source is a group
of its own ('' by name); repeated rows are judged each, equal ones alike; an empty table gives no rows; very long texts are counted whole, one
at a time; columns beyond those of documents, whatever their names, pass through the stage untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from webstrata.llm.common import bundled, by_block, mix, picked, texts_of, unbundled
from webstrata.sources.tables import materialise

WINDOW = 5
SPREAD = 6
ERRORS = 4
#: Documents of the wider sketch that a narrower one is blended with.
WEIGHT = 100
#: Features: events, places, and the counted items that one event brings (a repeated window of five words brings ten).
FEATURES = {
    "symbols": ("n_symbols", "n_words", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW), "dup_lines": ("n_dup_lines", "n_lines", 1),
    "capitals": ("n_capitals", "n_letters", 1), "bangs": ("n_bangs", "n_words", 1), "long_words": ("n_long_words", "n_words", 1), "doubled": ("n_doubled", "n_words", 1),
}
PLACES = ["n_words", "n_lines", "n_letters"]
#: Fences of so many groups are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 20_000

_SYMBOLS = b"#*$%&|<>"
_SPACE_OR_TAIL = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_bangs", "n_long_words", "n_doubled"]
_P = [np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in range(WINDOW - 1, -1, -1)]


def repeat_words(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: words that lie in a window found at least twice in that text."""
    n, docs = len(hashes), len(lengths)
    doc = np.repeat(np.arange(docs), lengths)
    if n < WINDOW:
        return np.zeros(docs, np.int64)
    starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    h = hashes.astype(np.uint64)
    key = np.zeros(len(starts), np.uint64)
    for k in range(WINDOW):
        key += mix(h[starts + k]) * _P[k]
    key = mix(key) + mix(doc[starts].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts[twice], 1)
    np.add.at(mark, starts[twice] + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(mark[:n]) > 0, minlength=docs).astype(np.int64)


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    rows, hashes = [], []
    for t in texts:
        words = t.split()  # bytes split at space, \t, \n, \v, \f, \r and nothing else
        lines = [x for x in t.split(b"\n") if x.strip()]
        h = np.fromiter(map(hash, words), np.int64, len(words))
        hashes.append(h)
        rows.append((
            len(words), len(t.translate(None, _SPACE_OR_TAIL)), len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            len(lines), len(t) - len(t.translate(None, _LETTERS)), len(t) - len(t.translate(None, _CAPITALS)), t.count(b"!"),
            sum(len(w) > 40 for w in words), int((h[1:] == h[:-1]).sum()),
        ))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_letters", "n_capitals", "n_bangs", "n_long_words", "n_doubled"]
    out = dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T, strict=True))
    out["n_repeat_words"] = repeat_words(np.concatenate(hashes) if hashes else np.zeros(0, np.int64), out["n_words"])
    return out


def document_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns (not the text) with COUNTS."""
    schema = StructType([*(docs.schema[k] for k in keep), *(StructField(c, LongType()) for c in COUNTS)])

    def run(block: pa.Table) -> pa.Table:
        c = counts_of(texts_of(block.column("text")))
        return pa.table([*(block.column(k) for k in keep), *(pa.array(c[x]) for x in COUNTS)], names=[*keep, *COUNTS])

    return by_block(picked(docs, *dict.fromkeys([*keep, "text"])), run, schema, size=2 << 20)


def features() -> dict[str, Column]:
    """What is sketched, as whole numbers: shares of events in parts of 100,000, and numbers of places."""
    share = lambda a, b, each: F.floor(F.col(a) * 100_000 / (each * F.greatest(F.col(b), F.lit(1)))).cast("long")
    return {k: share(*v) for k, v in FEATURES.items()} | {k: F.col(k) for k in PLACES}


def bucket(x: Column) -> Column:
    """Sketch bucket: exact below 256, then the top eight bits of the value and its size."""
    e = F.greatest(F.length(F.bin(x)) - 8, F.lit(0))
    return (e * 128 + F.call_function("shiftright", x, e)).cast("int")


def upper_value(b: Column) -> Column:
    """Largest value of a bucket."""
    e = F.when(b < 256, 0).otherwise(F.floor(b / 128) - 1).cast("int")
    return (F.call_function("shiftleft", (b - e * 128 + 1).cast("long"), e) - 1).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, feature, b, n): one mergeable sketch for each group and feature. rows: lang, source, COUNTS."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), bucket(v).alias("b")) for k, v in features().items()))).alias("f")
    groups = rows.where("n_words > 0").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), each)
    return groups.groupBy("lang", "source", "f.feature", "f.b").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "feature", "b").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, docs, q50, q75) read off the sketches; a group has a bounded number of buckets."""
    w = Window.partitionBy(*keys, "feature")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("docs", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), upper_value(F.col("b"))))
    return ranked.groupBy(*keys, "feature").agg(F.first("docs").alias("docs"), at(0.5).alias("q50"), at(0.75).alias("q75"))


def rates(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, r_<feature>...): events a place that a document may have, by its group's own sketches."""
    q = quantiles(sketch, *keys)
    of = lambda name, value: F.max(F.when(F.col("feature") == name, F.col(value)))
    rate = lambda k, places: (of(k, "q50") + SPREAD * (of(k, "q75") - of(k, "q50"))) / 100_000 + 1 / F.greatest(of(places, "q50"), F.lit(1))
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), *(rate(k, v[1]).alias(f"r_{k}") for k, v in FEATURES.items()))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, f_<feature>...): the rate of each feature for every group, blended with those of its language and of all."""
    name = lambda df, p: df.select(*(F.col(c).alias(c if c in ("lang", "source", "all") else p + c) for c in df.columns))
    own = name(rates(sketch, "lang", "source"), "o_").withColumn("all", F.lit(1))
    lang = name(rates(merged(sketch, "lang"), "lang"), "l_")
    every = name(rates(merged(sketch.withColumn("all", F.lit(1)), "all"), "all"), "e_")
    joined = own.join(lang, "lang").join(F.broadcast(every), "all")  # one row
    blend = lambda docs, near, far: (docs * near + WEIGHT * far) / (docs + WEIGHT)

    def fence(k: str) -> Column:
        wide = blend(F.col("l_docs"), F.col(f"l_r_{k}"), F.col(f"e_r_{k}"))
        return blend(F.col("o_docs"), F.col(f"o_r_{k}"), wide).alias(f"f_{k}")

    return joined.select("lang", "source", *map(fence, FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(rows: DataFrame, fence_table: DataFrame) -> DataFrame:
    """rows (lang, source, COUNTS and any others) with base_failed, broken (names of rules) and kept."""
    small = fence_table.count() <= BROADCAST_GROUPS
    table = fence_table.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = rows.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))})
    joined = rows.join(F.broadcast(table) if small else table, ["_lang", "_source"], "left").drop("_lang", "_source")

    def beyond(k: str, events: str, places: str, each: int) -> Column:
        likely = F.col(places) * F.col(f"f_{k}")
        return F.when(F.col(events) / each > likely + ERRORS * F.sqrt(likely + 1), F.lit(k))

    broken = F.array_compact(F.array(*(beyond(k, *v) for k, v in FEATURES.items())))
    out = joined.withColumn("base_failed", base_failed()).withColumn("broken", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop(*(f"f_{k}" for k in FEATURES))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, COUNTS, base_failed, broken, kept) for every document. Texts are read once."""
    rows = materialise(document_counts(docs, ["doc_id", "lang", "source"]), "quality")
    return judged(rows, materialise(fences(sketches(rows)), "fences"))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass. Texts stay whole in the scan: each row's verdict is found beside it, not by a join on ids."""
    sketch = sketches(document_counts(docs, ["lang", "source"]))
    table = materialise(fences(sketch), "fences")
    rows = bundled(docs)
    return unbundled(judged(document_counts(rows, rows.columns), table).where("kept"), docs)
