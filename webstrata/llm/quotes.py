"""Chat formatting by quotation linking.

A line's quote level is the number of `>` it starts with. Lines of one level without a blank line between them are a paragraph, whatever
their breaks; passages are its sentences and its lines, so quotes that were wrapped anew or cut are found. Their normalised text (letters and
digits, lower case) is hashed. A quoted passage of any level belongs to the earliest message of the conversation that says it
itself. A message replies to the earlier one with most of its first-level passages, of equals the latest; deeper levels tell which
messages it quotes by way of others. Messages without quotes, or whose quotes nobody said, start a thread. Threads follow the replies to their
roots. The text that remains has no quotes, no lines that introduce them, and no blank lines around. A conversation is read in the order of
`position`: by thread, then turn, so replies come after what they reply to.

Earliest messages come from one partial aggregation, so a passage that everyone repeats costs one row a task. Positions come from ranges of
sorted messages and their sizes, not from one task a conversation; joins deal a large conversation to several tasks.

Defined cases: null text is empty; null roles stay null; rows of equal conversation and turn share their links and stand in order of role and
text; messages with a null conversation or turn start a thread of their own and have no position; repeated rows are kept; very long texts are read
whole; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import by_block, picked, spread_join
from webstrata.sources.tables import discard, materialise

_QUOTE = re.compile(r"(?:[ \t]*+>)+")
#: A line that only introduces a quote: kept out of the text when a quote follows.
_INTRODUCTION = re.compile(r"(?:on\b.{0,120}\bwrote|am\b.{0,120}\bschrieb\b.{0,60}|le\b.{0,120}\ba écrit|el\b.{0,120}\bescribió)[ \t]*:[ \t]*", re.I)
_SENTENCE = re.compile(r"[.!?…][ \t]+")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def normalised(passage: str) -> str:
    return _OTHER.sub(" ", passage.lower()).strip()


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line) of every line."""
    out = []
    for raw in text.replace("\r\n", "\n").split("\n"):
        m = _QUOTE.match(raw)
        rest = raw[m.end() :] if m else raw
        out.append((m[0].count(">"), rest[1:] if rest[:1] in (" ", "\t") else rest) if m else (0, raw))
    return out


def unquoted(lines: list[tuple[int, str]]) -> str:
    """The message's own words."""
    after = [k for k, _ in lines[1:]] + [0]
    return "\n".join(x for (k, x), n in zip(lines, after, strict=True) if k == 0 and not (n > 0 and _INTRODUCTION.fullmatch(x))).strip(" \t\n\r\f\v")


def passages(lines: list[tuple[int, str]]) -> set[tuple[int, str]]:
    """(level, normalised passage), each once."""
    found, part, level = set(), [], 0
    for k, x in [*lines, (-1, "")]:
        if part and (k != level or not x.strip()):
            found |= {(level, normalised(s)) for s in (*_SENTENCE.split(" ".join(part)), *part)}
            part = []
        level = k
        if x.strip():
            part.append(x)
    return {(k, p) for k, p in found if p}


def read(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, max_level, levels, hashes): one row a message, read once."""
    keep = ["conv_id", "turn", "role"]
    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in keep)

    def run(t: pa.Table) -> pa.Table:
        rows = []
        for x in t.column("text").to_pylist():
            lines = levels(x or "")
            found = sorted(passages(lines))
            quoted = [k for k, _ in lines if k]
            rows.append((unquoted(lines), len(quoted), max(quoted, default=0), [k for k, _ in found], [xxhash.xxh64_intdigest(p) - (1 << 63) for _, p in found]))
        types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.table([*(t.column(c) for c in keep), *columns], names=[*keep, "text", "n_quoted", "max_level", "levels", "hashes"])

    return by_block(picked(messages, *keep, "text"), run, f"{kinds}, text string, n_quoted long, max_level int, levels array<int>, hashes array<long>", size=2 << 20)


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of messages that reply, by jumping along the links; all others are roots."""
    at = materialise(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("over"), F.col("depth").alias("more"))
        key = F.xxhash64("conv_id", "thread")
        joined = spread_join(at.withColumn("_k", key), up.withColumn("_k", key).withColumnsRenamed({"conv_id": "_c", "thread": "_t"}), "_k", ["turn"], "left")
        same = (F.col("_c") == F.col("conv_id")) & (F.col("_t") == F.col("thread"))
        moved = joined.where("_c is null or (_c = conv_id and _t = thread)").select(
            "conv_id", "turn", "reply_to", F.when(same, F.col("over")).otherwise(F.col("thread")).alias("thread"),
            (F.col("depth") + F.when(same, F.col("more")).otherwise(0)).alias("depth"), F.coalesce(same, F.lit(False)).alias("moved"),
        )
        new = materialise(moved, "threads")
        discard(at)
        at = new
        if not new.where("moved").limit(1).count():
            return at.drop("moved")


def positioned(rows: DataFrame) -> DataFrame:
    """rows with `position` in their conversation, from 0: ranges of sorted rows are numbered apart, offsets are a row a range."""
    spark = rows.sparkSession
    named = rows.where("conv_id is not null and turn is not null")
    order = ["conv_id", "thread", "turn", "role", "text"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(named.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumns({"p": F.shiftright("m", 33), "i": F.col("m").bitwiseAND((1 << 33) - 1)}).drop("m")
    before, total = [], 0
    for p, n in sorted((r["p"], r["count"]) for r in ranged.groupBy("p").count().collect()):  # a row a range
        before.append((p, total))
        total += n
    at = ranged.join(F.broadcast(spark.createDataFrame(before, "p long, before long")), "p").withColumn("g", F.col("before") + F.col("i")).drop("p", "i", "before")
    starts = at.groupBy("conv_id").agg(F.min("g").alias("start"))
    placed = spread_join(at, starts, "conv_id", ["turn"]).withColumn("position", F.col("g") - F.col("start")).select(*rows.columns, "position")
    others = rows.where("conv_id is null or turn is null")
    return placed.unionByName(others.withColumn("position", F.lit(None).cast("long")))


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, max_level, quotes, reply_to, thread, depth, position): one row a message. quotes: the messages
    that it quotes as level:turn:passages, by level, then turn."""
    rows = materialise(read(messages), "messages")
    each = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.arrays_zip("levels", "hashes")).alias("x"))
    each = each.select("conv_id", "turn", F.col("x.levels").alias("level"), F.col("x.hashes").alias("p"))
    quoted = materialise(each.where("level > 0").distinct(), "quoted")
    asked = quoted.select("conv_id", "p").distinct()
    said = each.where("level = 0").join(asked, ["conv_id", "p"], "left_semi").groupBy("conv_id", "p").agg(F.min("turn").alias("origin"))
    votes = quoted.join(said, ["conv_id", "p"]).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))
    votes = materialise(votes, "votes")
    of = F.transform(F.array_sort(F.collect_list(F.struct("level", "origin", "n"))), lambda x: F.concat_ws(":", x["level"].cast("string"), x["origin"].cast("string"), x["n"].cast("string")))
    parents = votes.groupBy("conv_id", "turn").agg(F.array_join(of, ",").alias("quotes"), F.max_by(F.when(F.col("level") == 1, F.col("origin")), F.when(F.col("level") == 1, F.struct("n", "origin"))).alias("reply_to"))
    parents = materialise(parents, "parents")
    at = threads(parents.where("reply_to is not null"))
    links = parents.select("conv_id", "turn", "quotes").join(at, ["conv_id", "turn"], "left")
    out = rows.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted", "max_level", F.coalesce("quotes", F.lit("")).alias("quotes"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    return positioned(out)


def op6(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """Messages without quotes and their place in the conversation."""
    return linked(messages)


#: The same by DuckDB.
SQL = r"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM conversations),
l0 AS (SELECT rid, conv_id, turn, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM m),
l AS (SELECT rid, conv_id, turn, k, length(regexp_replace(regexp_extract(raw, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
  regexp_replace(raw, '^(?:[ \t]*>)+[ \t]?', '') AS line FROM l0),
n AS (SELECT *, lead(level, 1, 0) OVER (PARTITION BY rid ORDER BY k) AS next, trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) = '' AS blank,
  CASE WHEN level <> lag(level) OVER (PARTITION BY rid ORDER BY k) THEN 1 ELSE 0 END AS changed FROM l),
g AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE changed END) OVER (PARTITION BY rid ORDER BY k) AS part FROM n),
own AS (SELECT rid, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (level = 0 AND NOT (next > 0 AND regexp_full_match(line,
  '(?i)(?:on\b.{0,120}\bwrote|am\b.{0,120}\bschrieb\b.{0,60}|le\b.{0,120}\ba écrit|el\b.{0,120}\bescribió)[ \t]*:[ \t]*'))), ''), '^\s+|\s+$', '', 'g') AS text,
  count(*) FILTER (level > 0) AS n_quoted, CAST(max(level) AS INTEGER) AS max_level FROM g GROUP BY rid),
para AS (SELECT rid, conv_id, turn, level, string_agg(line, ' ' ORDER BY k) AS t FROM g WHERE NOT blank GROUP BY rid, conv_id, turn, level, part),
units AS (SELECT conv_id, turn, level, unnest(regexp_split_to_array(t, '[.!?…][ \t]+')) AS p FROM para UNION ALL SELECT conv_id, turn, level, line FROM g WHERE NOT blank),
u AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS p FROM units WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT conv_id, p, min(turn) AS origin FROM u WHERE level = 0 AND p <> '' GROUP BY ALL),
votes AS (SELECT u.conv_id, u.turn, level, origin, count(*) AS n FROM u JOIN said s ON u.conv_id = s.conv_id AND u.p = s.p WHERE level > 0 AND origin < u.turn GROUP BY ALL),
q AS (SELECT conv_id, turn, string_agg(level || ':' || origin || ':' || n, ',' ORDER BY level, origin) AS quotes FROM votes GROUP BY ALL),
par AS (SELECT conv_id, turn, origin AS reply_to FROM votes WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, origin DESC) = 1),
r AS (SELECT conv_id, turn, reply_to, reply_to AS thread, 1::BIGINT AS depth FROM par
  UNION ALL SELECT r.conv_id, r.turn, r.reply_to, par.reply_to, depth + 1 FROM r JOIN par ON par.conv_id = r.conv_id AND par.turn = r.thread),
root AS (SELECT conv_id, turn, any_value(reply_to) AS reply_to, arg_max(thread, depth) AS thread, max(depth) AS depth FROM r GROUP BY conv_id, turn),
o AS (SELECT m.conv_id, m.turn, role, own.text, n_quoted, max_level, coalesce(quotes, '') AS quotes, reply_to, coalesce(thread, m.turn) AS thread, coalesce(depth, 0) AS depth FROM m JOIN own USING (rid)
  LEFT JOIN q ON q.conv_id = m.conv_id AND q.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY thread, turn, role NULLS FIRST, text) - 1 END AS position FROM o"""
