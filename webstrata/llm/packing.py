"""Bounded-space online packing of token sequences.

Each partition keeps OPEN windows of WINDOW ids. A document comes as pieces: whole windows are cut off first, the
rest goes to the window it fits best. When none fits, the fullest window is emitted: if it lacks more
than SLACK ids, the piece's head fills it up first. What is open at the end of a partition is merged with other
partitions' leftovers by the same rule, in groups of partitions of fixed size.

Ids come from a public tokenizer's file. Text is cut at ASCII white space, where that tokenizer never joins,
so each distinct chunk is tokenized once and kept in a bounded memory.

Defined cases: null and empty texts are one end id; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from webstrata.llm.common import blocks, picked, ragged
from webstrata.sources.tables import materialise

TOKENIZER = "word_bpe_49k.json"
END = 2
WINDOW = 4096
OPEN = 64
SLACK = 64
#: Partitions whose leftovers are merged by one task.
GROUP = 32
#: Chunks a worker remembers.
REMEMBERED = 600_000
#: Chunks encoded as one text, and what stands between them: a character that is a token of its own between spaces.
TOGETHER = 2000
MARK = b"\0"
#: What the tokenizer's file does before its model, as its library writes it.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Printable ASCII and the letters U+00C0 to U+00FF in UTF-8, and their words by the pattern above.
_SIMPLE = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\xbf])++|[0-9]|[!-/:-@\[-`{-~]++")


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Number of each chunk; a chunk not seen before takes the next number and is noted."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """Ids of texts by chunk; memory is dropped when it is full.

    Chunks of printable ASCII and Latin-1 letters are cut into the tokenizer's words here and go to its model alone, if its
    file's steps before the model are those of STEPS; all others go through the whole tokenizer."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        steps = json.loads(self.tokenizer.to_str())
        self.simple = {k: steps[k] for k in STEPS} == STEPS
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.words: dict[bytes, list[int]] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.known[b""] = 0  # what stands before and after outer white space

    def word(self, w: bytes) -> list[int]:
        found = self.words.get(w)
        if found is None:
            text = w.decode() if w.isascii() else "".join(map(self.letters.__getitem__, w))
            found = self.words[w] = [t.id for t in self.model.tokenize(text)]
        return found

    def learn(self, chunks: list[bytes]) -> None:
        """Ids of new chunks, in order. Those that need the whole tokenizer are encoded as one text, with a mark between them that
        is one id; chunks that hold the mark go alone."""
        each: list[list[int] | None] = [None] * len(chunks)
        plain = []
        for i, c in enumerate(chunks):
            if self.simple and _SIMPLE.fullmatch(c):
                low = c.lower() if c.isascii() else c.decode().lower().encode()
                found = _WORD.findall(low)
                each[i] = self.word(low) if len(found) == 1 else [x for w in found for x in self.word(w)]
            elif MARK in c:
                each[i] = self.tokenizer.encode(c.decode(), add_special_tokens=False).ids
            else:
                plain.append(i)
        if plain:
            mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids[0]
            for k in range(0, len(plain), TOGETHER):
                some = plain[k : k + TOGETHER]
                text = (b" " + MARK + b" ").join(chunks[i] for i in some).decode()
                ids = np.array([*self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, mark])
                at = 0
                for i, end in zip(some, np.flatnonzero(ids == mark).tolist(), strict=True):
                    each[i], at = ids[at:end].tolist(), end + 1
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text with the end id, all texts of a block at once: each distinct chunk is looked up once a block."""
        if len(self.known) > REMEMBERED:
            self.forget()
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.simple else texts)
        distinct = chunks.flatten().dictionary_encode()
        words = distinct.dictionary.cast(pa.large_binary()).to_pylist()
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        k = number[distinct.indices.to_numpy()]
        lengths = self.lengths[k]
        ids = self.ids[ragged(self.starts[k], lengths)]
        upto = np.append(0, np.cumsum(lengths))[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        return [np.append(x, np.uint32(END)) for x in np.split(ids, upto[1:-1])] if len(texts) else []


#: One for each file and worker process: what a task has learned serves the next.
_encoders: dict[str, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


class Packer:
    """Open windows by free space. Emits (sequence, offset) for each piece; sequences are numbered from `first`."""

    def __init__(self, first: int, window: int = WINDOW, open_windows: int = OPEN, slack: int = SLACK) -> None:
        self.window, self.most, self.slack, self.next = window, open_windows, slack, first
        self.free: list[tuple[int, int]] = []  # (free ids, sequence), sorted

    def new(self) -> tuple[int, int]:
        self.next += 1
        return (self.window, self.next - 1)

    def put(self, length: int) -> list[tuple[int, int, int]]:
        """Cut a document of `length` ids: (sequence, offset, ids) of its pieces in order."""
        out = []
        while length >= self.window:
            out.append((self.new()[1], 0, self.window))
            length -= self.window
        while length:
            at = bisect_left(self.free, (length, -1))
            if at < len(self.free):
                room, s = self.free.pop(at)
                n = length
            elif len(self.free) < self.most:
                (room, s), n = self.new(), length
            else:
                room, s = self.free.pop(0)  # the fullest leaves
                if room <= self.slack:
                    continue
                n = min(room, length)
            out.append((s, self.window - room, n))
            length -= n
            if room > n:
                insort(self.free, (room - n, s))
        return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, keep: str = "doc_id", with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """One row a piece: the kept id column, PIECES, and the ids themselves (little-endian 32 bit) if wanted."""
    kind = docs.schema[keep].dataType.simpleString()
    schema = f"`{keep}` {kind}, {PIECES}, part long, left boolean" + ", ids binary" * with_ids
    names = [keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "left", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer = encoder_of(tokenizer), Packer(part << 32)
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows

        def table(rows: list[tuple], left: bool) -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows, strict=True)) if rows else [()] * (7 + with_ids)
            arrays = [pa.array(cols[0], kept_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            arrays += [pa.array([part] * len(rows), pa.int64()), pa.array([left] * len(rows), pa.bool_())]
            arrays += [pa.array(cols[7], pa.binary())] if with_ids else []
            yield from pa.table(arrays, names=names).to_batches(2000)

        kept_type = pa.null()
        for block in blocks(batches, size=4 << 20):
            kept_type = block.schema.field(keep).type
            texts = pc.fill_null(block.column("text").combine_chunks().cast(pa.large_string()), "")
            done: list[tuple] = []
            for doc, ids in zip(block.column(keep).to_pylist(), encoder.encode(texts), strict=True):
                at = 0
                for s, offset, n in packer.put(len(ids)):
                    piece = ids[at : at + n].astype("<u4").tobytes()
                    row = (doc, at, n, zlib.crc32(piece), len(ids), s, offset)
                    waiting.setdefault(s, []).append((*row, piece) if with_ids else row)
                    at += n
            open_now = {s for _, s in packer.free}
            for s in [s for s in waiting if s not in open_now]:
                done += waiting.pop(s)
            yield from table(done, False)
        yield from table([r for rows in waiting.values() for r in rows], True)

    first = materialise(picked(docs, *dict.fromkeys([keep, "text"])).mapInArrow(run, schema), "packed")
    return first.where("not left").drop("part", "left").unionByName(merged_leftovers(first, keep, schema, names, group))


def merged_leftovers(first: DataFrame, keep: str, schema: str, names: list[str], group: int) -> DataFrame:
    """Windows left open, packed anew: a task takes those of `group` partitions, at most OPEN windows each.

    Pieces move whole, largest first. New windows are numbered from the middle of the group's first partition's range."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        number = (min(t.column("part").to_pylist()) << 32) + (1 << 31)
        windows: list[tuple[int, int]] = []
        seq, off = [], []
        for n in t.column("length").to_pylist():
            at = bisect_left(windows, (n, -1))
            if at < len(windows):
                room, s = windows.pop(at)
            else:
                room, s, number = WINDOW, number, number + 1
            seq.append(s)
            off.append(WINDOW - room)
            insort(windows, (room - n, s))
        for k, v in (("sequence_id", seq), ("offset", off)):
            t = t.set_column(t.column_names.index(k), k, pa.array(v, pa.int64()))
        return t.select(names)

    left = first.where("left").withColumn("_group", F.floor(F.col("part") / group))
    return left.groupBy("_group").applyInArrow(lambda t: merge(t.drop_columns("_group")), schema).drop("part", "left")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return packed(docs, tokenizer_file())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer_file())
