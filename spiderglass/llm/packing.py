"""Packing of tokenized documents into sequences of one length, by Karmarkar-Karp multiway differencing.

1. A task tokenizes its rows as they come. Whole sequences' worth of a long document are sequences of their
   own; what is left of each document is a piece of a block. A block is full at BLOCK sequences' worth of
   tokens; the piece that overfills it is cut there, and its rest begins the next block.
2. The pieces of a block are dealt to its windows by differencing: each piece is a partition of itself and
   empty windows; the two partitions of the largest imbalance (largest less smallest window) merge, the
   heaviest windows of one with the lightest of the other, until one is left, whose windows are near equal.
3. Windows over the capacity: pieces may be cut, so what stands over goes into the windows with room, which
   in a full block come out exactly full. In a task's last block as many windows as its tokens fill are made;
   where that capacity is exceeded, the number of windows rises by ones of 1024, 512, ... tokens, as a power
   of two needs no padding. Without cutting (`cut=False` of `pack`) the number of windows rises, and the
   pieces are dealt again, as long as any window exceeds the capacity.

So no token is padded, and at most one piece a window is cut beside those at blocks' ends. A task holds one
block and one document's ids; nothing is shuffled. All pieces of a sequence come from one task, in order, so
a task that is done again gives the same rows.

A byte-level vocabulary without normalizer splits a text before merges; a worker merges each such token once
and keeps its ids. Latin letters and common marks are split here. Around any other character the tokenizer
itself encodes what stands between white space, which it never joins to a character before. Other vocabularies
get whole texts.

Edge cases: null and empty texts are one id, the final one; the names of special tokens in a text are
ordinary text; equal rows are packed each; a text of any length is cut into windows; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .common import small_batches, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

CAPACITY, FINAL_ID = 2048, 1
#: Sequences of a block.
BLOCK = 256
#: Tokens before merges whose ids a worker keeps, and the longest such token.
KEPT, KEPT_CHARS = 400_000, 64
#: Characters of a text that are tokenized at once, or up to the next white space.
PART = 1 << 20

# The characters of the Unicode property White_Space.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_BREAK = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
# Letters of Latin alphabets and common marks: of these, Python's expressions and the pre-tokenizer's agree.
_LETTER, _MARK = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac"
_ODD = re.compile(rf"[^{_LETTER}{_MARK}0-9\t-\r ]")
# The pattern by which byte-level vocabularies split texts before merges, for those characters.
_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, int]:
    """The letter for each byte by which byte-level vocabularies write it: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


class Tokens(dict):
    """The ids of a token before merges, as bytes of little-endian unsigned 32-bit numbers; split: whether texts may be split so."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        told = json.loads(vocabulary)
        before = told.get("pre_tokenizer") or {}
        self.split = not told.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, token: str) -> bytes:
        merged = self.model.tokenize(token.encode().decode("latin-1").translate(self.letters))
        ids = np.array([t.id for t in merged], "<u4").tobytes()
        if len(token) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[token] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _TOKEN.findall(text)))

    def ids(self, text: str) -> np.ndarray:
        if not self.split:
            return np.frombuffer(self.encoded(text), "<u4")
        parts, at = [], 0
        while at < len(text):
            found = _BREAK.search(text, at + PART) if len(text) - at > PART else None
            part = text[at : found.start() if found else len(text)]
            if _ODD.search(part):
                parts += [self.encoded(unit) if _ODD.search(unit) else self.plain(unit) for unit in _UNIT.findall(part)]
            else:
                parts.append(self.plain(part))
            at += len(part)
        return np.frombuffer(b"".join(parts), "<u4")


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """For each piece its window; windows are near equal in size (Karmarkar-Karp).

    A partition is kept as the sizes of its occupied windows in falling order, less the smallest where all
    are occupied, and a piece for each; merged windows point to one another.
    """
    over = np.full(len(sizes), -1, np.int64)
    # By imbalance; among equal ones the earlier first, so the result depends on the sizes alone.
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (_, _, a, at), (_, _, b, bt) = heapq.heappop(heap), heapq.heappop(heap)
        # The heaviest of a stand alone, those after them meet the lightest of b from the lightest up.
        both = max(0, len(a) + len(b) - windows)
        alone, b, bt = len(a) - both, b[::-1], bt[::-1]
        over[bt[:both]] = at[alone:]
        total = np.concatenate([a[:alone], a[alone:] + b[:both], b[both:]])
        first = np.concatenate([at, bt[both:]])
        order = np.argsort(-total, kind="stable")
        total, first = total[order], first[order]
        if len(total) == windows:
            total = total - total[-1]
        heapq.heappush(heap, (-int(total[0]), made, total, first))
        made += 1
    top = np.arange(len(sizes))
    while (left := over[top] >= 0).any():
        top[left] = over[top[left]]
    return np.unique(top, return_inverse=True)[1] if len(sizes) else top


def pack(sizes: list[int], capacity: int = CAPACITY, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, start in it, length), all tokens of pieces of these sizes, a piece being of the capacity at most."""
    total = sum(sizes)
    if not total:
        return []
    if not cut:
        count = -(-total // capacity)
        while True:
            dealt = differencing(sizes, count)
            if np.bincount(dealt, sizes).max() <= capacity:
                break
            count += 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(int(dealt.max()) + 1)]
        for i, w in enumerate(dealt.tolist()):
            out[w].append((i, 0, sizes[i]))
        return out
    count, rest = divmod(total, capacity)
    # The windows that the tokens don't fill are powers of two, filled with the smallest pieces.
    small = [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]
    pieces = deque((i, 0, sizes[i]) for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)))
    out = [taken(pieces, room) for room in small]
    if not count:
        return out
    held = sorted(pieces)
    dealt = differencing([n for _, _, n in held], count)
    windows: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for piece, w in zip(held, dealt.tolist(), strict=True):
        windows[w].append(piece)
    spare: deque = deque()
    for k, window in enumerate(windows):
        queue = deque(sorted(window, key=lambda p: (-p[2], p)))
        windows[k] = taken(queue, capacity)
        spare += queue
    for window in windows:
        room = capacity - sum(n for _, _, n in window)
        if room:
            window += taken(spare, room)
    return windows + out


def taken(pieces: deque, room: int) -> list[tuple[int, int, int]]:
    """Pieces from the front that fill the room, the last one cut; what is cut off stays in front."""
    out = []
    while room and pieces:
        i, start, n = pieces.popleft()
        if n > room:
            pieces.appendleft((i, start + room, n - room))
            n = room
        out.append((i, start, n))
        room -= n
    return out


class Packer:
    """The pieces of documents in the order in which they come: (document, start, length, ids, tokens, sequence, offset)."""

    def __init__(self, capacity: int, block: int, first_sequence: int):
        self.capacity, self.full, self.next = capacity, capacity * block, first_sequence
        self.held: list[tuple] = []
        self.size = 0

    def add(self, document, ids: np.ndarray):
        n = len(ids)
        whole = n - n % self.capacity
        for at in range(0, whole, self.capacity):
            yield document, at, self.capacity, ids[at : at + self.capacity], n, self.next, 0
            self.next += 1
        at = whole
        while at < n:
            end = min(n, at + self.full - self.size)
            self.held.append((document, at, ids[at:end], n))
            self.size += end - at
            at = end
            if self.size == self.full:
                yield from self.packed()

    def packed(self):
        for window in pack([len(ids) for _, _, ids, _ in self.held], self.capacity):
            offset = 0
            for i, start, n in window:
                document, at, ids, total = self.held[i]
                yield document, at + start, n, ids[start : start + n], total, self.next, offset
                offset += n
            self.next += 1
        self.held, self.size = [], 0


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, final_id: int = FINAL_ID, block: int = BLOCK, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for the pieces of docs (doc_id, text).

    tokenizer: the path of a vocabulary file on the driver, whose content goes to the workers."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast({"vocabulary": f.read()})  # one vocabulary, some MB
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = ["doc_id", *longs, *(["ids"] if with_ids else [])]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in longs], *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches):
        # The same object for all tasks of a worker, so it keeps the tokens met.
        if "tokens" not in held.value:
            held.value["tokens"] = Tokens(held.value["vocabulary"])
        tokens = held.value["tokens"]
        packer = Packer(capacity, block, TaskContext.get().partitionId() << 33)
        kind, rows = None, []
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(final_id))
                rows += packer.add(doc_id.as_py(), ids)
                if len(rows) > 5_000:
                    yield as_batch(rows, kind)
                    rows = []
        rows += packer.packed()
        if rows:
            yield as_batch(rows, kind)

    def as_batch(rows, kind):
        ids = [np.ascontiguousarray(r[3], "<u4") for r in rows]
        numbers = [[r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x) for x in ids], [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows]]
        arrays = [pa.array([r[0] for r in rows], kind), *[pa.array(c, pa.int64()) for c in numbers]]
        if with_ids:
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int64))))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the sequences as they are trained on; starts are the pieces' offsets."""
    from pyspark.sql import functions as F

    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))  # at most the capacity
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def op13_packing(spark, sf_dir):
    import public_tokenizers

    return packed_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
