"""Periodic runs of words: a stretch that repeats itself at least three times keeps its first period only.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(MIN_WORDS, EXPONENT * q) words, which neither neighbouring word extends keeping period q.

1. A run of period q matches itself q words on over at least max(MIN_WORDS - q, (EXPONENT - 1) * q) places,
   so it matches at a multiple of that number: the grid of q. All grids together have a harmonic number of
   points, about n ln(n) / 2 for n words.
2. For all (period, grid point) pairs of a block of documents at once, NumPy compares the words; where they
   and a neighbouring pair agree, the longest common extensions to both sides are found by binary search on
   prefix hashes, again for all pairs at once. Documents of a block are divided by marks that match nothing.
3. The words of each run found are compared themselves. Words that differ have different hashes by
   definition of a mismatch, so only equality needs that check; where it fails (two strings of one 64-bit
   hash), the document is done again with exact ranks of all its 1, 2, 4, ... word strings.
4. A run is found for multiples of its period too, with the same ends: the smallest period stays.

Every document is judged by itself, so nothing is shuffled. Memory is bounded by BLOCK_WORDS words and
BLOCK_PAIRS pairs, or by the longest document.

Edge cases: null, empty and short texts have no runs (n_runs 0, four nulls, the hash of nothing); of equal
rows each is judged; a text of one repeated word is one run; very long texts are judged whole; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import clean, let, small_batches, table, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

MIN_WORDS, EXPONENT = 24, 3
#: Words of documents judged together, and (period, grid point) pairs compared at once.
BLOCK_WORDS, BLOCK_PAIRS = 1 << 18, 1 << 20
_STEP = 0xD1342543DE82EF95


class Hashes:
    """Longest common extensions by prefix hashes."""

    def __init__(self, h: np.ndarray):
        self.word, self.power = h, np.full(len(h) + 1, _STEP, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.power[:-1], out=self.sums[1:])

    def levels(self, longest: int) -> list[int]:
        return [1 << k for k in range(longest.bit_length() - 1, -1, -1)]

    def same(self, x, y, n: int) -> np.ndarray:
        """Whether the n words from x and those from y are equal, x < y."""
        return (self.sums[x + n] - self.sums[x]) * self.power[y - x] == self.sums[y + n] - self.sums[y]


class Ranks(Hashes):
    """The same from exact ranks of all strings of 1, 2, 4, ... words; slower, for texts whose hashes collide."""

    def __init__(self, words: list):
        number: dict = {}
        self.word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        self.rank = {1: self.word}
        n = 1
        while 2 * n <= len(words):
            last = self.rank[n]
            self.rank[2 * n] = np.unique(last[: len(last) - n] * (len(words) + 1) + last[n:], return_inverse=True)[1]
            n *= 2

    def levels(self, longest: int) -> list[int]:
        return [n for n in super().levels(longest) if n in self.rank]

    def same(self, x, y, n: int) -> np.ndarray:
        return self.rank[n][x] == self.rank[n][y]


def extensions(h: Hashes, x: np.ndarray, y: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the words from x and y on agree, and how far those before them do; x < y."""
    ahead, back = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    total = len(h.word)
    # The steps are powers of two, so a length is the sum of those that its binary form names.
    for n in h.levels(longest):
        ok = np.flatnonzero(y + ahead + n <= total)
        ok = ok[h.same(x[ok] + ahead[ok], y[ok] + ahead[ok], n)]
        ahead[ok] += n
        ok = np.flatnonzero(x - back - n >= 0)
        ok = ok[h.same(x[ok] - back[ok] - n, y[ok] - back[ok] - n, n)]
        back[ok] += n
    return ahead, back


def grid_pairs(starts: np.ndarray, lengths: np.ndarray, min_words: int, exponent: int, most: int):
    """Blocks of (place, period), the pairs of all documents; a block has about `most` pairs, or one period's."""
    top = np.where(lengths >= min_words, lengths // exponent, 0)
    doc = np.repeat(np.arange(len(lengths)), top)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(top) - top, top) + 1
    step = np.maximum(min_words - period, (exponent - 1) * period)
    count = -(-(lengths[doc] - period) // step)
    ends = np.cumsum(count)
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        c = count[at:end]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(starts[doc[at:end]], c) + nth * np.repeat(step[at:end], c), np.repeat(period[at:end], c)
        at = end


def periodic_runs(h: Hashes, starts: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT, most: int = BLOCK_PAIRS) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the documents at starts; h divides them by marks."""
    word, found = h.word, [np.empty((0, 3), np.int64)]
    longest = int(lengths.max(initial=1))
    for x, p in grid_pairs(starts, lengths, min_words, exponent, most):
        y = x + p
        hit = np.flatnonzero(word[x] == word[y])
        x, y, p = x[hit], y[hit], p[hit]
        # A match is longer than two words, so one of its neighbours agrees too.
        hit = np.flatnonzero((word[x + 1] == word[y + 1]) | (x > 0) & (word[x - 1] == word[y - 1]))
        x, y, p = x[hit], y[hit], p[hit]
        ahead, back = extensions(h, x, y, longest)
        size = ahead + back + p
        run = np.flatnonzero(size >= np.maximum(min_words, exponent * p))
        if len(run):
            s, p = (x - back)[run], p[run]
            found.append(np.unique(np.c_[s, s + size[run], p], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # The same stretch with a multiple of its period comes later.
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs


def runs_of(docs: list[list[bytes]], min_words: int = MIN_WORDS, exponent: int = EXPONENT, hashed=word_hashes, most: int = BLOCK_PAIRS) -> list[np.ndarray]:
    """For each document its runs (start, length, period), by start and period."""
    lengths = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    # A mark after each document: odd multiples of a constant, which as words no two documents share.
    joined = np.empty(int((lengths + 1).sum()), np.uint64)
    for s, n, words in zip(starts.tolist(), lengths.tolist(), docs, strict=True):
        joined[s : s + n] = hashed(words)
    joined[starts + lengths] = np.arange(1, 2 * len(docs), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = periodic_runs(Hashes(joined), starts, lengths, min_words, exponent, most)
    cuts = np.searchsorted(runs[:, 0], np.r_[starts, len(joined)])
    out = []
    for k, words in enumerate(docs):
        own = runs[cuts[k] : cuts[k + 1]] - [starts[k], starts[k], 0]
        if not all(e <= len(words) and words[s : e - p] == words[s + p : e] for s, e, p in own.tolist()):
            own = periodic_runs(Ranks([*words, None]), np.zeros(1, np.int64), lengths[k : k + 1], min_words, exponent, most)
        out.append(np.c_[own[:, 0], own[:, 1] - own[:, 0], own[:, 2]])
    return out


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; then the smallest start, then period."""
    if not len(runs):
        return None
    rate = runs[:, 1] / runs[:, 2]
    near = runs[rate >= rate.max() * (1 - 1e-9)].tolist()  # what floats can't tell apart is compared exactly
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run has after its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed])
    for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    longs = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in longs], T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]
    if with_text:
        run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
        fields += [T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    names = [f.name for f in fields]

    def judged(ids, docs_words):
        columns: list[list] = [[] for _ in names[1:]]
        for words, runs in zip(docs_words, runs_of(docs_words, min_words, exponent), strict=True):
            s, n, p = greatest(runs) or (None, None, None)
            left = b" ".join(collapsed(words, runs))
            row = [len(runs), s, n, p, s if s is None else 1000 * n // p, hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist()).encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
            if with_text:
                row += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], left.decode("utf-8", "replace")]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        if with_text:
            kinds += [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    def judge(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            held, at, total = [], 0, 0
            for i in range(len(texts)):
                held.append((texts[i].as_py() or b"").split())
                total += len(held[-1])
                if total >= BLOCK_WORDS or i == len(texts) - 1:
                    yield judged(ids[at : i + 1], held)
                    held, at, total = [], i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(judge, T.StructType(fields))


def repeating(doc_id: Column, text: Column) -> Column:
    """For every tenth document by crc32 of its id, the text whose words repeat from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int") + 1
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, source(i))), " ")).otherwise("")

    return F.when(h % 10 == 0, let(F.filter(F.split(clean(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), of)).otherwise(text)


def op11_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return collapse_runs(docs.withColumn("text", repeating(F.col("doc_id"), F.col("text"))), with_text=False)
