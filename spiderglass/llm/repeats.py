"""Exact substring dedup on windows of words, by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the leftmost run of MINIMISER
words with the smallest hash inside it, so equal windows have equal minimisers. Consecutive windows
with one minimiser form a super-k-mer; it is named by the hash of its minimiser and the hash of its
words (128 bits in all).

1. Each document sends the names of its super-k-mers with the places where they start; no text.
2. Names are counted per minimiser with partial aggregates. A minimiser that stands once in the corpus
   marks windows that occur nowhere else: nothing of it goes on. Where a minimiser has one super-k-mer
   only, in several copies, all its windows are repeated: no text need travel for it either.
3. For a minimiser with several different super-k-mers, each of them travels once, as one packed string
   from one of the documents that hold it, to the minimiser's bucket; there windows are sorted and
   counted exactly, weighted by the strings' numbers of copies. A bucket with more than HOT_BUCKET
   strings is dealt out by its windows instead, which are counted with partial aggregates.
4. The spans found go back to all places of a string, and the documents lose the covered words.

The texts themselves are shuffled once.

Edge cases: null, empty and short texts (fewer words than a window) lose nothing; a window that occurs
twice in one document counts as repeated, overlapping occurrences included; equal texts lose all their
windows' words in every copy; of repeated doc_ids each row counts as a document; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import gram_hashes, mixed, small_batches, stash, table, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

WINDOW, MINIMISER = 35, 8
#: Distinct strings of a bucket beyond which its windows are counted apart.
HOT_BUCKET = 4096
_BLOCK = 1 << 15


def minimiser_starts(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each window of span hashes, where its leftmost smallest hash is."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    for s in range(0, n, _BLOCK):
        view = np.lib.stride_tricks.sliding_window_view(hashes[s : min(s + _BLOCK, n) + span - 1], span)
        out[s : s + len(view)] = view.argmin(axis=1) + np.arange(s, s + len(view))
    return out


def super_kmers(words: list[bytes], window: int, minimiser: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, minimiser hash and hash of the words (signed) of each super-k-mer."""
    if len(words) < window:
        return (np.empty(0, np.int64),) * 4
    h = word_hashes(words)
    grams = gram_hashes(h, minimiser)
    at = minimiser_starts(grams, window - minimiser + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    # A hash of words i to j from sums over a prefix, brought to one scale by the power at i.
    scale = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * scale[0, :-1], out=sums[1:])
    body = mixed((sums[first + n + window - 1] - sums[first]) * scale[1, first] + n.astype(np.uint64))
    return first, n, grams[at[first]].view(np.int64), body.view(np.int64)


_STEP = 0xD1342543DE82EF95
_TABLE: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _TABLE or _TABLE[0].shape[1] < n:
        m = max(n, 1 << 16)
        both = np.ones((2, m), np.uint64)
        for row, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            both[row, 1:] = np.uint64(base)
            np.cumprod(both[row], out=both[row])
        _TABLE[:] = [both]
    return _TABLE[0][:, :n]


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _names(batches, window: int, minimiser: int):
    names = ["row", "row2", "key", "body", "n", "starts"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row, row2, text in zip(batch.column("row").to_pylist(), batch.column("row2").to_pylist(), _texts(batch), strict=True):
            first, n, key, body = super_kmers(text.split(), window, minimiser)
            if not len(first):
                continue
            order = np.lexsort((first, body, key))
            key, body, first, n = key[order], body[order], first[order], n[order]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (body[1:] != body[:-1])])
            count = len(new)
            for column, value in zip(out, (np.full(count, row, np.int64), np.full(count, row2, np.int64), key[new], body[new], n[new].astype(np.int32)), strict=False):
                column.append(value)
            out[5].append((first.astype(np.int32), np.diff(np.r_[new, len(first)])))
        if out[0]:
            arrays = [pa.array(np.concatenate(x)) for x in out[:5]]
            ends = np.r_[0, np.cumsum(np.concatenate([x[1] for x in out[5]]))].astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[0] for x in out[5]])))
            yield pa.RecordBatch.from_arrays([*arrays, starts], names=names)


def find_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """docs (doc_id, text, row, row2): (row, row2, spans), spans being flat word
    positions [start, end, start, end, ...] that repeated windows cover."""
    plain = docs.select("row", "row2", "text")
    sent = stash(plain.mapInArrow(lambda b: _names(b, window, minimiser), "row long, row2 long, key long, body long, n int, starts array<int>"), "superkmers")
    places = F.size("starts").cast("long")
    info = sent.groupBy("key").agg(F.min("body").alias("lo"), F.max("body").alias("hi"), F.sum(places).alias("places")).where("places > 1").select("key", (F.col("lo") != F.col("hi")).alias("several"))
    shared = stash(sent.join(info, "key"), "shared")
    # Each string once, from the first row that has it.
    first = F.min(F.struct("row", "row2", F.element_at("starts", 1).alias("start"), "n"))
    strings = shared.where("several").groupBy("key", "body").agg(first.alias("at"), F.sum(places).alias("copies"))
    strings = stash(strings.select("key", "body", "copies", "at.*"), "strings")
    crowded = stash(strings.groupBy("key").agg(F.count("*").alias("strings")).where(F.col("strings") > hot_bucket).select("key"), "crowded")
    has_crowded = not crowded.isEmpty()

    def packed(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("row", "row2").agg(F.collect_list(F.struct("key", "body", "copies", "start", "n")).alias("wanted"))
        return docs.join(wanted, ["row", "row2"]).mapInArrow(cut_out, "key long, body long, copies long, packed binary")

    def cut_out(batches):
        for batch in batches:
            keys, bodies, copies, packed = [], [], [], []
            for text, wanted in zip(_texts(batch), batch.column("wanted").to_pylist(), strict=True):
                words = text.split()
                for w in wanted:
                    keys.append(w["key"])
                    bodies.append(w["body"])
                    copies.append(w["copies"])
                    packed.append(b" ".join(words[w["start"] : w["start"] + w["n"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.int64()), pa.array(copies, pa.int64()), pa.array(packed, pa.binary())], names=["key", "body", "copies", "packed"])

    def bucket(strings: list[bytes], copies: list[int]) -> list[list[int]]:
        """For each string the flat spans of its words that repeated windows cover."""
        split = [s.split(b" ") for s in strings]
        windows = sorted((b" ".join(w[i : i + window]), c, k, i) for k, (w, c) in enumerate(zip(split, copies, strict=True)) for i in range(len(w) - window + 1))
        hits: list[list[int]] = [[] for _ in strings]
        at = 0
        while at < len(windows):
            end, total = at, 0
            while end < len(windows) and windows[end][0] == windows[at][0]:
                total += windows[end][1]
                end += 1
            if total > 1:
                for _, _, k, i in windows[at:end]:
                    hits[k].append(i)
            at = end
        return [spans_of(sorted(h), window) for h in hits]

    def count_buckets(batches):
        """Rows come sorted by bucket; a bucket may go over the end of a batch."""
        key, held, found = None, [], []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "body", "copies", "packed")], strict=True):
                if row[0] != key and held:
                    found += closed(held)
                    held = []
                key = row[0]
                held.append(row)
            if len(found) > 2000:
                yield as_batch(found)
                found = []
        if held:
            found += closed(held)
        if found:
            yield as_batch(found)

    def closed(held):
        spans = bucket([h[3] for h in held], [h[2] for h in held])
        return [(h[0], h[1], s) for h, s in zip(held, spans, strict=True) if s]

    def as_batch(found):
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["key", "body", "spans"])

    schema = "key long, body long, spans array<int>"
    calm = strings.join(crowded, "key", "left_anti") if has_crowded else strings
    marked = packed(calm).repartition("key").sortWithinPartitions("key").mapInArrow(count_buckets, schema)
    if has_crowded:

        def windows_of(batches):
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                for key, body, packed, copies in zip(*[batch.column(c).to_pylist() for c in ("key", "body", "packed", "copies")], strict=True):
                    w = packed.split(b" ")
                    for i in range(len(w) - window + 1):
                        for column, value in zip(out, (key, body, i, hashlib.sha256(b" ".join(w[i : i + window])).digest()[:16], copies), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "body", "at", "window", "n"])

        each = packed(strings.join(crowded, "key", "left_semi")).mapInArrow(windows_of, "key long, body long, at int, window binary, n long")
        each = stash(each, "windows")
        often = each.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
        hit = each.join(often, "window").groupBy("key", "body").agg(F.sort_array(F.collect_set("at")).alias("at"))
        marked = marked.union(hit.select("key", "body", F.flatten(F.transform("at", lambda i: F.array(i, i + F.lit(window)))).alias("spans")))
    whole = F.array(F.lit(0), F.col("n") + (window - 1))
    found = shared.where("not several").select("row", "row2", "starts", whole.alias("spans")).union(
        shared.where("several").select("row", "row2", "key", "body", "starts").join(marked, ["key", "body"]).select("row", "row2", "starts", "spans")
    )
    moved = F.flatten(F.transform("starts", lambda s: F.transform("spans", lambda x: x + s)))
    return found.groupBy("row", "row2").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def spans_of(starts: list[int], width: int) -> list[int]:
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + width
        else:
            out += [s, s + width]
    return out


def kept_words(words: list[bytes], spans) -> tuple[int, list[bytes]]:
    """How many words the spans cover, and the others."""
    if spans is None or not len(spans):
        return 0, words
    gone = np.zeros(len(words) + 1, np.int64)
    s = np.asarray(spans)
    np.add.at(gone, s[0::2], 1)
    np.add.at(gone, s[1::2], -1)
    gone = np.cumsum(gone)[:-1] > 0
    return int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot_bucket: int = HOT_BUCKET, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    # Rows are told apart by hashes of id and text, so repeated ids with other texts stay apart; equal rows get equal results.
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(7), "text", "doc_id").alias("row2"))
    names = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), *([("kept", T.StringType())] if with_text else [])]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in names]])

    def finish(batches):
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            for text, spans in zip(_texts(batch), batch.column("spans"), strict=True):
                words = text.split()
                n, left = kept_words(words, spans.values.to_numpy(zero_copy_only=False) if spans.is_valid else None)
                joined = b" ".join(left)
                total.append(len(words))
                gone.append(n)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined)
            arrays = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                arrays.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[n for n, _ in names]])

    repeats = find_repeats(base, window, minimiser, hot_bucket)
    return base.join(repeats, ["row", "row2"], "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)


def op7_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
