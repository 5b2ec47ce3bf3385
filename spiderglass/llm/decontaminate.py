"""Benchmark decontamination by a generalised suffix automaton over normalised test items.

The automaton is built over the items' words. Training texts stream through it word by word; the
length of the longest match that ends at each word tells which words lie inside an occurrence of an
item window. Items are dealt by the hash of their id to shards of about `max_item_words` words and
`max_item_bytes` bytes (their sum over all items is measured first), and one shard at a time comes to the
driver and is broadcast; a worker builds a shard's automaton once, whatever the number of its tasks. With
one shard, as for usual test sets, the texts are read once. With several, each shard is a pass over the texts
that returns spans of the rows it hits, and spans are joined to their rows.

Edge cases: a null or empty text has no words and is clean; a very long text is scanned whole, its spans
alone are kept; an item without words matches nothing; an item of fewer than `window` words is one window;
repeated items (same words, other ids) all count, rows of one id are one item; a null id is an item of its own, listed first
and written as nothing in the digest, as the empty id is, which is another item; repeated rows are judged each for itself; an item longer
than a shard is a shard of its own size; empty tables give no hits; other columns of the input stay as they
are, and the added names are `n_words, n_hit, n_items, item_ids, items_sha256, contaminated` (input columns
of these names give way).
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import small_batches, stash, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

WINDOW = 10
#: Of a shard of items: an automaton holds about a kilobyte a word.
MAX_ITEM_WORDS, MAX_ITEM_BYTES = 400_000, 32 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids, with item sets for windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[tuple[int, int, int]] = []
        runs = []
        for number, (_, words) in enumerate(items):
            ids = [self.ids.setdefault(w, len(self.ids)) for w in words]
            runs.append((number, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.items = [None if i is None else str(i) for i, _ in items]
        self.windows: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, set[int]]]] = {}
        for number, ids in runs:
            if len(ids) >= window:
                state = length = 0
                for w in ids:
                    state, length = self._step(state, length, w)
                    if length >= window:
                        self.windows.setdefault(self._at(state, window), set()).add(number)
            elif ids:
                state = 0
                for w in ids:
                    state = self.next[state][w]
                ends.append((state, len(ids), number))
        for state, length, number in ends:
            for n, found in self.short.setdefault(state, []):
                if n == length:
                    found.add(number)
                    break
            else:
                self.short[state].append((length, {number}))
        # The nearest state on each suffix path, itself included, where a short item ends.
        self.mark = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.mark[s] = s if s in self.short else self.mark[self.link[s]] if s else -1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _step(self, state: int, length: int, w: int) -> tuple[int, int]:
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            length = self.length[state]
        if w in nxt[state]:
            return nxt[state][w], length + 1
        return 0, 0

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words of a match that state stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered spans of words (end exclusive, in order, disjoint) and the numbers of the items found."""
        nxt, link, depth, mark, window = self.next, self.link, self.length, self.mark, self.window
        get, root = self.ids.get, self.next[0]
        state = length = 0
        spans: list[tuple[int, int]] = []
        tops: set[int] = set()
        found: set[int] = set()
        for i, word in enumerate(words):
            w = get(word)
            if w is None:
                state = length = 0
                continue
            step = nxt[state].get(w)
            if step is None:
                while state:
                    state = link[state]
                    step = nxt[state].get(w)
                    if step is not None:
                        break
                if step is None:
                    step = root[w]
                    state = length = 0
                length = depth[state]
            state = step
            length += 1
            start = -1
            if length >= window:
                start = i + 1 - length
                tops.add(state)
            m = mark[state]
            while m >= 0:
                for n, numbers in self.short[m]:
                    if n <= length:
                        start = min(start, i + 1 - n) if start >= 0 else i + 1 - n
                        found |= numbers
                m = mark[link[m]] if m else -1
            if start >= 0:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for state in tops:
            found |= self.windows.get(self._at(state, window), set())
        return spans, found


def _scanned(held: dict, text: bytes, window: int) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words of a text, spans of those hit, and the ids of items found. held is a broadcast shard, the same object
    for all tasks of a worker, so it keeps the automaton."""
    if "automaton" not in held:
        held["automaton"] = Automaton([(i, normal_words(t)) for i, t in held["items"]], window)
    words = normal_words(text)
    spans, found = held["automaton"].scan(words)
    return len(words), merged(spans), in_order({held["automaton"].items[n] for n in found})


def in_order(ids) -> list[str | None]:
    """Item ids as strings in order, the null one first."""
    return sorted(set(ids), key=lambda i: (i is not None, i or ""))


def _shards(items: DataFrame, max_item_words: int, max_item_bytes: int) -> list[DataFrame]:
    """items (item_id, text), dealt so that a shard's words and bytes are about the given numbers at most."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1))
    n, size = rows.agg(F.sum(words), F.sum(F.octet_length("text") + 16)).first()
    shards = max(1, -(-(n or 0) // max_item_words), -(-(size or 0) // max_item_bytes))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) if shards > 1 else rows for k in range(shards)]


ADDED = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("item_ids", T.ArrayType(T.StringType())), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS, max_item_bytes: int = MAX_ITEM_BYTES, remove: bool = False, max_coverage: float = 0.5) -> DataFrame:
    """docs with hit counts. With remove, the hit words' spans leave the text, and documents over max_coverage leave whole."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(*[c for c in docs.columns if c not in dict(ADDED)])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in ADDED]])
    columns, held = base.columns, []
    for shard in _shards(items, max_item_words, max_item_bytes):
        # A shard's size is bounded above.
        held.append(spark.sparkContext.broadcast({"items": [(r["item_id"], r["text"].encode()) for r in shard.toLocalIterator()]}))

    def finished(batch, rows):
        """The batch with what (text, n_words, spans, ids) of each row says."""
        out: list[list] = [[] for _ in ADDED]
        kept = []
        for text, n_words, spans, names in rows:
            hit = sum(e - s for s, e in spans)
            for column, value in zip(out, (n_words, hit, len(names), names, hashlib.sha256(",".join(i or "" for i in names).encode()).hexdigest(), hit > 0), strict=True):
                column.append(value)
            if remove:
                kept.append(text if not hit else cut(text, spans))
        arrays = [batch.column(c) for c in columns]
        if remove:
            arrays[columns.index("text")] = pa.array([t.decode("utf-8", "replace") if t is not None else None for t in kept], pa.string())
        arrays += [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, *[n for n, _ in ADDED]])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield finished(batch, [(t, *_scanned(held[0].value, t or b"", window)) for t in texts])

    def pass_of(shard):
        """(_r, _r2, spans, ids) of the rows that a shard hits."""

        def hits(batches):
            for batch in batches:
                found = [_scanned(shard.value, t or b"", window)[1:] for t in batch.column("text").cast(pa.binary()).to_pylist()]
                at = [i for i, (spans, _) in enumerate(found) if spans]
                rows = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("_r", "_r2")]
                spans = pa.array([[x for span in found[i][0] for x in span] for i in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows, spans, pa.array([found[i][1] for i in at], pa.list_(pa.string()))], names=["_r", "_r2", "_spans", "_ids"])

        return hits

    def joined(batches):
        for batch in batches:
            rows = []
            for text, spans, ids in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_spans").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                flat = spans or []
                rows.append((text, len(normal_words(text or b"")), merged(list(zip(flat[::2], flat[1::2], strict=True))), in_order(ids or ())))
            yield finished(batch, rows)

    if len(held) == 1:
        result = base.mapInArrow(run, schema)
    else:
        # A row's hits depend on its text only, so rows are named by two hashes of it.
        names = (F.xxhash64("text").alias("_r"), F.xxhash64(F.lit(9), "text").alias("_r2"))
        texts = base.select("text", *names)
        found = [stash(texts.mapInArrow(pass_of(shard), "_r long, _r2 long, _spans array<long>, _ids array<string>").dropDuplicates(["_r", "_r2"]), "item-hits") for shard in held]
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        hits = every.groupBy("_r", "_r2").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_ids")).alias("_ids"))
        hits = hits.withColumnsRenamed({"_r": "_h", "_r2": "_h2"})
        keyed = base.select(*columns, *names)
        result = keyed.join(hits, (F.col("_r") == F.col("_h")) & (F.col("_r2") == F.col("_h2")), "left").select(*columns, "_spans", "_ids").mapInArrow(joined, schema)
    if remove:
        result = result.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    return result


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of spans, from the first byte of a span's first word to the last of its last."""
    flat = text.translate(_WORD_BYTES)
    ends, i, n = [], 0, len(flat)
    while i < n:
        while i < n and flat[i] == 32:
            i += 1
        if i < n:
            j = flat.find(b" ", i)
            j = n if j < 0 else j
            ends.append((i, j))
            i = j
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : ends[s][0]])
        at = ends[e - 1][1]
    return b"".join([*out, text[at:]]).strip()


def op9_decontaminate(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
