"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles (as 64-bit hashes). Documents with equal sets are
one class, a node of the graph; it is named by 64 bits of its set's digest, never by a doc_id, and the
smallest doc_id of a component is looked up at the end. Each class has a signature of `slots` b-bit MinHash
values. The signature is split into `chunks` pieces. By pigeonhole, two signatures that differ in at most
2 * chunks - 1 slots have a piece with at most one differing slot, so a key for every way of leaving one
slot out of a piece is shared by every such pair (`slots` keys a class): 21 of 64 slots at 0.85, and more
pieces of a lower threshold (SHAPES): 29 of 90 at 0.8. A slot of a pair at the threshold differs with
probability 0.15 or 0.2; such a pair shares no key with probability 4e-8 or 1.2e-7, and closer pairs less.

Links are confirmed on the full sets. Not all pairs of a bucket are formed:

1. A shingle that no other class of any shared bucket has is no part of an intersection. A class with
   more such shingles than 1 - 0.85 (the threshold) of its set links with nothing and leaves. For pairs, each class
   carries BITS parities of its set: two sets differ in at least as many shingles as parities, so a pair
   whose parities differ too often can't link, and never becomes a row.
2. The rows of a bucket are tried against a pivot, the class with the smallest share of own shingles
   (in a group of edited copies that is the original).
3. Only rows whose component then differs from others of their bucket, and pairs within the bound, are
   tried further: with other pivots while there are many, then pair by pair, so no link that would
   join two components is lost.

Buckets are counted with partial aggregates and joined on their key, so a hot bucket never gathers in
one task.

Edge cases: null, empty or blank texts have empty sets, link with nothing and are kept; fewer words
than a shingle: the whole sequence is the only shingle; equal texts share a component; of repeated doc_ids
each row is judged by its own text, and its rows may be of several components; a very long text's set is made
in one row's memory, about 50 bytes a word; rows with a null doc_id are never linked (their component is null)
and are kept; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from . import common
from .common import components, drop_stash, gram_hashes, small_batches, stash, table, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

SHINGLE = 5
SLOTS, CHUNKS = 64, 11
PERCENT = 85
#: From which threshold on which slots and chunks are used.
SHAPES = {85: (SLOTS, CHUNKS), 80: (90, 15)}
_MOST = max(slots for slots, _ in SHAPES.values())
#: Parities of a set, 64 in a long.
BITS = 1024
#: Rounds with pivots before the rest is tried pair by pair; it is tried at once where that is at most so many pairs for
#: each row of the buckets. A pair costs a comparison of parities in the join; only those within the bound become rows.
PIVOT_ROUNDS, PAIRS_A_ROW = 6, 400
_PIECE = 1024

_RNG = np.random.default_rng(20240229)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 64, (_MOST, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shape(percent: int) -> tuple[int, int]:
    """Slots and chunks for a threshold."""
    fit = [p for p in SHAPES if p <= percent]
    if not fit:
        raise ValueError(f"no signature finds pairs at {percent} % surely")
    return SHAPES[max(fit)]


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


def signature(shingles: np.ndarray, slots: int = SLOTS) -> bytes:
    """Two-byte MinHash values, one a slot."""
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _PIECE):
        h = (shingles[None, i : i + _PIECE] ^ _FLIP[:slots]) * _TIMES[:slots]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, h.min(axis=1), out=low)
    return (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(">u2").tobytes()


def _sketches(batches, slots):
    for batch in batches:
        sets = [shingle_set(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(_digest(s)) if len(s) else None for s in sets], pa.int64()),
                pa.array([signature(s, slots) if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "row", "n_shingles", "id", "sig"],
        )


def _digest(shingles: np.ndarray) -> bytes:
    return xxh3_128_digest(shingles.tobytes())


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        ids = pa.array([_node(_digest(s)) if len(s) else None for s in sets], pa.int64())
        odd = [np.packbits(np.bincount(s & np.uint64(BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.int64) for s in sets]
        yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["id", "set", "odd"])


def _keys(sig: str = "sig", slots: int = SLOTS, chunks: int = CHUNKS):
    """A key for each slot: its piece of the signature without the slot."""
    keys, sizes = [], [slots // chunks + (i < slots % chunks) for i in range(chunks)]
    start = 0
    for size in sizes:
        for i in range(start, start + size):
            keys.append(F.xxhash64(F.lit(i), F.substring(sig, 2 * start + 1, 2 * (i - start)), F.substring(sig, 2 * i + 3, 2 * (start + size - i - 1))))
        start += size
    return F.array(*keys)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    for side in "ba":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}")), side)
    small, large = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    # Sets of too different sizes need no intersection.
    ok = F.when(100 * small < percent * large, False).otherwise(100 * both >= percent * (small + large - both))
    return pairs.where(ok).select("a", "b").distinct()


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(id, n, odd, own): the size of each set, its parities, and how many of its shingles no other set has."""
    alone = sets.select("id", F.explode("set").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("hi")).where("id = hi")
    own = alone.groupBy("id").agg(F.count("*").alias("own"))
    return sets.select("id", F.size("set").alias("n"), "odd").join(own, "id", "left").select("id", "n", "odd", F.coalesce("own", F.lit(0)).alias("own"))


def _may_link(percent: int):
    """Whether two sets (n, odd and n2, odd2) can be enough alike, by the parities in which they differ."""
    apart = [F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("odd2", F.lit(i)))) for i in range(BITS // 64)]
    return (100 + percent) * sum(apart[1:], apart[0]) <= (100 - percent) * (F.col("n") + F.col("n2"))


def _class_components(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """(id, component) of the classes that are linked, over all confirmed links; None if there are none.
    nodes (id, d, r, sig): a class, the row (doc_id and hash of its text) that stands for it, its signature."""
    keyed = nodes.select("id", F.explode(_keys("sig", *shape(percent))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = stash(keyed.join(shared, "key"), "buckets")
    if met.isEmpty():
        return None
    involved = nodes.join(met.select("id").distinct(), "id", "left_semi").select("d", "r")
    chosen = docs.join(involved, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("r")), "left_semi").select("doc_id", "text")
    sets = stash(chosen.select("text").mapInArrow(_sets, "id long, set array<long>, odd array<long>").where("id is not null"), "sets")
    # Rows equal in doc_id and text bring their set more than once.
    facts = _own_shingles(sets).where(100 * F.col("own") <= (100 - percent) * F.col("n")).dropDuplicates(["id"])
    bucket = stash(met.join(facts, "id"), "buckets")
    drop_stash(met)
    n_rows = bucket.count()
    order = F.struct((F.col("own") / F.col("n")).alias("share"), F.col("id"), F.col("n").alias("n2"), F.col("odd").alias("odd2"))
    pivots = bucket.groupBy("key").agg(F.count("*").alias("rows"), F.min(order).alias("p")).where("rows > 1").select("key", F.col("p.id").alias("p"), F.col("p.n2").alias("n2"), F.col("p.odd2").alias("odd2"))
    first = bucket.join(pivots, "key").where((F.col("id") != F.col("p")) & _may_link(percent)).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    tested = stash(first.distinct(), "pairs")
    links = [stash(_confirmed(tested, sets, percent), "links")]
    for attempt in range(1, PIVOT_ROUNDS + 2):
        known = links[0]
        for more in links[1:]:
            known = known.union(more)
        label = components(known)
        now = bucket.join(label, "id", "left").select("key", "id", "n", "odd", F.coalesce("component", "id").alias("c"))
        now = stash(now.join(now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "key", "left_semi"), "apart")
        sizes = now.groupBy("key", "c").agg(F.count("*").cast("double").alias("rows"))
        cost = sizes.groupBy("key").agg(F.sum("rows").alias("r"), F.sum(F.col("rows") * F.col("rows")).alias("q")).agg(F.sum((F.col("r") * F.col("r") - F.col("q")) / 2)).first()[0]
        if not cost:
            return label
        last = attempt > PIVOT_ROUNDS or cost <= PAIRS_A_ROW * n_rows
        if last:
            # Every row outside a bucket's largest component against the rest of the bucket.
            top = sizes.groupBy("key").agg(F.max(F.struct("rows", "c")).alias("t")).select("key", F.col("t.c").alias("top"))
            other = now.join(top, "key").where("c <> top").select("key", F.col("id").alias("p"), F.col("c").alias("pc"), F.col("n").alias("n2"), F.col("odd").alias("odd2"))
        else:
            order = F.struct(F.xxhash64(F.lit(attempt), F.col("id")), F.col("id"), F.col("c"), F.col("n").alias("n2"), F.col("odd").alias("odd2"))
            other = now.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.id").alias("p"), F.col("p.c").alias("pc"), F.col("p.n2").alias("n2"), F.col("p.odd2").alias("odd2"))
        tries = now.join(other, "key").where((F.col("c") != F.col("pc")) & _may_link(percent)).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
        tries = stash(tries.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        links.append(stash(_confirmed(tries, sets, percent), "links"))
        if last:
            return label if links[-1].isEmpty() else components(known.union(links[-1]))
        tested = tested.union(tries)
    raise AssertionError("the last round returns")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, with_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text); with_row: and row, the xxhash64
    of its text, and group, a name of its component (null where the set is empty or the doc_id null), as two components
    may have one smallest doc_id."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("row", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("id", T.LongType()), T.StructField("sig", T.BinaryType())])
    slots, _ = shape(percent)
    rows = stash(docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(lambda batches: _sketches(batches, slots), schema), "sketches")
    # One node for each distinct set; equal sets have equal signatures. Its first row stands for it.
    first = F.min(F.struct("doc_id", "row")).alias("at")
    classes = stash(rows.where("id is not null and doc_id is not null").groupBy("id").agg(first, F.first("sig").alias("sig")), "classes")
    label = _class_components(classes.select("id", F.col("at.doc_id").alias("d"), F.col("at.row").alias("r"), "sig"), docs, percent)
    member = classes.select("id", F.col("at.doc_id").alias("c"), F.col("id").alias("group"))
    if label is not None:
        member = member.drop("group").join(label, "id", "left")
        # The smallest doc_id of each component.
        low = member.where("component is not null").groupBy("component").agg(F.min("c").alias("low"))
        member = member.join(low, "component", "left").select("id", F.coalesce("low", "c").alias("c"), F.coalesce("component", "id").alias("group"))
    out = rows.where("doc_id is not null").join(member, "id", "left").select("doc_id", "row", "group", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    out = out.union(rows.where("doc_id is null").select("doc_id", "row", F.lit(None).cast("long"), "n_shingles", F.lit(None).cast(id_type)))
    return out.select("doc_id", *["row", "group"] * with_row, "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
