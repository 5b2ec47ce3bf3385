"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are averaged per document (each kind for itself),
summed, and go through a softmax layer; vectors and layer are learned together by numpy stochastic
gradient descent. For scoring, each vector is folded with the layer into one number a bucket, so a
document costs one table look-up an n-gram.

Training takes at most `max_train_docs` labelled documents, those with the smallest hash of their id
(the bound is documented and does not grow); their sparse features are computed on the executors.
Held-out rows, crc32(doc_id as text) mod 5 = 0, are never learned from.

Edge cases: a null or empty text has no n-grams and gets the bias's score; a null doc_id counts as the
empty text, so it is held out; labels without a document, with null quality or other values than 0
and 1 are ignored; of a document's repeated labels the largest counts, and of a
repeated doc_id one text is learned from (all are scored); a very long text is walked in pieces and counts whole; with no labels or one class
only every score is the smoothed share of label 1; input columns named as the added ones give way.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import small_batches, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

BITS, DIM = 15, 8
#: Kinds of n-grams, each with 2**BITS buckets of its own.
KINDS = 4
MAX_TRAIN_DOCS, EPOCHS, RATE, SEED = 2000, 12, 0.6, 7
THRESHOLD = 0.3
_PIECE = 1 << 20


def grams(text: str):
    """(kind, bucket numbers) of words, word pairs, and 3- and 4-grams of characters."""
    words = text.encode("utf-8", "replace").split()
    mask, shift = np.uint32((1 << BITS) - 1), np.uint32(32 - BITS)
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    yield 0, h & mask
    # A pair is hashed by a difference of its words' hashes, which is 0 for a word and itself: all immediate repeats
    # share a bucket, whatever the word, so that what is learned of stutter holds for words never seen in training.
    yield 1, ((h[1:] - h[:-1]) * np.uint32(0x9E3779B1)) >> shift
    for start in range(0, len(text), _PIECE):
        c = np.frombuffer(text[start : start + _PIECE + 3].encode("utf-32-le", "surrogatepass"), np.uint32)
        g = (c[:-2] * np.uint32(0x01000193) + c[1:-1]) * np.uint32(0x01000193) + c[2:]
        yield 2, (g[:_PIECE] * np.uint32(0x9E3779B1)) >> shift
        g = g[:-1] * np.uint32(0x01000193) + c[3:]
        yield 3, (g[:_PIECE] * np.uint32(0x85EBCA6B)) >> shift


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers over all kinds and their weights; the weights of a kind sum to 1."""
    counts = np.zeros((KINDS, 1 << BITS), np.float32)
    for kind, at in grams(text):
        counts[kind] += np.bincount(at, minlength=1 << BITS).astype(np.float32)
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    return at.astype(np.int32), flat[at]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The folded model: a number for each bucket, and the bias."""
    good = sum(y for *_, y in rows)
    prior = np.log((good + 1) / (len(rows) - good + 1))
    if good in (0, len(rows)):
        return np.zeros(KINDS << BITS, np.float32), float(prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (KINDS << BITS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, dim)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            at, weight, y = rows[i]
            hidden = weight @ vectors[at]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer.T @ p
            layer -= step * np.outer(p, hidden)
            bias -= 0.1 * step * p
            vectors[at] -= (4 * step) * weight[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score(text: str, folded: np.ndarray, bias: float) -> float:
    total, count = np.zeros(KINDS), np.zeros(KINDS)
    for kind, at in grams(text):
        total[kind] += folded[kind].take(at).sum(dtype=np.float64)
        count[kind] += len(at)
    return float(1 / (1 + np.exp(-(bias + (total / np.maximum(count, 1)).sum()))))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, **how) -> tuple[np.ndarray, float]:
    small_batches(docs.sparkSession)
    chosen = labels.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)

    def features(batches):
        for batch in batches:
            rows = [sparse(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()), batch.column("quality")],
                names=["doc_id", "at", "weight", "quality"],
            )

    # Bounded by max_train_docs rows, so it may be broadcast. Of a repeated doc_id one text is learned from.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.max(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("one")
    sample = sample.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.quality")
    found = sample.mapInArrow(features, "doc_id string, at binary, weight binary, quality int").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.at), r.quality))
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r.weight, np.float32), r.quality) for r in found]
    return train(rows, **how)


ADDED = [("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType())]


def classify(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, threshold: float = THRESHOLD, **how) -> DataFrame:
    """docs with held_out, score (how likely label 1 is) and predicted (score >= threshold)."""
    base = docs.select(*[c for c in docs.columns if c not in dict(ADDED)])
    folded, bias = fit(base, labels, max_train_docs, **how)
    model = docs.sparkSession.sparkContext.broadcast((folded.reshape(KINDS, -1), bias))

    def run(batches):
        folded, bias = model.value
        for batch in batches:
            scores = [score(t or "", folded, bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    scored = base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*base.columns, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).drop("text")
