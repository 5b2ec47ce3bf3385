"""Periodic runs against a walk over all periods."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spiderglass.llm import periodic

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(words, min_words=24, exponent=3):
    """All maximal stretches of each period; a stretch counts with its smallest period."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_words, exponent * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def rewritten(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    s, n, p = best or (None, None, None)
    return (doc_id, len(runs), s, n, p, best and 1000 * n // p, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def repeated(rng, n):
    """Random words with runs of random periods, some beside or inside one another."""
    words = []
    while len(words) < n:
        unit = rng.choices("abc", k=rng.randint(1, 12))
        words += rng.choices("abcdef", k=rng.randint(0, 9)) if rng.random() < 0.4 else (unit * 40)[: rng.randint(1, 60)]
    return words


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 400), st.sampled_from([(24, 3), (6, 2), (12, 4)]))
def test_runs_like_brute_force(seed, n, rule):
    rng = random.Random(seed)
    docs = [[w.encode() for w in repeated(rng, rng.randint(0, n))] for _ in range(5)]
    assert [[tuple(r) for r in runs.tolist()] for runs in periodic.runs_of(docs, *rule, most=rng.choice([1, 50, 1 << 20]))] == [brute(d, *rule) for d in docs]


def test_colliding_hashes_are_done_again():
    rng = random.Random(3)
    docs = [[w.encode() for w in repeated(rng, 300)] for _ in range(8)]
    few = lambda words: np.array([w[0] % 3 for w in words], np.uint64)
    assert any(brute([w[0] % 3 for w in d]) != brute(d) for d in docs)
    assert [[tuple(r) for r in runs.tolist()] for runs in periodic.runs_of(docs, hashed=few)] == [brute(d) for d in docs]
    ranks = periodic.periodic_runs(periodic.Ranks([*docs[0], None]), np.zeros(1, np.int64), np.array([len(docs[0])]))
    assert [(s, e - s, p) for s, e, p in ranks.tolist()] == brute(docs[0])


def test_strings_that_collide_under_any_multiplier():
    """Thue-Morse words have equal polynomial hashes modulo 2**64; equal runs are claimed and then refuted."""
    t = [b"a"]
    for _ in range(11):
        t += [b"b" if w == b"a" else b"a" for w in t]
    flipped = [b"b" if w == b"a" else b"a" for w in t]
    words = t + flipped + t + flipped
    assert [tuple(r) for r in periodic.runs_of([words])[0].tolist()] == brute(words)


def test_greatest_compares_exactly():
    big = 10**9
    runs = np.array([[9, 3 * big + 1, big], [0, 3 * big + 4, big + 1], [3, 30, 10]])
    assert periodic.greatest(runs) == (9, 3 * big + 1, big) and periodic.greatest(runs[:0]) is None
    assert periodic.greatest(np.array([[5, 30, 10], [2, 60, 20], [2, 30, 10]])) == (2, 30, 10)


LONG = " ".join(random.Random(9).choices(["x", "y", "z"], k=70_000)) + " tail" * 30
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a " * 23), (5, "a " * 24), (6, "b\x0bb\x0c" * 40), (7, "x y z " * 9 + "x"), (7, "x y z " * 9 + "x"), (None, "k l " * 20), (None, None), (8, LONG),
    (9, "é ü " * 30 + "z " * 24 + "é ü " * 30), (10, "p q r s t u v w " * 3), (11, "one two\u00a0three " * 12),
]


def test_op11_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in ODD], "doc_id long, text string, start long, runs string")
    ours = df.withColumn("text", periodic.repeating(F.col("doc_id"), F.col("text")))
    got = sorted((tuple(r) for r in periodic.collapse_runs(ours, with_text=False).where("doc_id <> 8 or doc_id is null").collect()), key=str)
    assert got == sorted((expected(i, rewritten(i, t)) for i, t in ODD if i != 8), key=str)
    long = periodic.collapse_runs(df.where("doc_id = 8")).first()
    assert long.n_runs >= 1 and any(r.start == 70_000 and r.length == 30 for r in long.runs) and sha(long.collapsed) == long.collapsed_sha256
    assert periodic.collapse_runs(df.limit(0)).count() == 0


def test_op11(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = periodic.op11_runs(spark, sf)
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted((expected(r.doc_id, rewritten(r.doc_id, r.text)) for r in rows), key=str)
    assert sum(r[1] > 0 for r in found) > 5


@pytest.mark.parametrize("n", [0, 1, 23])
def test_short_documents_have_no_runs(n):
    assert not len(periodic.runs_of([[b"a"] * n])[0])
