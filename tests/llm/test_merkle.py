"""The Merkle manifest against lists of digests in memory, and against SQL."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from spiderglass.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels, at):
    steps = []
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        steps.append(("", "".join(run[1:])) if at % 2 == 0 else (run[0], ""))
        at //= 2
    return steps


def brute(rows):
    """rows: dicts of COLUMNS."""
    groups = defaultdict(list)
    for r in rows:
        values = [r[c] for c in COLUMNS]
        other = list(values)
        if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            other[3] += 1
        groups[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf_of(values), leaf_of(other), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, leaf, other, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            steps = path(trees[g], i) + path(top, k)
            node = other
            for left, right in steps:
                node = H(left, node, right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], H(*[a + b for a, b in steps]), node, node == top[-1][0]))
    return sorted(out, key=str)


def judged(spark, rows, block):
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) + ("x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, idx int")
    return sorted((tuple(r) for r in merkle.proofs(merkle.manifest(df, also={"tampered": tampered()}, block=block), "tampered", with_path=False).collect()), key=str)


def tampered():
    more = merkle.digest_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, more)


def row(doc_id, lang, n_chars=5, text="text", source="s"):
    return dict(doc_id=doc_id, lang=lang, n_chars=n_chars, text=text, source=source)


ODD = [row(3, "en"), row(1, "en"), row(1, "en"), row(1, "en", text=None), row(None, "en"), row(None, None, None, None, None), row(7, None), row(8, ""), row(9, "é", text="é" * 100_000), row(10, "z", None), row(11, "zz", text="")]


@pytest.mark.parametrize(("n", "block"), [(0, 12), (1, 2), (9, 1), (41, 2), (64, 3), (65, 3), (300, 2)])
def test_proofs_like_brute_force(spark, n, block):
    rng = random.Random(n)
    rows = [row(rng.randrange(10**6), rng.choice(["en", "en", "en", "de", None]), rng.choice([None, 4, 77]), str(i)) for i in range(n)]
    assert judged(spark, rows, block) == brute(rows)


@pytest.mark.parametrize("block", [1, 12])
def test_odd_rows(spark, block):
    assert judged(spark, ODD, block) == brute(ODD)


def test_paths_verify_by_themselves(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = merkle.manifest(docs, block=4)
    rows = merkle.proofs(found).collect()
    for r in rows:
        node = r.leaf
        for step in r.path:
            node = H(step.left, node, step.right)
        assert node == found.root == r.root and r.verified
    assert len(rows) == docs.count()
    assert sorted(p for p in {r.level for r in found.rows.nodes.select("level").distinct().collect()}) == list(range(1, max(len(r.path) for r in rows) - len(tree(["a"] * 4)) + 2))


def test_op12_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(merkle.OP12_SQL)
    names = [c[0] for c in want.description]
    got = merkle.op12_merkle(spark, sf)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert {r.verified for r in got.collect()} == {True, False}
