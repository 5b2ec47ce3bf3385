"""Merkle manifest of a dataset: a tree of hashes for each group of rows, one over the groups, a proof for each row.

A row's leaf is the SHA-256 of its columns, each as byte count, ":" and value ("-" for null). The leaves of
a group ascend by id; two neighbours (or the last one alone) hash to a node of the next level, up to the
group's root, and the groups' roots, ordered by group, do likewise. Digests are hashed as lowercase hex.

The nodes live in a store on the shared file system, never in memory:

1. Leaves are range-partitioned by (group, id, leaf) and written as sorted runs. The rows of a group in the
   runs before one give the places of its leaves, so a leaf has a coordinate (group, level, index) and no
   group passes through one task; only the numbers of rows of (group, run) pairs are summed in order.
2. A block is 2**BLOCK neighbours of a level. One pass reads the blocks of a level in order and writes their
   nodes of the next BLOCK levels, as Parquet partitioned by level; the next pass reads the last of these.
   A tree over n rows takes log(n) / BLOCK passes, two for 16 million rows of a group and three for 68 billion.
3. Proofs come from the top down by merge-scans: a block's own nodes, its leaves and the path of the block's
   root stream together in order of coordinate, and each leaf picks its siblings among them.

A task holds one block. Everything between the passes is a written table, so a lost executor costs its
tasks only.

Edge cases: null columns count as "-"; a null group is the first one; null ids come first; rows of one id
stand in the order of their leaves, so equal rows are neighbours, each with a proof of its own; a group of
one row has its leaf as root; very long texts are hashed whole; an empty table has no root and gives no
rows; columns that are not hashed are not read.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_stash, shared_dir, stash, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Levels that one pass folds; a block has 2**BLOCK leaves.
BLOCK = 12
#: What a row's leaf covers, in this order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


@dataclass
class Tree:
    """leaves (grp, idx, size, digest, ...), nodes (grp, level, idx, size, digest), roots (grp, digest); size counts a group's nodes of that level."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    passes: int
    block: int


@dataclass
class Manifest:
    rows: Tree
    groups: Tree
    root: str | None


def digest_of(*columns: Column) -> Column:
    """The leaf of a row with these columns."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(c.cast("string")) for c in columns]).cast("binary"), 256))


def depth(size: int) -> int:
    """Levels above one of so many nodes."""
    return (size - 1).bit_length()


def joined(*digests: bytes) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (grp, ...) with idx, their place in their group in this order, and size, the group's rows."""
    near = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place in the partition
    runs = stash(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).select("*", F.spark_partition_id().alias("run"), near.alias("nth")), "merkle-runs")
    heads = runs.groupBy("grp", "run").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("run")) - F.col("n") - F.col("first")
    heads = heads.select("grp", "run", before.alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    leaves = stash(runs.join(heads, ["grp", "run"]).withColumn("idx", F.col("nth") + F.col("shift")).drop("run", "nth", "shift"), "merkle-leaves")
    drop_stash(runs)
    return leaves


def in_blocks(rows: DataFrame, *order) -> DataFrame:
    """Every block in one partition, its rows in order."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


def block_streams(batches):
    """The rows of each block as a list of dicts; a block may go over the end of a batch."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != key and held:
                yield held
                held = []
            key = row["grp"], row["block"]
            held.append(row)
    if held:
        yield held


NODE = "grp string, level int, idx long, size long, digest binary"
_NODE = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])


def fold(level: int, block: int):
    """From the blocks of a level their nodes of the next levels."""

    def run(batches):
        out: list[dict] = []
        for rows in block_streams(batches):
            grp, size, first = rows[0]["grp"], rows[0]["size"], rows[0]["idx"]
            digests = [r["digest"] for r in rows]
            for up in range(1, min(block, depth(size)) + 1):
                digests = [joined(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
                first, size = first >> 1, (size + 1) >> 1
                out += [{"grp": grp, "level": level + up, "idx": first + i, "size": size, "digest": d} for i, d in enumerate(digests)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist(out, _NODE)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _NODE)

    return run


def build(rows: DataFrame, *order: str, block: int = BLOCK) -> Tree:
    """The trees over rows (grp string, digest binary, ...), one a group, leaves in this order."""
    spark = rows.sparkSession
    leaves = numbered(rows, *order)
    at = f"{shared_dir(spark).rstrip('/')}/merkle/{uuid.uuid4().hex}"
    largest = leaves.agg(F.max("size")).first()[0] or 0
    passes = max(1, -(-depth(max(largest, 1)) // block))
    level = leaves.select("grp", F.lit(0).alias("level"), "idx", "size", "digest")
    for k in range(passes):
        nodes = in_blocks(level.withColumn("block", F.shiftright("idx", block)), "idx").mapInArrow(fold(k * block, block), NODE)
        nodes.write.partitionBy("level").mode("append").parquet(at)
        store = spark.read.schema(NODE).parquet(at)
        level = store.where((F.col("level") == (k + 1) * block) & (F.col("size") > 1))
    tops = leaves.where("size = 1").select("grp", "digest").union(store.where("size = 1").select("grp", "digest"))
    return Tree(leaves, store, tops, passes, block)


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, group: str = "lang", key: str = "doc_id", also: dict[str, Column] | None = None, block: int = BLOCK) -> Manifest:
    """The trees over docs' rows by group and over the groups. also: further columns to keep beside the leaves."""
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null before all others
    leaves = docs.select(grp.alias("grp"), F.col(key).alias("key"), digest_of(*[F.col(c) for c in columns]).alias("digest"), *[c.alias(n) for n, c in (also or {}).items()])
    rows = build(leaves, "key", "digest", block=block)
    groups = build(rows.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name", block=block)
    top = groups.roots.first()
    return Manifest(rows, groups, top and bytes(top["digest"]).hex())


def siblings(rows: list[dict], block: int) -> list[tuple[dict, list[dict]]]:
    """Each leaf of a block (rows: nodes from the highest level down, then leaves) with the path to the block's root."""
    low = min(r["level"] for r in rows)
    levels: dict[int, dict[int, str]] = {}
    for r in rows:
        levels.setdefault(r["level"] - low, {})[r["idx"]] = r["digest"].hex()
    out = []
    for leaf in rows:
        if leaf["level"] == low:
            path, at = [], leaf["idx"]
            for up in range(min(block, depth(leaf["size"]))):
                other = levels[up].get(at ^ 1, "")
                path.append({"left": other if at & 1 else "", "right": "" if at & 1 else other})
                at >>= 1
            out.append((leaf, path))
    return out


def with_paths(tree: Tree, k: int, above: DataFrame | None, made, schema: T.StructType, carry: list[str]) -> DataFrame:
    """made(leaf, path) for each node of level k * block, by a merge-scan of the level, the nodes over it and the
    blocks' own paths (above: grp, block, path, ...)."""
    low, names = k * tree.block, ["grp", "level", "idx", "size", "digest"]
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    level = tree.leaves.select("grp", F.lit(0).alias("level"), "idx", "size", "digest", *carry) if k == 0 else tree.nodes.where((F.col("level") == low) & (F.col("size") > 1)).select(*names)
    inner = tree.nodes.where((F.col("level") > low) & (F.col("level") < low + tree.block))
    # A block's number is the index of its nodes, cut to the bits over the block.
    inner = inner.withColumn("block", F.expr(f"shiftright(idx, {low + tree.block} - level)"))
    both = level.withColumn("block", F.shiftright("idx", tree.block)).unionByName(inner.select(*names, "block"), allowMissingColumns=True)
    if above is not None:
        extra = [c for c in above.columns if c not in ("grp", "block")]
        top = above.select("grp", "block", F.lit(1 << 20).alias("level"), *extra)
        both = both.select("*", *[none(above, c) for c in extra]).unionByName(top, allowMissingColumns=True)
    block, arrow = tree.block, to_arrow_schema(schema)

    def run(batches):
        out: list[dict] = []
        for rows in block_streams(batches):
            top = rows[0] if rows[0]["level"] == 1 << 20 else None
            for leaf, path in siblings(rows[1:] if top else rows, block):
                out.append(made(leaf, path + (top["path"] if top else []), top))
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return in_blocks(both, F.desc("level"), "idx").mapInArrow(run, schema)


_GRP, _PATH = T.StructField("grp", T.StringType()), T.StructField("path", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))


def paths_above(tree: Tree) -> DataFrame | None:
    """(grp, block, path): the paths of the roots of the lowest blocks, for groups of several; None if no group has several."""
    above = None
    for k in range(tree.passes - 1, 0, -1):
        found = with_paths(tree, k, above, lambda leaf, path, top: {"grp": leaf["grp"], "idx": leaf["idx"], "path": path}, T.StructType([_GRP, T.StructField("idx", T.LongType()), _PATH]), [])
        above = stash(found, "merkle-paths").withColumnRenamed("idx", "block")
    return above


def proofs(found: Manifest, judged: str = "digest", with_path: bool = True) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified[, path]) of each row: its leaf, the path through
    its group's root to the root, and whether the digest in column judged (null: the leaf) leads there."""
    rows, groups, root = found.rows, found.groups, found.root
    outer = with_paths(groups, 0, paths_above(groups), lambda leaf, path, top: {"grp": leaf["name"], "path": path}, T.StructType([_GRP, _PATH]), ["name"])
    outer = stash(outer, "merkle-groups").join(rows.roots, "grp").withColumnsRenamed({"path": "outer", "digest": "subroot"})
    blocks = rows.leaves.where(F.col("idx") % (1 << rows.block) == 0).select("grp", F.shiftright("idx", rows.block).alias("block"))
    inner = paths_above(rows)
    blocks = blocks.withColumn("path", F.lit(None).cast(PATH)) if inner is None else blocks.join(inner, ["grp", "block"], "left")
    whole = F.concat(F.coalesce("path", F.array().cast(PATH)), "outer")
    blocks = blocks.join(outer, "grp").select("grp", "block", whole.alias("path"), "subroot")
    strings = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([rows.leaves.schema["key"], *[T.StructField(n, T.StringType()) for n in strings], T.StructField("verified", T.BooleanType()), *([_PATH] if with_path else [])])

    def made(leaf, path, top):
        node = (leaf[judged] or leaf["digest"]).hex()
        for step in path:
            node = hashlib.sha256((step["left"] + node + step["right"]).encode()).hexdigest()
        proof = hashlib.sha256("".join(s["left"] + s["right"] for s in path).encode()).hexdigest()
        out = {"key": leaf["key"], "leaf": leaf["digest"].hex(), "subroot": top["subroot"].hex(), "root": root, "proof_sha256": proof, "folded_root": node, "verified": node == root}
        return out | {"path": path} if with_path else out

    return with_paths(rows, 0, blocks, made, schema, ["key", *({judged} - {"digest"})])


def op12_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    more = digest_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, also={"tampered": F.when(hit, more)})
    return proofs(found, "tampered", with_path=False).withColumnRenamed("key", "doc_id")


_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END))"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"
OP12_SQL = f"""WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, pos) AS rid FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
      SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, CASE WHEN coalesce(xor({_CRC}, 4294967295::BIGINT) % 7, 1) = 0 THEN {_LEAF("(n_chars + 1)")} ELSE {_LEAF("n_chars")} END AS judged FROM documents))),
up(lang, level, idx, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM leaf
  UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, idx // 2),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, idx, h, n) AS (
  SELECT 0, pos, h, n FROM sub
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2),
steps AS (
  SELECT l.rid, u.level, (l.pos >> u.level) & 1 AS odd, s.h FROM leaf l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.idx = l.pos >> u.level AND u.n > 1
    LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = u.level AND s.idx = xor(u.idx, 1)
  UNION ALL SELECT l.rid, 1000 + u.level, (b.pos >> u.level) & 1, s.h FROM leaf l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang JOIN top u ON u.idx = b.pos >> u.level AND u.n > 1
    LEFT JOIN top s ON s.level = u.level AND s.idx = xor(u.idx, 1)),
listed AS (SELECT rid, list(odd ORDER BY level) AS odds, list(coalesce(h, '') ORDER BY level) AS hs FROM steps GROUP BY rid),
folded(rid, k, h) AS (
  SELECT rid, 0, judged FROM leaf
  UNION ALL SELECT f.rid, k + 1, sha256(CASE WHEN odds[k + 1] = 1 THEN hs[k + 1] || f.h ELSE f.h || hs[k + 1] END) FROM folded f JOIN listed USING (rid) WHERE k < len(hs))
SELECT l.doc_id, l.leaf, b.h AS subroot, r.h AS root, sha256(coalesce(array_to_string(s.hs, ''), '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaf l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM top WHERE n = 1) r LEFT JOIN listed s USING (rid) JOIN folded f ON f.rid = l.rid AND f.k = coalesce(len(s.hs), 0)"""
