"""What the operators share: table access, written intermediates, word arrays, links to components."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Rows in an Arrow batch handed to Python; with whole texts as rows this bounds a worker's memory.
ARROW_ROWS = 500
#: Spark's setting by which shuffle files are removed at the end of a query.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spiderglass-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within, a query's shuffle files go when it ends (from Spark 4.1 on), not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def drop_stash(*frames: DataFrame) -> None:
    """Removes stashes that no later plan reads."""
    for df in frames:
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(name if urlparse(name).scheme else f"file://{name}")
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(col: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# ---- word arrays (numpy side) ----------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: every output bit depends on every input bit."""
    h = (h ^ (h >> _S30)) * _MIX1
    h = (h ^ (h >> _S27)) * _MIX2
    return h ^ (h >> _S31)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for i in range(1, n):
        out *= _MULT
        out += h[i : i + m]
    return mixed(out)


# ---- links to components ----------------------------------------------------------------------


def _settled(edges: DataFrame) -> bool:
    """Whether every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), by alternating large and small stars.

    Stars exchange each node's minimum (pre-aggregated before the shuffle), so a node with very many
    neighbours never gathers them in one task; the joins back are plain equi-joins that AQE can split.
    Every round is written to the shared folder, so lineage stays short. Empty links: no rows.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        near = edges.union(edges.select("b", "a"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(low.select(F.col("a").alias("x"), "m"))
        new = stash(small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct(), "edges")
        drop_stash(edges)
        edges = new
    raise RuntimeError("components did not settle")
