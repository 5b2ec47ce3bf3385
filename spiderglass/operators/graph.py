"""The link graph of a crawl and iterations over it. Loops write each round's state to shared storage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import content_page

#: Rounds of an iteration between two written tables.
ROUNDS_A_TABLE = 3


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spiderglass-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _keep(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nodes(results: DataFrame) -> DataFrame:
    """One node a url of a session; of repeated urls the last row."""
    return results.groupBy("session_id", "url").agg(F.max("id").alias("id"))


def _links(results: DataFrame) -> DataFrame:
    """(session_id, src, dst): all links once each, without self loops."""
    return results.select("session_id", F.col("url").alias("src"), F.explode(F.array_distinct("seo.outlinks")).alias("dst")).where("src <> dst").distinct()


def edges(results: DataFrame) -> DataFrame:
    """(session_id, src, dst): links between crawled urls, once each, without self loops."""
    known = results.select("session_id", F.col("url").alias("dst")).distinct()
    return _links(results).join(known, ["session_id", "dst"], "left_semi").select("session_id", "src", "dst")


def degrees(results: DataFrame) -> DataFrame:
    """(session_id, url, indegree, outdegree) of every crawled url."""
    e = edges(results)
    ends = e.select("session_id", F.col("dst").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("session_id", "src", F.lit(0), F.lit(1)))
    ends = ends.union(nodes(results).select("session_id", "url", F.lit(0), F.lit(0)))
    return ends.groupBy("session_id", "url").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def inlinks(results: DataFrame) -> DataFrame:
    """(session_id, url, linked_from): the crawled pages that link to each crawled url."""
    return edges(results).groupBy("session_id", F.col("dst").alias("url")).agg(F.sort_array(F.collect_list("src")).alias("linked_from"))


def orphans(results: DataFrame, start_urls: DataFrame | None = None) -> DataFrame:
    """Content pages that no crawled page links to, but for the session's start url (the lowest id where none is given)."""
    if start_urls is None:
        start_urls = results.groupBy("session_id").agg(F.min_by("url", "id").alias("url"))
    linked = edges(results).select("session_id", F.col("dst").alias("url")).distinct()
    return results.where(content_page()).join(linked, ["session_id", "url"], "left_anti").join(start_urls.select("session_id", "url"), ["session_id", "url"], "left_anti").select("session_id", "url")


def broken_links(results: DataFrame, shown: int = 50) -> DataFrame:
    """Error urls with how many and which crawled pages link to them (the first `shown`)."""
    bad = results.where("status >= 400 OR status = 0").select("session_id", "url", "status", "error")
    # Only links to error urls travel; they are counted by partial aggregates and ranked for the first ones.
    hit = edges(results).withColumnRenamed("dst", "url").join(bad.select("session_id", "url").distinct(), ["session_id", "url"], "left_semi")
    n = hit.groupBy("session_id", "url").agg(F.count("*").alias("n_from"))
    first = hit.withColumn("_k", F.row_number().over(Window.partitionBy("session_id", "url").orderBy("src"))).where(F.col("_k") <= shown)
    first = first.groupBy("session_id", "url").agg(F.sort_array(F.collect_list("src")).alias("linked_from"))
    found = bad.join(n, ["session_id", "url"], "left").join(first, ["session_id", "url"], "left")
    return found.select("session_id", "url", "status", "error", F.coalesce("n_from", F.lit(0).cast("long")).alias("n_from"), F.coalesce("linked_from", F.array().cast("array<string>")).alias("linked_from"))


def pagerank(results: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, session: bool = True) -> DataFrame:
    """(session_id, url, score, indegree, outdegree). Scores start at 1/N; what sinks hold is spread evenly;
    ends when no score of any session moves by `tolerance`, or after `rounds`."""
    # Rounds run on row ids (unique in a session), not urls; a node holds its own links, so only summed shares travel.
    node = _keep(nodes(results), "nodes")
    end = lambda name: node.select("session_id", F.col("url").alias(name), F.col("id").alias(f"{name}_id"))
    pairs = _keep(_links(results).join(end("dst"), ["session_id", "dst"]).join(end("src"), ["session_id", "src"]).select("session_id", "src_id", "dst_id"), "edges")
    key = ["session_id", "id"]
    out = pairs.groupBy("session_id", F.col("src_id").alias("id")).agg(F.collect_list("dst_id").alias("out"))
    into = pairs.groupBy("session_id", F.col("dst_id").alias("id")).agg(F.count("*").alias("indegree"))
    n = node.groupBy("session_id").agg(F.count("*").alias("n"))
    outs, zero = F.coalesce("out", F.array().cast("array<bigint>")), F.lit(0).cast("long")
    base = node.join(out, key, "left").join(into, key, "left").join(n, "session_id")
    base = _keep(base.select(*key, "url", F.coalesce("indegree", zero).alias("indegree"), F.size(outs).cast("long").alias("outdegree"), "n", outs.alias("out")), "base")
    scores, done = base.select(*key, (1 / F.col("n")).alias("score")), 0
    while done < rounds:
        # A few rounds make one plan and one written table; it keeps the scores of each, so the first that is settled is found.
        block, made = min(ROUNDS_A_TABLE, rounds - done), []
        new = base.select(*key, "n", "out").join(scores, key)
        for k in range(block):
            # What a sink holds goes to the node null.
            given = new.select("session_id", F.explode_outer("out").alias("id"), (F.col("score") / F.greatest(F.size("out"), F.lit(1))).alias("part")).groupBy(*key).agg(F.sum("part").alias("got"))
            sunk = given.where("id is null").select("session_id", F.col("got").alias("sunk"))
            score = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("sunk", F.lit(0.0)) / F.col("n"))
            new = new.join(given.where("id is not null"), key, "left").join(sunk, "session_id", "left")
            new = new.select(*key, "n", "out", *made, score.alias("score"), F.abs(score - F.col("score")).alias(f"moved{k}"), score.alias(f"score{k}"))
            made += [f"moved{k}", f"score{k}"]
        new = _keep(new.select(*key, *made), "rank")
        moved = new.agg(*[F.max(f"moved{k}") for k in range(block)]).first()
        settled = [k for k in range(block) if moved[k] is None or moved[k] < tolerance]
        scores = new.select(*key, F.col(f"score{settled[0] if settled else block - 1}").alias("score"))
        done += block
        if settled:
            break
    return base.join(scores, key).select("session_id", "url", "score", "indegree", "outdegree")


def bfs_depth(results: DataFrame, seeds: DataFrame, most: int = 0, max_depth: int = 1000, obey_nofollow: bool = False) -> DataFrame:
    """(session_id, url, depth): link distance from the seeds over outlinks, level by level.

    Links lead to all urls seen, crawled or not. `most` is a session's budget of urls (0: none);
    within a level urls come in order. Pages marked nofollow do not expand if that is obeyed.
    """
    out = results.where(~F.col("is_nofollow")) if obey_nofollow else results
    links = _keep(out.select("session_id", F.col("url").alias("src"), F.explode(F.array_distinct("seo.outlinks")).alias("url")).distinct(), "links")
    # Each level is a part of one table, so what is known is read and never written again.
    at = f"{shared_folder(results.sparkSession)}/rounds/levels-{uuid.uuid4().hex}"
    level = seeds.select("session_id", "url").distinct().withColumn("depth", F.lit(0).cast("long"))
    fields = level.schema

    def put(level: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        level.write.parquet(f"{at}/{depth}")
        read = results.sparkSession.read.schema(fields)
        return read.parquet(f"{at}/{depth}"), read.parquet(*[f"{at}/{d}" for d in range(depth + 1)])

    level, known = put(level, 0)
    for depth in range(1, max_depth + 1):
        step = links.join(level.select("session_id", F.col("url").alias("src")), ["session_id", "src"]).select("session_id", "url").distinct()
        step = step.join(known, ["session_id", "url"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        level, known = put(step, depth)
        if level.isEmpty():
            break
        if most and known.groupBy("session_id").count().where(F.col("count") < most).isEmpty():
            break
    if most:
        w = Window.partitionBy("session_id").orderBy("depth", "url")
        known = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return known
