"""The crawler's event stream: routed by type, stale generations dropped, written in micro-batches."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, ingest
from ..operators.health import HealthView, frontier_change
from ..operators.runs import KEPT, Runs
from ..sources.readers import parse_lines

# Event types by where they go.
ROUTES = {
    "log": "log", "metric": "metric", "phase": "phase", "timing": "timing", "discovered": "frontier", "block-detected": "block", "block-cooldown-cleared": "block", "controller-state": "pacing",
    "re-probe-requested": "pacing", "probe-matrix-start": "probe", "probe-result": "probe", "probe-matrix-complete": "probe",
}


def route(parsed: DataFrame) -> DataFrame:
    """(value, record) with `sink`: results are what has a url and neither type nor event; lines that are no JSON go to log."""
    kind = F.col("record.type")
    known = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    bare = kind.isNull() & F.col("record.event").isNull() & F.col("record.url").isNotNull()
    return parsed.withColumn("sink", F.when(F.col("record").isNull(), "log").when(bare, "result").when(kind.isNotNull(), F.coalesce(F.try_element_at(known, kind), F.lit("other"))).otherwise("other"))


def current(routed: DataFrame, generation: int | None = None) -> DataFrame:
    """Rows of the newest generation; rows that carry none pass."""
    g = F.col("record.generation")
    if generation is None:
        newest = routed.agg(F.max(g).alias("_newest"))
        return routed.join(newest).where(g.isNull() | (g == F.col("_newest"))).drop("_newest")
    return routed.where(g.isNull() | (g >= generation))


def results_of(routed: DataFrame, session_id: int) -> DataFrame:
    rows = routed.where("sink = 'result'").select("record.*").withColumn("session_id", F.lit(session_id).cast("long"))
    return ingest.blank_non_content(ingest.coerce(rows).withColumn("session_id", F.lit(session_id).cast("long")))


def discovered_of(routed: DataFrame, session_id: int) -> DataFrame:
    return routed.where("sink = 'frontier'").select(F.lit(session_id).cast("long").alias("session_id"), F.explode("record.urls").alias("url"))


class Store:
    """The tables of a crawl, written in batches: results and discovered urls, of which the last row of a key counts, and
    the health of the sessions. A batch is there as a whole; one that is done again after a crash is not there twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.results_runs, self.seen_runs, self.health_view = Runs(spark, f"{path}/results"), Runs(spark, f"{path}/discovered"), HealthView(spark, f"{path}/health")

    def write(self, results: DataFrame, discovered: DataFrame, batch: int) -> None:
        """results in the result schema with `line`, their order in the batch; discovered (session_id, url)."""
        seq = F.struct(F.lit(batch).cast("long").alias("batch"), F.col("line"))
        new = results.withColumn("seq", seq).drop("line")
        # Changes are judged against what was there before the batch, so health comes first and is not done again once
        # a table has the batch.
        if batch > self.seen_runs.manifest()["batch"]:
            newest = ingest.last_wins(new, "seq")
            keys = newest.select("session_id", "url").union(discovered.select("session_id", "url"))
            old, known = self.results_runs.lookup(keys), self.seen_runs.lookup(keys)
            replaced = None if old is None else old.join(newest.select("session_id", "url"), ["session_id", "url"], "left_semi")
            self.health_view.apply(batch, newest, replaced, frontier_change(known, old, discovered, newest))
            self.seen_runs.append(discovered.select("session_id", "url", F.lit(batch).cast("long").alias("seq")), batch)
        self.results_runs.append(new, batch)
        for runs in (self.seen_runs, self.results_runs):
            runs.compact()
            runs.clean(KEPT)

    def results(self) -> DataFrame | None:
        rows = self.results_runs.read()
        return None if rows is None else rows.drop("seq")

    def frontier(self) -> DataFrame | None:
        seen, done = self.seen_runs.read(), self.results()
        if seen is None:
            return None
        return ingest.frontier(seen, done) if done is not None else seen.select("session_id", "url")

    def health(self) -> DataFrame:
        return self.health_view.read()


def start(spark: SparkSession, inbox: str, store: Store, session_id: int, checkpoint: str, files_per_batch: int = 100, every: str | None = None):
    """Follows a folder of NDJSON files, a micro-batch of results and discovered urls at a time. files_per_batch is the
    back-pressure. With no `every` it processes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line", F.monotonically_increasing_id())
        routed = route(parse_lines(lines, "line")).persist()
        rows = routed.where("sink = 'result'").select("line", "record.*").withColumn("session_id", F.lit(session_id).cast("long"))
        made = ingest.blank_non_content(ingest.coerce(rows.withColumn("id", F.col("line"))))
        store.write(made.withColumn("line", F.col("id")).withColumn("session_id", F.lit(session_id).cast("long")), discovered_of(routed, session_id), number)
        routed.unpersist()

    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(inbox)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def progress(results: DataFrame) -> DataFrame:
    """Rows, errors, last url and last statuses of each session, as a snapshot."""
    return aggregates.progress_state(results)


def retire(path: str) -> None:
    """Removes a store."""
    import shutil

    shutil.rmtree(Path(path), ignore_errors=True)
