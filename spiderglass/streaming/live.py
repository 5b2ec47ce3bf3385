"""Crawl state as streams: the frontier as keyed state, rates in event-time windows, progress by a timer.

State lives in Spark's state store under the query's checkpoint, so a stream that is stopped, or loses executors, goes on
where it was; what a micro-batch puts out is written under its number and counts once. A checkpoint belongs to its table:
begin a new table with a new checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import KEPT, Runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Milliseconds between snapshots, statuses that a snapshot holds, snapshots handed on at a time.
TICK_MS, HISTORY, SHOTS = 500, 200, 2000


def _followed(writer, checkpoint: str, every: str | None):
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def _into(runs: Runs):
    """Changed rows of a batch, added to a table whose last row of a key counts."""

    def write(rows: DataFrame, batch: int) -> None:
        runs.append(rows.withColumn("seq", F.lit(batch).cast("long")), batch)
        runs.compact()
        runs.clean(KEPT)

    return write


# ---- frontier


def frontier_state(events: DataFrame) -> DataFrame:
    """(session_id, url, seen, done) of events (session_id, url, crawled): what is known of each url."""
    return events.groupBy("session_id", "url").agg(F.max(~F.col("crawled")).alias("seen"), F.max("crawled").alias("done"))


def keep_frontier(events: DataFrame, runs: Runs, checkpoint: str, every: str | None = None):
    """Follows a stream of events. A url is a key of the state; a batch puts out the keys that it touched, and nothing is
    computed anew. A crawl that is resumed gets its old frontier as events of urls seen."""
    return _followed(frontier_state(events).writeStream.outputMode("update").foreachBatch(_into(runs)), checkpoint, every)


def frontier_of(runs: Runs) -> DataFrame | None:
    """Urls seen and not crawled, as last kept."""
    rows = runs.read()
    return None if rows is None else rows.where("seen and not done").select("session_id", "url")


# ---- rates


def rates(completions: DataFrame, width: str = "10 seconds", slide: str = "1 second", late: str = "30 seconds") -> DataFrame:
    """(host, start, end, n, pages_per_sec) of completions (host, ts): at the end of each window its completions over the time
    since the first of them, one second at least. Of a stream, rows that come later than `late` behind the newest one are
    left out; those within it count. A batch has no late rows."""
    timed = completions.withWatermark("ts", late) if completions.isStreaming else completions
    found = timed.groupBy("host", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    seconds = (F.unix_millis(F.col("w.end").cast("timestamp")) - F.unix_millis(F.col("first").cast("timestamp"))) / 1000
    return found.select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.round(F.col("n") / F.greatest(seconds, F.lit(1.0)), 2).alias("pages_per_sec"))


def keep_rates(completions: DataFrame, runs: Runs, checkpoint: str, every: str | None = None, **windows):
    """Follows a stream; the windows of the table (key: host, start) are changed until they are closed."""
    return _followed(rates(completions, **windows).writeStream.outputMode("update").foreachBatch(_into(runs)), checkpoint, every)


# ---- progress

_SNAPSHOT = "session_id long, tick_ms long, row_count long, error_count long, last_url string, latest_statuses array<long>, final boolean"
_STATE = "row_count long, error_count long, last_url string, latest_statuses array<long>, dirty boolean, tick_ms long"


def _snapshots(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows, errors, last, latest, dirty, tick = state.get if state.exists else (0, 0, None, [], False, 0)
    # The statuses kept and to come, of which `n` are there so far: a snapshot holds a view of them.
    every, n, out, over = np.array(list(latest), dtype="int64"), len(latest), [], False

    def emit(final: bool) -> None:
        out.append((key[0], tick, rows, errors, last, every[max(0, n - HISTORY) : n], final))

    def put() -> pd.DataFrame:
        shots = pd.DataFrame(out, columns=["session_id", "tick_ms", "row_count", "error_count", "last_url", "latest_statuses", "final"])
        out.clear()
        return shots

    if state.hasTimedOut:
        if dirty:
            emit(False)
            dirty = False
    else:
        held = pd.concat(list(batches)).sort_values(["ts_ms", "seq"], kind="stable")
        # A row belongs to the tick after it, or to that of an earlier row which came before it.
        ticks = ((held["ts_ms"] // TICK_MS + 1) * TICK_MS).clip(lower=tick).cummax().to_numpy()
        ends, urls, wrong = held["ends"].to_numpy(bool), held["url"].tolist(), (held["error"].fillna("") != "").to_numpy()
        every = np.concatenate([every, held["status"].to_numpy()[~ends].astype("int64")])
        first = np.flatnonzero(np.r_[True, ticks[1:] != ticks[:-1]])
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(ticks)], strict=True):
            if dirty and ticks[i] > tick:
                emit(False)
                dirty = False
                if len(out) == SHOTS:
                    yield put()
            tick = int(ticks[i])
            results = [k for k in range(i, j) if not ends[k]]
            if results:
                rows, errors, n = rows + len(results), errors + int(wrong[results].sum()), n + len(results)
                last, dirty = urls[results[-1]], True
            over = over or len(results) < j - i
    if over:
        emit(True)
        state.remove()
    else:
        state.update((rows, errors, last, every[max(0, n - HISTORY) : n].tolist(), dirty, tick))
        if dirty:
            state.setTimeoutTimestamp(max(tick, state.getCurrentWatermarkMs() + 1))
    yield put()


def progress(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Snapshots of a stream of events (session_id, ts, seq, url, status, error, ends): rows, errors, the last url and the last
    statuses of a session, at each tick in whose time anything changed, and once more, marked final, where the session ends.

    The state of a session holds its counts and whether they changed since the last snapshot; a timer on event time puts
    out what is waiting once the watermark has passed the tick. Rows that come after a later one count at its tick; those
    of an earlier batch's past, by more than `late`, are left out."""
    rows = events.withWatermark("ts", late).withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    rows = rows.select("session_id", "ts", "ts_ms", "seq", "url", "status", "error", F.coalesce("ends", F.lit(False)).alias("ends"))
    return rows.groupBy("session_id").applyInPandasWithState(_snapshots, _SNAPSHOT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def keep_progress(events: DataFrame, runs: Runs, checkpoint: str, every: str | None = None, late: str = "0 seconds"):
    """Follows a stream of events; snapshots go to a table (key: session_id, tick_ms, final)."""
    return _followed(progress(events, late).writeStream.outputMode("append").foreachBatch(_into(runs)), checkpoint, every)
