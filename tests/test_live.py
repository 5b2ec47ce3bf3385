"""Streams of crawl state against walks over the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spiderglass.operators.runs import Runs
from spiderglass.streaming import live

START = datetime(2024, 1, 1)


@pytest.fixture
def inbox(spark, tmp_path):
    """put(rows): a file of rows; stream(): the files one by one, in the order in which they were put."""

    class Inbox:
        def __init__(self):
            self.at, self.n, self.schema = tmp_path / "in", 0, None

        def put(self, rows, schema):
            import os

            df = spark.createDataFrame(rows, schema).coalesce(1)
            self.schema = df.schema
            df.write.parquet(str(tmp_path / f"part{self.n}"))
            self.at.mkdir(exist_ok=True)
            [made] = (tmp_path / f"part{self.n}").glob("*.parquet")
            to = self.at / f"{self.n:04}.parquet"
            made.rename(to)
            os.utime(to, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
            self.n += 1

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.at))

    return Inbox()


def test_frontier_after_any_restart(spark, tmp_path, inbox):
    rng, seen, done = random.Random(1), set(), set()
    runs, checkpoint = Runs(spark, str(tmp_path / "frontier"), fan=2, buckets=2), str(tmp_path / "cp")
    assert live.frontier_of(runs) is None
    for k in range(5):
        rows = [(rng.randint(1, 2), f"u{rng.randrange(30)}", rng.random() < 0.4) for _ in range(25)]
        inbox.put(rows, "session_id long, url string, crawled boolean")
        if k % 2:  # two files, then the query is started anew
            live.keep_frontier(inbox.stream(), runs, checkpoint).awaitTermination()
        for session, url, crawled in rows:
            (done if crawled else seen).add((session, url))
        if k % 2:
            assert {tuple(r) for r in live.frontier_of(runs).collect()} == seen - done
    live.keep_frontier(inbox.stream(), runs, checkpoint).awaitTermination()
    assert {tuple(r) for r in live.frontier_of(runs).collect()} == seen - done
    every = spark.read.parquet(str(inbox.at))
    assert {(r.session_id, r.url) for r in live.frontier_state(every).where("seen and not done").collect()} == seen - done


def walked_rates(rows, width=10, slide=5):
    out = {}
    for host in {h for h, _ in rows}:
        times = [t for h, t in rows if h == host]
        for start in range(-width, int(max(times)) + 1, slide):
            inside = [t for t in times if start <= t < start + width]
            if inside:
                out[host, start] = (len(inside), round(len(inside) / max(start + width - min(inside), 1.0), 2))
    return out


def test_rates_and_late_rows(spark, tmp_path, inbox):
    rng = random.Random(5)
    at = lambda s: START + timedelta(seconds=s)
    first = [(rng.choice("ab"), rng.randrange(0, 200) / 10) for _ in range(40)] + [("a", 19.9)]
    second = [(rng.choice("ab"), rng.randrange(150, 400) / 10) for _ in range(40)] + [("a", 60.0)]
    late, on_time = [("a", 1.0), ("b", 2.5)], [("a", 56.0), ("b", 58.0)]
    for rows in (first, second, late + on_time, [("a", 500.0)], [("a", 501.0)]):
        inbox.put([(h, at(s)) for h, s in rows], "host string, ts timestamp")
    runs = Runs(spark, str(tmp_path / "rates"), key=("host", "start"))
    windows = {"width": "10 seconds", "slide": "5 seconds", "late": "5 seconds"}
    live.keep_rates(inbox.stream(), runs, str(tmp_path / "cp"), **windows).awaitTermination()
    of = lambda df: {(r.host, int((r.start - START).total_seconds())): (r.n, r.pages_per_sec) for r in df.collect()}
    # The watermark had passed the windows of the late rows; everything else counts.
    counted = first + second + on_time + [("a", 500.0), ("a", 501.0)]
    assert of(runs.read()) == walked_rates(counted)
    batch = spark.createDataFrame([(h, at(s)) for h, s in counted], "host string, ts timestamp")
    assert of(live.rates(batch, "10 seconds", "5 seconds")) == walked_rates(counted)
    closed = str(tmp_path / "closed")
    live.rates(inbox.stream(), **windows).writeStream.outputMode("append").format("parquet").option("path", closed).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert of(spark.read.parquet(closed)) == {k: v for k, v in walked_rates(counted).items() if k[1] < 480}


def walked_snapshots(files):
    """Rows one by one: at a row whose tick lies beyond the last, what changed before it is put out."""
    out, held = set(), {}
    for rows in files:
        for session, ms, seq, url, status, error, ends in sorted(rows, key=lambda r: (r[1], r[2])):
            s = held.setdefault(session, {"rows": 0, "errors": 0, "last": None, "latest": [], "dirty": False, "tick": 0})
            shot = lambda final, s=s, session=session: out.add((session, s["tick"], s["rows"], s["errors"], s["last"], tuple(s["latest"][-200:]), final))
            tick = max(s["tick"], (ms // 500 + 1) * 500)
            if s["dirty"] and tick > s["tick"]:
                shot(False)
                s["dirty"] = False
            s["tick"] = tick
            if ends:
                shot(True)
                del held[session]
            else:
                s["rows"] += 1
                s["errors"] += bool(error)
                s["last"], s["dirty"] = url, True
                s["latest"].append(status)
    return out, {k: s for k, s in held.items() if s["dirty"]}


def test_progress_snapshots(spark, tmp_path, inbox):
    rng, files, now, seq = random.Random(2), [], 1_704_067_200_000, 0
    for k in range(6):
        rows = []
        for _ in range(40):
            now += rng.choice([0, 1, 30, 200, 1200])
            seq += 1
            rows.append((rng.choice([1, 1, 2]) if k < 4 else 1, now, seq, f"u{seq}", rng.choice([200, 404]), rng.choice(["", None, "Timeout"]), False))
        files.append(rows)
    files.append([(2, now + 10, seq + 1, None, None, None, True), (3, now + 20, seq + 2, "x", 200, "", False)])
    files.append([(1, now + 5000, seq + 3, None, None, None, True), (4, now + 60_000, seq + 4, "y", 200, "", False)])
    for rows in files:
        inbox.put([(s, datetime.fromtimestamp(ms // 1000) + timedelta(milliseconds=ms % 1000), *rest) for s, ms, *rest in rows], "session_id long, ts timestamp, seq long, url string, status long, error string, ends boolean")
    runs = Runs(spark, str(tmp_path / "p"), key=("session_id", "tick_ms", "final"))
    live.keep_progress(inbox.stream(), runs, str(tmp_path / "cp")).awaitTermination()
    got = {(r.session_id, r.tick_ms, r.row_count, r.error_count, r.last_url, tuple(r.latest_statuses), r.final) for r in runs.read().collect()}
    want, waiting = walked_snapshots(files)
    # Session 3 has no later row: its timer puts it out once the watermark is past its tick. Session 4 still waits.
    assert set(waiting) == {3, 4}
    assert got == want | {(3, waiting[3]["tick"], 1, 0, "x", (200,), False)}
    assert sum(r[6] for r in got) == 2 and len(got) > 40


def test_rates_of_no_rows(spark):
    assert live.rates(spark.createDataFrame([], "host string, ts timestamp")).count() == 0
    assert live.frontier_state(spark.createDataFrame([], "session_id long, url string, crawled boolean")).count() == 0


def test_disk_of_small_batches(spark, tmp_path):
    """A stream's table is as large as its rows: no megabyte of Bloom filter a file, no runs that were merged long ago."""
    runs = Runs(spark, str(tmp_path / "t"), buckets=2)
    write = live._into(runs)
    for k in range(9):
        write(spark.range(40).select(F.lit(1).cast("long").alias("session_id"), F.concat(F.lit("u"), F.col("id") + 4 * k).alias("url")), k)
    sizes = [f.stat().st_size for f in (tmp_path / "t" / "runs").rglob("*.parquet")]
    assert max(sizes) < 20_000 and len(list((tmp_path / "t" / "runs").iterdir())) <= 4
    assert runs.read().count() == 72 and len(list((tmp_path / "t" / "manifest").glob("*.json"))) == 2
