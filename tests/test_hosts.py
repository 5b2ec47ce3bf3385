"""Per-host state: detector, classification, pacing, in batch and as a stream."""

import json

from pyspark.sql import functions as F

from spiderglass.plans.profiles import Profiles, merged_settings
from spiderglass.streaming import hosts, router
from spiderglass.streaming.hosts import Host


def feed(h, n, status=200, title="", body=50_000, links=10, start=0, gap=10, url="u"):
    out = []
    for i in range(start, start + n):
        out += h.feed(i, i * gap, f"{url}{i}", status, title, body, links)
    return out


def kinds(events, kind):
    return [e for e in events if e["type"] == kind]


def test_five_in_a_row_trip_and_cool_down():
    h = Host()
    out = feed(h, 5, 403)
    assert [(e["blocked"], e["cooldown_ms"], e["attempt"]) for e in kinds(out, "block-detected")] == [(5, 60_000, 1)]
    assert kinds(feed(h, 1, start=10), "parked") and h.s["gated"]
    later = h.feed(99, 70_000, "u", 200, "", 50_000, 1)
    assert kinds(later, "block-cooldown-cleared") and not h.s["gated"] and h.s["attempts"] == 1
    waits = []
    for k in range(4):
        trip = kinds(feed(h, 5, 403, start=100_000 * (k + 1), gap=10), "block-detected")
        waits += [e["cooldown_ms"] for e in trip]
        h.expire(10**12)
    assert waits == [120_000, 240_000, None] and h.s["gated"]
    h.command(1, 1, "resume-host")
    assert not h.s["gated"] and h.s["attempts"] == 0


def test_ten_of_fifteen_trip():
    h, out = Host(), []
    for i in range(15):
        out += h.feed(i, i, f"u{i}", 429 if i % 3 else 200, "", 50_000, 1)
    assert [e["blocked"] for e in kinds(out, "block-detected")] == [10]


def test_repeated_titles_of_small_bodies():
    h = Host()
    assert [h.reason(200, "Same", 900)] == [None]
    out = feed(h, 7, 200, "Same", 900)
    assert "soft_title_repeat" in kinds(out, "block-detected")[0]["reason"]
    assert not kinds(feed(Host(), 20, 200, "Same", 90_000), "block-detected") and not kinds(feed(Host(), 20, 200, "Same", None), "block-detected")
    assert Host().reason(200, "Just a moment...", None) == "soft_title_phrase"


def test_baseline_and_cloaking():
    h = Host()
    for i in range(1, 20):
        h.feed(i, i, f"u{i}", 200, f"t{i}", i * 1000 + 15_001, i)
    assert h.baseline() is None
    h.feed(20, 20, "u20", 200, "t20", 20 * 1000 + 15_001, 20)
    assert h.baseline() == (25_501, 10.5) and h.classify(200, "x", 100, 0) == "cloaked" and h.classify(200, "x", 100, 5) == "ok" and h.classify(404, "", 1, 1) == "other"
    assert [h.classify(s, "", 1, 1) for s in (403, 503, 500)] == ["blocked-status:403", "blocked-status:503", "blocked-status:5xx"] and h.classify(404, "Access denied", 1, 1) == "blocked-content"


def test_pacing():
    h = Host(delay_ms=1000)
    up = kinds(h.feed(0, 0, "u", 429, "", 1, 1), "controller-state")[0]
    assert (up["action"], up["delay_ms"]) == ("step-up", 1600)
    out = feed(h, 400, start=1, gap=1000)
    downs = [e for e in kinds(out, "controller-state") if e["action"] == "step-down"]
    assert len(downs) == 2 and downs[0]["delay_ms"] == 1500
    h = Host()
    for i in range(60):
        h.tick("blocked-status:403", "u", i)
    assert h.s["mult"] == 15.0


def test_reprobe_on_a_burst():
    h = Host(cooldowns=())
    h.s["cooldowns"] = []
    out = []
    for i in range(30):
        h.s["gated"] = False
        out += h.feed(i, i * 100, f"u{i}", 403, "", 1, 1)
    assert [e["reason"] for e in kinds(out, "re-probe-requested")] == ["403-burst"]


def test_state_survives_a_dump():
    a, b = Host(), Host()
    feed(a, 7, 200, "Same", 900)
    feed(b, 3, 200, "Same", 900)
    c = Host.load(b.dump())
    feed(c, 4, 200, "Same", 900, start=3)
    assert json.loads(a.dump()) == json.loads(c.dump())


def _rows():
    return [(f"h{i % 3}", i, i * 100, f"u{i}", 403 if i % 3 == 0 else 200, f"t{i}", 20_000 + i, i % 7) for i in range(60)]


SCHEMA = "host string, seq long, ts_ms long, url string, status long, title string, body_bytes long, internal_links long"


def test_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(_rows(), SCHEMA)
    want = [json.dumps(r.asDict(), sort_keys=True) for r in hosts.replay(df).collect()]
    assert any('"block-detected"' in w for w in want)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    q = hosts.track(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("host_events").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    assert q.awaitTermination(90)
    got = [json.dumps(r.asDict(), sort_keys=True) for r in spark.table("host_events").collect()]
    assert sorted(got) == sorted(want)
    assert {r.host for r in hosts.pacing_latest(hosts.replay(df)).collect()} == {"h0", "h1", "h2"}


def test_probe_policy(spark):
    rows = [(1, i, i == 4, i != 5, "403") for i in range(7)] + [(2, 0, False, False, None), (2, 1, False, True, "x")]
    got = [r.verdict for r in hosts.probe_policy(spark.createDataFrame(rows, "run long, position long, headed boolean, blocked boolean, reason string")).orderBy("run", "position").collect()]
    assert got == ["blocked", "blocked", "blocked", "skipped", "blocked", "skipped", "skipped", "won", "skipped"]


def test_stream_of_lines_is_stored(spark, tmp_path):
    lines = [{"url": "a", "status": 200, "resourceType": "HTML", "title": "A"}, {"type": "discovered", "urls": ["a", "b"]}, {"event": "sitemap-discovered", "total": 2}, {"url": "a", "status": 404, "resourceType": "HTML", "title": "gone"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.ndjson").write_text("\n".join(json.dumps(x) for x in lines[:3]) + "\n\nnoise\n")
    store = router.Store(spark, str(tmp_path / "store"))
    run = lambda: router.start(spark, str(tmp_path / "in"), store, 1, str(tmp_path / "cp")).awaitTermination(90)
    run()
    assert [(r.url, r.status, r.title) for r in store.results().collect()] == [("a", 200, "A")] and [r.url for r in store.frontier().collect()] == ["b"]
    (tmp_path / "in/2.ndjson").write_text(json.dumps(lines[3]) + "\n")
    run()
    assert [(r.url, r.status, r.title) for r in store.results().collect()] == [("a", 404, "")]
    p = router.progress(store.results()).first()
    assert (p.row_count, p.error_count, p.last_url) == (1, 0, "a")


def test_generations(spark):
    from spiderglass.sources.readers import parse_lines

    lines = [json.dumps({"url": u, "status": 200, "generation": g}) for u, g in (("old", 1), ("new", 2), ("new2", 2))] + [json.dumps({"type": "what"}), "x"]
    routed = router.current(router.route(parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))))
    assert sorted((r.sink, r.n) for r in routed.groupBy("sink").count().withColumnRenamed("count", "n").collect()) == [("log", 1), ("other", 1), ("result", 2)]


def test_profiles(tmp_path):
    p = Profiles(str(tmp_path / "p.json"))
    p.create("a", {"x": 1})
    p.duplicate("a", "b")
    p.rename("b", "c")
    p.set_default("c")
    p.delete("a")
    assert [(r["name"], r["is_default"]) for r in p.all()] == [("c", True)]
    for bad in (lambda: p.delete("c"), lambda: p.create("c", {})):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass
    assert merged_settings({"a": 1, "inputs": {"customHeaders": {}, "n": 2}}, {"a": 5, "zzz": 1, "inputs": {"customHeaders": {"h": "v"}}}) == {"a": 5, "inputs": {"customHeaders": {"h": "v"}, "n": 2}}


def test_rate_limiter_paces_like_a_walk(spark):
    import random

    from spiderglass.operators import windows

    rng = random.Random(4)
    rows = []
    for host in "abc":
        at = 0
        for seq in range(60):
            at += rng.randrange(0, 1500)
            rows.append((host, seq, at, rng.random() < 0.1, 1))
    df = spark.createDataFrame(rows, "host string, seq long, ts_ms long, blocked boolean, delay_min int")
    got = {(r.host, r.seq): r for r in windows.paced(df, 300, 900).collect()}
    for host in "abc":
        last, mult = None, 1.0
        for h, seq, at, blocked, _ in rows:
            if h != host:
                continue
            r = got[(h, seq)]
            assert r.multiplier == mult and round(300 * mult) <= r.delay_ms <= round(900 * mult)
            start = at if last is None else max(at, last + r.delay_ms)
            assert r.start_ms == start and r.gap_ms == (0 if last is None else start - last)
            last, mult = start, min(mult * 2, 8.0) if blocked else mult
    assert windows.paced(df.where("false"), 1, 2).count() == 0
    assert [r[0] for r in spark.createDataFrame([(0.0,), (2.0,), (99.0,)], "m double").select(windows.multiplier(F.col("m"))).collect()] == [0.05, 2.0, 50.0]
