"""Text index, paging by order statistics, batched tables and health by changes."""

import random
import re

import pytest
from helpers import results
from pyspark.sql import functions as F

from spiderglass.operators import aggregates, files, grid, ingest, paging
from spiderglass.operators.filters import ResultsFilter, filtered
from spiderglass.operators.health import HealthView, frontier_change
from spiderglass.operators.runs import Runs
from spiderglass.operators.textindex import TextIndex, grams_of
from spiderglass.streaming import router

TEXTS = [None, "", "ab", "abc", "ABCABC", "aaaa", "xaaay", "Straße ÉÀ", "a😀b😀c", "100% off", "a_b", "line\nbreak", "abc" * 500, "no", "The Title", "the titles"]


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    more = ["".join(rng.choices("abcde ", k=rng.randint(0, 30))) for _ in range(300)]
    return spark.createDataFrame([(i * 3, t, None if i % 5 else f"u{i}") for i, t in enumerate(TEXTS + more)], "id long, title string, url string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    made = TextIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), ["url", "title"], parts=4, block_bits=6)
    return made.add(texts.where("id < 300")).add(texts.where("id >= 300")).add(texts.where("false"))


def test_index_equals_the_scan(index, texts):
    for needle in ["abc", "ABC", " abc ", "aaa", "aaaa", "a", "", "%", "ße é", "a😀b", "😀b😀", "b😀c", "line\nb", "abcabcabcabc", "cba", "u10", "zzz", "a_b", "the title", "e d", "bcd", "c" * 4]:
        want = texts.where(F.lower("url").contains(needle.strip().lower()) | F.coalesce(F.lower("title").contains(needle.strip().lower()), F.lit(False)))
        assert ids(index.search(needle)) == ids(want), needle


def test_index_reads_few_postings_and_blocks(index, texts):
    rare = index.search("the titles")
    plan = rare._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and re.search(r"PartitionFilters: \[[^\]]*block#", plan) and "In(gram" in plan
    assert index.chosen("the titles")[1] == 1 and ids(rare) == [45]
    # A text that very many rows hold is scanned.
    assert index.chosen("abc")[1] <= texts.count()


def test_index_of_many_needles(spark, index, texts):
    needles = ["abc", "The Title", "aab", "zzzz", "ab", None, "", "u10", "cde"]
    got = sorted(map(tuple, index.search_all(spark.createDataFrame([(n,) for n in needles + ["abc"]], "needle string")).collect()))
    want = sorted((n, i) for n in needles if n and len(n) >= 3 for i in ids(texts.where(F.lower("url").contains(n.lower()) | F.lower("title").contains(n.lower()))))
    assert got == want


def test_grams(spark):
    row = spark.createDataFrame([("AbCdbcd", "ab", None)], "a string, b string, c string").select(*[grams_of(F.col(c)).alias(c) for c in "abc"]).first()
    assert row.a == ["abc", "bcd", "cdb", "dbc"] and row.b == [] and row.c is None


def test_a_batch_without_counts_is_not_there(spark, tmp_path, texts):
    index = TextIndex(spark, str(tmp_path / "i"), ["title"], parts=2, block_bits=6)
    with pytest.raises(ValueError):
        index.search("abc")
    index.add(texts)
    before = ids(index.search("abc"))
    files.remove(spark, f"{index.path}/counts/{files.names(spark, f'{index.path}/counts')[0]}/_SUCCESS")
    with pytest.raises(ValueError):
        index.search("abc")
    assert ids(index.add(texts).search("abc")) == before


def test_filter_by_index(spark, tmp_path):
    rows = results(spark, [{"url": f"https://a/{i}", "title": "Pricing" if i % 3 else "Other", "status": 200 if i % 2 else 404} for i in range(60)])
    index = TextIndex(spark, str(tmp_path / "i"), ["url", "title"], block_bits=3).add(rows)
    f = ResultsFilter(text="PRICING", statusMin=400)
    assert ids(filtered(rows, f, index)) == ids(filtered(rows, f)) != []


# ---- paging


@pytest.mark.parametrize(("column", "direction"), [("title", "asc"), ("title", "desc"), ("response_time", "DESC"), ("status", "asc"), (None, "asc"), ("seo; DROP", "desc")])
def test_pages_like_offset(spark, column, direction):
    rng = random.Random(7)
    rows = [{"url": f"u{i}", "title": rng.choice([None, "", "Same", "Same", "Same", f"t{i % 17}", "É"]), "responseTime": rng.choice([0, 5, 5, 900]), "status": 200} for i in range(403)]
    df = results(spark, rows).withColumn("title", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("title"))).select("id", "title", "response_time", "status")
    whole = [r.id for r in grid.sort_results(df, column, direction).collect()]
    order = paging.Ordered.write(df, column, direction, runs=7)
    assert order.total == 403
    for number, size in ((0, 50), (3, 50), (8, 50), (9, 50), (402, 1), (1, 403), (0, 1000), (2, 137)):
        assert [r.id for r in order.page(number, size).collect()] == whole[number * size : (number + 1) * size]
    assert [r.id for r in order.places().orderBy("place").collect()] == whole
    starts = sorted(map(tuple, order.page_starts(100).collect()))
    assert starts == [(k, len(p), p[0], p[-1]) for k in range(5) for p in [whole[k * 100 : (k + 1) * 100]]]


def test_pages_read_their_runs_only(spark):
    df = spark.range(10_000).select("id", F.lit("one title").alias("title"))
    order = paging.Ordered.write(df, "title", runs=20)
    sizes = [b - a for a, b in zip(order.before, order.before[1:], strict=False)]
    assert len(sizes) == 20 and max(sizes) < 1000  # one value, yet even runs
    page = order.page(60, 100)
    assert [r.id for r in page.collect()] == list(range(6000, 6100))
    assert order.between(6000, 6100).select(F.input_file_name()).distinct().count() <= 2
    assert re.search(r"PartitionFilters: \[[^\]]*_run#", page._jdf.queryExecution().executedPlan().toString())
    assert paging.Ordered.write(df.where("false"), "title").page(0, 10).count() == 0


# ---- runs


def batches_of(rng, n, keys=40):
    """Batches of (session, url, value, line), keys repeating within and across."""
    return [[(rng.randint(1, 2), f"u{rng.randrange(keys)}", rng.randrange(1000), line) for line in range(rng.randint(0, 30))] for _ in range(n)]


def frame(spark, batch, number):
    rows = spark.createDataFrame(batch, "session_id long, url string, value long, line long")
    return rows.withColumn("seq", F.struct(F.lit(number).cast("long").alias("batch"), "line")).drop("line")


def state(df):
    return {} if df is None else {(r.session_id, r.url): r.value for r in df.collect()}


def test_runs_keep_the_last_row(spark, tmp_path):
    rng = random.Random(1)
    runs, want = Runs(spark, str(tmp_path / "r"), fan=2, buckets=4), {}
    assert runs.read() is None and runs.lookup(frame(spark, [], 0)) is None
    for k, batch in enumerate(batches_of(rng, 9)):
        assert runs.append(frame(spark, batch, k), k) and not runs.append(frame(spark, batch, k), k)
        want |= {(s, u): v for s, u, v, _ in batch}
        runs.compact()
        assert state(runs.read()) == want
        tiers = [r["tier"] for r in runs.manifest()["runs"]]
        assert all(tiers.count(t) < 2 for t in tiers) and tiers == sorted(tiers, reverse=True)
    some = [(1, "u1"), (2, "u5"), (1, "nowhere")]
    found = runs.lookup(spark.createDataFrame(some, "session_id long, url string"))
    assert state(found) == {k: want[k] for k in some if k in want}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan) and "In(url" in plan
    assert runs.clean() and state(runs.read()) == want and not runs.clean()


class Crash(Exception):
    pass


@pytest.mark.parametrize("after", [1, 2, 3, 4, 6, 7])
def test_a_crash_between_any_steps(spark, tmp_path, monkeypatch, after):
    """Writing stops after some step (a table written, a manifest made or cut short) and begins again."""
    rng = random.Random(4)
    work, want, left = batches_of(rng, 3, 12), {}, [after]
    write, publish, create = Runs._write, Runs._publish, files.create

    def step(f, whole=True):
        def run(*a, **b):
            left[0] -= 1
            if left[0] == 0 and not whole:
                create(a[0], a[1], a[2][: len(a[2]) // 2])
                raise Crash
            out = f(*a, **b)
            if left[0] == 0:
                raise Crash
            return out

        return run

    monkeypatch.setattr(Runs, "_write", step(write))
    monkeypatch.setattr(files, "create", step(create, whole=after % 2 == 0))
    monkeypatch.setattr(Runs, "_publish", step(publish))
    path = str(tmp_path / "r")
    for k, batch in enumerate(work):
        for attempt in range(2):
            runs = Runs(spark, path, fan=2, buckets=2)
            before = state(runs.read())
            try:
                runs.append(frame(spark, batch, k), k)
                runs.compact()
                break
            except Crash:
                assert attempt == 0
                # What is read is all of the batch or nothing of it.
                assert state(Runs(spark, path, fan=2, buckets=2).read()) in (before, before | {(s, u): v for s, u, v, _ in batch})
        want |= {(s, u): v for s, u, v, _ in batch}
        assert state(Runs(spark, path, fan=2, buckets=2).read()) == want
    Runs(spark, path, fan=2, buckets=2).clean()
    assert state(Runs(spark, path, fan=2, buckets=2).read()) == want


# ---- health by changes


def random_batch(rng, size):
    kinds = [{"status": 200}, {"status": 200, "title": "T", "h1": "H"}, {"status": 301, "redirectUrl": "x"}, {"status": 404}, {"status": 0, "error": "Timeout"}, {"status": 503, "error": ""}]
    out = []
    for i in range(size):
        secure = rng.choice([None, {"hsts": True, "csp": False, "xFrameOptions": True}, {"hsts": False, "csp": False, "xFrameOptions": False}])
        out.append({"sessionId": rng.choice([1, 1, 2]), "url": f"u{rng.randrange(25)}", "id": i, "responseTime": rng.choice([0, 10, 10, 500, 900]), "resourceType": rng.choice(["HTML", "Image"]), "isNoindex": rng.random() < 0.3, "securityHeaders": secure, **rng.choice(kinds)})
    return out


def test_health_after_every_batch(spark, tmp_path):
    rng = random.Random(11)
    store, log, seen = router.Store(spark, str(tmp_path / "s")), None, None
    assert store.health().count() == 0
    for k in range(6):
        batch = results(spark, random_batch(rng, rng.choice([1, 8, 20]))).withColumn("line", F.col("id"))
        found = spark.createDataFrame([(rng.choice([1, 2]), f"u{rng.randrange(40)}") for _ in range(rng.randint(0, 15))], "session_id long, url string")
        store.write(batch, found, k)
        store.write(batch, found, k)  # done again
        if k in (2, 4):
            store.health_view.fold()
            store.health_view.apply(k, batch.drop("line"))  # late and already folded
        rows = batch.withColumn("seq", F.col("line") + 1000 * k)
        log = rows if log is None else log.unionByName(rows)
        seen = found if seen is None else seen.union(found)
        crawl = ingest.last_wins(log, "seq")
        want = aggregates.health(crawl, ingest.frontier(seen, crawl))
        assert store.health().columns == want.columns
        assert sorted(map(tuple, store.health().collect())) == sorted(map(tuple, want.collect()))


def test_the_maximum_comes_back_down(spark, tmp_path):
    view = HealthView(spark, str(tmp_path / "h"))
    slow, quick = results(spark, [{"url": "a", "responseTime": 900}]), results(spark, [{"url": "a", "responseTime": 5}])
    view.apply(0, results(spark, [{"url": "b", "responseTime": 40}]).unionByName(slow))
    view.apply(1, quick, slow)
    r = view.read().first()
    assert (r.total, r.max_response_time, r.avg_response_time) == (2, 40, 22.5)


def test_frontier_change(spark):
    f = lambda *urls: spark.createDataFrame([(1, u) for u in urls], "session_id long, url string")
    got = frontier_change(f("a", "b"), f("c"), f("b", "c", "d", "d", "e"), f("a", "e", "x")).collect()
    assert [tuple(r) for r in got] == [(1, 0)]  # d comes, a goes; b known, c crawled, e both at once
    assert frontier_change(None, None, f("a", "a"), f("z")).first().n == 1
