"""Every query with SQL against DuckDB on the smallest tables; graph properties."""

import math

import duckdb
import pytest
from helpers import results

import __spark_entry__ as entry_point
from spiderglass import catalog
from spiderglass.operators import graph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got = entry_point.queries()[name](spark, sf)
    want = duck.execute(entry_point.oracle_sql()[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_probe_policy_folds_all_rows(spark, sf):
    from spiderglass.plans import views

    want, state = {}, {}
    for r in sorted(views.raw_log(spark, sf).select("id", "status").collect()):
        run, (won, same, last) = r.id // 10, state.get(r.id // 10, (False, 0, None))
        if won or same >= 3 and r.id % 4:
            want[(run, r.id % 10)] = "skipped"
        elif r.status in (403, 404, 429, 503):
            want[(run, r.id % 10)] = "blocked"
            state[run] = (False, same + 1 if r.status == last else 1, r.status)
        else:
            want[(run, r.id % 10)] = "won"
            state[run] = (True, 0, None)
    got = {(r.run, r.position): r.verdict for r in catalog.QUERIES["probe_policy"](spark, sf).collect()}
    assert got == want and max(want)[0] >= 40


def walked(rows):
    """Another walk over one host's responses: gates from the whole history since the last clearing, pacing from all multipliers."""
    out, history, titles, gate_until, attempts, waiting = [], [], {}, None, 0, 0
    mult, clean, last_block, full_since, asked, kinds = 1.0, 0, None, None, None, []
    for r in rows:
        if gate_until is not None and r.ts_ms >= gate_until:
            out.append((r.seq, "block-cooldown-cleared", waiting))
            history, titles, gate_until, waiting = [], {}, None, 0
        if gate_until is not None:
            waiting += 1
            out.append((r.seq, "parked", None))
            continue
        small = r.status == 200 and r.title and r.body_bytes <= 15000
        seen_before = len(titles.get(r.title, ()))
        refused = r.status in (403, 429) or 500 <= r.status < 600
        soft = not refused and small and seen_before >= 3
        kinds.append(refused or bool(soft))
        if refused or soft:
            mult, clean, last_block = min(15.0, mult * 1.6), 0, r.ts_ms
        elif 200 <= r.status < 300:
            clean += 1
            if clean >= 200 and (last_block is None or r.ts_ms - last_block >= 60000) and mult > 0.25:
                mult, clean = max(0.25, mult - 0.1), 0
        if not (asked is not None and r.ts_ms - asked < 300000):
            full_since = None if mult < 15 - 1e-9 else r.ts_ms if full_since is None else full_since
            if full_since is not None and r.ts_ms - full_since >= 300000 and sum(kinds[-100:]) / len(kinds[-100:]) > 0.2:
                asked = r.ts_ms
                out.append((r.seq, "re-probe-requested", None))
        if small:
            titles.setdefault(r.title, set()).add(r.url)
            # The detector looks again after the title is taken in.
            soft = not refused and len(titles[r.title]) >= 3
        history.append(refused or bool(soft))
        if len(history) >= 5 and all(history[-5:]) or sum(history[-15:]) >= 10:
            gate_until = r.ts_ms + (60000, 120000, 240000)[attempts] if attempts < 3 else float("inf")
            attempts = min(3, attempts + 1)
            out.append((r.seq, "block-detected", sum(history[-15:])))
    return out


def test_host_queries_against_another_walk(spark, sf):
    rows, by_host = sorted(catalog.storm(spark, sf).collect(), key=lambda r: r.seq), {}
    for r in rows:
        by_host.setdefault(r.host, []).append(r)
    want = {(host, *event) for host, mine in by_host.items() for event in walked(mine)}
    of = lambda *types: {w for w in want if w[2] in types}
    got = {n: catalog.QUERIES[n](spark, sf).collect() for n in ("block_detector", "park_unpark", "adaptive_controller", "reprobe_gate")}
    detected = of("block-detected", "block-cooldown-cleared")
    assert len(detected) > 5 and {(r.host, r.seq, r.type, r.blocked) for r in got["block_detector"]} == detected
    assert {(r.host, r.seq, r.type) for r in got["park_unpark"]} == {w[:3] for w in detected | of("parked")}
    asked = {w[:2] for w in of("re-probe-requested")}
    assert len(asked) > 5 and {(r.host, r.seq) for r in got["adaptive_controller"] if r.type == "re-probe-requested"} == asked
    assert {(r.host, r.seq) for r in got["reprobe_gate"] if r.fires} == asked


def test_entry(spark):
    assert entry_point.entry(spark).count() == 3


def chain(spark, links):
    return results(spark, [{"url": u, "outlinks": out} for u, out in links])


def test_pagerank_sums_to_one(spark):
    df = chain(spark, [("a", ["b", "c", "b", "a", "zz"]), ("b", ["c"]), ("c", []), ("d", ["a"])])
    got = {r.url: r for r in graph.pagerank(df).collect()}
    assert abs(sum(r.score for r in got.values()) - 1) < 1e-6 and got["c"].score == max(r.score for r in got.values())
    assert (got["a"].indegree, got["a"].outdegree, got["c"].outdegree) == (1, 2, 0)


def test_bfs_and_orphans(spark):
    df = chain(spark, [("a", ["b"]), ("b", ["c", "a"]), ("c", ["d"]), ("o", ["a"])])
    seeds = spark.createDataFrame([(1, "a")], "session_id long, url string")
    assert {r.url: r.depth for r in graph.bfs_depth(df, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.url for r in graph.bfs_depth(df, seeds, most=2).collect()} == {"a", "b"}
    assert [r.url for r in graph.orphans(df).collect()] == ["o"]


def test_page_facts_as_sql(spark, tmp_path):
    """Titles with character references other than &amp;, also ones that were cut off; the extractor decodes them all."""
    import duckdb

    from spiderglass.catalog import ORACLE_SQL, QUERIES
    from spiderglass.functions.html import facts

    titles = ["a &amp; b", "token = &quot;x&quot;", "cut&amp;&amp", "cut&quo", "&lt;b&gt; &#x27;", "a & b", "&amp;quot;", "&amp;amp;"]
    rows = [(k, f"https://a.example/{k}", f'<html><head><title>{t}</title></head><body><h1>{t}</h1><a href="/x?a=1&quot;">x</a></body></html>') for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["extract_page_facts"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    con.execute("create view events as select * from read_parquet('/root/testdata/sf0.001/events.parquet')")
    assert got == sorted(con.execute(ORACLE_SQL["extract_page_facts"]).fetchall())
    assert facts(rows[1][2], "https://a.example/")["title"] == 'token = "x"'


def test_batches_of_a_long_log_are_bounded(spark, sf, monkeypatch):
    """A log of more events has more micro-batches, not larger ones."""
    from spiderglass import catalog

    events = spark.read.parquet(f"{sf}/events.parquet").count()
    monkeypatch.setattr(catalog, "EVENTS_A_FILE", -(-events // 6))
    store = catalog.streamed(spark, sf)
    assert store.results_runs.manifest()["batch"] == 2
    assert store.results().count() == catalog.views.raw_log(spark, sf).select("url").distinct().count()
