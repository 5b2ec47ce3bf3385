"""The fixed ten rows, overflow filters, ingest and export."""

import csv
import io
import json
import zipfile

import pytest
from helpers import results
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spiderglass.functions import text
from spiderglass.operators import aggregates, export, filters, grid, ingest, sets
from spiderglass.operators.filters import ResultsFilter, build_filter, filtered


def row(n, status, title, h1, rt, redirect="", kind="HTML", idx=0, noidx=0, nofol=0, error=None, seo=None, sid=1, host="a"):
    return {"sessionId": sid, "url": f"https://{host}.com/{n}", "status": status, "title": title, "h1": h1, "responseTime": rt, "redirectUrl": redirect, "resourceType": kind, "isIndexable": bool(idx), "isNoindex": bool(noidx), "isNofollow": bool(nofol), "error": error} | (seo or {})


PRICE = lambda v: {"scraper": {"price": {"value": v, "appears": bool(v)}}}
TEN = [
    row(1, 200, "Welcome", "Hello", 100), row(2, 301, "Old URL", "", 50, "https://a.com/2-new", idx=1), row(3, 404, "Not Found", "", 30, noidx=1), row(4, 500, "Server Error", "", 800, error="host_blocked_by_detector:akamai"),
    row(5, 200, "Pricing Page", "Plans", 250, idx=1, seo=PRICE("")), row(6, 200, "Article", "Big Heading", 450, idx=1, seo=PRICE("$10")), row(7, 200, "About", "About Us", 75, idx=1, nofol=1), row(8, 204, "", "", 12, idx=1),
    row(9, 200, "Resource", "", 90, kind="JavaScript"), row(1, 200, "Other crawl", "Hi", 10, idx=1, sid=2, host="b"),
]


@pytest.fixture(scope="module")
def ten(spark):
    return results(spark, TEN).cache()


@pytest.fixture(scope="module")
def one(ten):
    return ten.where("session_id = 1")


def test_counts_of_each_filter(one):
    n = lambda **f: filtered(one, ResultsFilter(**f)).count()
    assert n() == 9 and n(statusMin=400, statusMax=600) == 2 and n(hasRedirect=True) == 1 and n(hasRedirect=False) == 8
    assert [n(indexability=x) for x in ("indexable", "noindex", "nofollow", "garbage")] == [5, 1, 1, 9]
    assert n(errorPrefix="host_blocked_by_detector") == 1 and n(errorPrefix="HOST_BLOCKED") == 1 and n(emptyScraperRule="price") == 8
    assert [r.title for r in filtered(one, ResultsFilter(text="PRICING")).collect()] == ["Pricing Page"] and n(text="%") == 0
    assert n(issuesOnly=True) == 7 and n(urlIn=tuple(f"https://a.com/{i}" for i in (1, 3, 8))) == 3 and n(urlIn=()) == 0
    many = tuple(f"https://a.com/{i}" for i in range(3, 3000))
    assert n(urlIn=many) == 7 and n(duplicateField="title") == 0


def test_sort_and_pages(one):
    top = grid.sort_results(one, "response_time", "DESC").limit(3).collect()
    assert [r.response_time for r in top] == [800, 450, 250] and [r.id for r in grid.sort_results(one, "nope").limit(3).collect()] == [1, 2, 3]
    assert [grid.page(one, k, 3).count() for k in range(4)] == [3, 3, 3, 0] and grid.last_page(9, 3) == 3 and grid.last_page(0, 3) == 1
    assert [r.id for r in grid.after(one, 4, 2).collect()] == [5, 6]


def test_point_lookup_merges_overflow(one):
    r = grid.merge_overflow(grid.point_lookup(one, 1, "https://a.com/6")).first()
    assert r.scraper["price"]["value"] == "$10" and r.title == "Article" and r.error is None
    assert grid.point_lookup(one, 1, "https://nowhere").count() == 0


def test_health(ten, spark):
    frontier = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "x")], "session_id long, url string")
    h = aggregates.health(ten, frontier).where("session_id = 1").first()
    assert (h.total, h.status_2xx, h.status_3xx, h.status_4xx, h.status_5xx, h.errors, h.redirects) == (9, 6, 1, 1, 1, 1, 1)
    assert (h.indexable, h.noindex, h.nofollow, h.empty_h1, h.empty_title, h.max_response_time, h.sec_html, h.frontier) == (5, 1, 1, 1, 1, 450, 0, 2)
    assert round(h.avg_response_time, 4) == 162.8333
    assert {(r.resource_type, r.n) for r in aggregates.resource_types(ten.where("session_id = 1")).collect()} == {("HTML", 8), ("JavaScript", 1)}
    assert sets.skippable(ten.where("session_id = 1")).count() == 8 and [r.url for r in sets.retryable(ten).collect()] == ["https://a.com/4"]


def test_duplicates_skip_redirects(spark):
    rows = [row("terms", 200, "Terms | X", "", 1, sid=9), row("mobile-terms", 200, "Terms | X", "", 1, sid=9), row("target", 200, "Only Here", "", 1, sid=9), row("redirect", 308, "Only Here", "", 1, sid=9)]
    assert {r.url for r in filtered(results(spark, rows), ResultsFilter(duplicateField="title")).collect()} == {"https://a.com/terms", "https://a.com/mobile-terms"}


def test_overflow_filters(spark):
    good = {"url": "good", "securityHeaders": {"hsts": True, "csp": True, "xFrameOptions": True}, "structuredDataTypes": ["Article"], "imagesMissingAlt": 0, "h1Count": 1}
    bad = {"url": "bad", "securityHeaders": {"hsts": False, "csp": False, "xFrameOptions": False}, "structuredDataTypes": [], "imagesMissingAlt": 3, "h1Count": 2}
    df = results(spark, [good, bad, {"url": "none"}])
    one = lambda **f: [r.url for r in filtered(df, ResultsFilter(**f)).collect()]
    assert one(securityMissing="hsts") == one(imagesMissingAlt=True) == one(h1State="multiple") == ["bad"] and one(structuredData="has") == ["good"] and one(structuredData="missing") == ["bad", "none"]


def test_security_coverage(spark):
    flags = lambda a, b, c: {"securityHeaders": {"hsts": a, "csp": b, "xFrameOptions": c}}
    df = results(spark, [{"url": "1"} | flags(True, True, True), {"url": "2"} | flags(False, False, False), {"url": "3"} | flags(True, False, True), {"url": "4"}])
    h = aggregates.health(df, spark.createDataFrame([], "session_id long, url string")).first()
    assert (h.sec_html, h.sec_missing_hsts, h.sec_missing_csp, h.sec_missing_xframe) == (3, 1, 2, 1)


def test_tokens():
    assert build_filter("Content", "word_count:gt:2000") == ResultsFilter(resourceType="HTML", wordCountMin=2001)
    assert build_filter("Page Titles", "title_len:lt:30") == ResultsFilter(resourceType="HTML", titleLengthMax=30) and build_filter("Response Codes", "4xx") == ResultsFilter(statusMin=400, statusMax=500)
    assert build_filter("Response Codes", "404") == ResultsFilter(statusMin=404, statusMax=405) and build_filter("External", "status:3xx") == ResultsFilter(statusMin=300, statusMax=400)
    assert build_filter("Images") == ResultsFilter(resourceType="HTML", hasOgImage=True) and build_filter("Images", "missing_og_image") == ResultsFilter(resourceType="HTML", missingOgImage=True)
    assert build_filter("Recrawl Queue", recrawl=("a",)) == ResultsFilter(urlIn=("a",), issuesOnly=True) and build_filter("Internal", "Images") == ResultsFilter(resourceType="Image")
    assert build_filter("Issues", "All", "  q ") == ResultsFilter(issuesOnly=True, text="q") and build_filter("H1", "duplicate:h1").duplicateField == "h1" and build_filter("H1", "duplicate:nope") == ResultsFilter(resourceType="HTML")
    for tab, tokens in filters.TAB_TOKENS.items():
        assert all(filters.token_fields(t, tab) is not None for t in tokens)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(x=st.integers(0, 900))
def test_ranges_partition(one, x):
    assert filtered(one, ResultsFilter(responseTimeMin=x)).count() + filtered(one, ResultsFilter(responseTimeMax=x)).count() == 9


def test_blanking(spark):
    full = {"title": "t", "h1": "h", "contentHash": "c", "wordCount": 3, "h1Count": 1, "structuredDataTypes": ["A"], "securityHeaders": {"hsts": True}, "redirectUrl": "r"}
    df = ingest.blank_non_content(results(spark, [full | {"url": "page"}, full | {"url": "moved", "status": 308}, full | {"url": "js", "resourceType": "JavaScript"}]))
    page, moved, js = df.orderBy("id").collect()
    assert page.title == "t" and page.seo.contentHash == "c" and page.seo.securityHeaders.hsts
    assert (moved.title, moved.seo.contentHash, moved.word_count, moved.seo.h1Count, moved.seo.structuredDataTypes, moved.seo.securityHeaders, moved.redirect_url, moved.status) == ("", "", 0, 0, [], None, "r", 308)
    assert js.seo.securityHeaders is None


def test_upsert_is_last_wins_and_idempotent(spark):
    df = lambda *rows: spark.createDataFrame(rows, "session_id long, url string, status long, seq long")
    stored = df((1, "a", 200, 1), (2, "a", 200, 2))
    batch = df((1, "a", 500, 3), (1, "a", 404, 4), (1, "b", 200, 5))
    once = ingest.upsert(stored, batch)
    key = lambda d: sorted((r.session_id, r.url, r.status) for r in d.collect())
    assert key(once) == [(1, "a", 404), (1, "b", 200), (2, "a", 200)] == key(ingest.upsert(once, batch))
    f = ingest.frontier(spark.createDataFrame([(1, "p"), (1, "a"), (1, "p"), (2, "p")], "session_id long, url string"), once)
    assert sorted((r.session_id, r.url) for r in f.collect()) == [(1, "p"), (2, "p")]


def test_coercion_defaults(spark):
    r = ingest.coerce(spark.createDataFrame([("x",)], "url string")).first()
    assert (r.url, r.title, r.status, r.error, r.is_noindex, r.seo.outlinks, r.seo.responseHeaders, r.seo.blockedByRobots, r.seo.crawlDepth) == ("x", "", 0, None, False, [], {}, False, 0)


def test_cells(spark):
    cases = {"=HYPERLINK(1)": "'=HYPERLINK(1)", "+1+1": "'+1+1", "@SUM(A1)": "'@SUM(A1)", "-2+3": "'-2+3", "-42": "-42", "-3.5e2": "-3.5e2", "Normal title": "Normal title", "": "", " a\n\t b ": "a b", "-inf": "-inf", "- 1": "'- 1"}
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.cell(F.col("c")).alias("v")).collect()}
    assert got == cases


def test_export(spark, tmp_path):
    rows = [
        {"url": "https://a.com/", "title": "Multi\nline", "canonical": "https://a.com", "outlinks": ["https://a.com/x", "https://b.com/y"], "responseHeaders": {"Server": "nginx", "X-A": "=1"}, "metaTags": [{"name": "", "property": "OG:image", "content": "1"}, {"name": "", "property": "og:image", "content": "2"}],
         "hreflang": [{"lang": "en", "href": "e"}, {"lang": "fr", "href": "f"}], "consoleErrors": ["boom"], "perf": {"ttfb": 5, "cls": 0.25}, "redirectChain": ["p", "q"]},
        {"url": "https://a.com/2", "responseHeaders": {"server": "apache"}, "error": "-oops"},
    ]
    df = results(spark, rows)
    found = export.discover_schema(df)
    assert found == export.ExportSchema(("server", "x-a"), ("og:image",), 2, 2)
    sizes = export.write_export(df, str(tmp_path / "out.csv"))
    assert set(sizes) == {"out.csv", "out_outlinks.csv", "out_failed_requests.csv", "out_console.csv"} == {p.name for p in tmp_path.iterdir()}
    raw = (tmp_path / "out.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    first, second = sorted(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"))), key=lambda r: r["url"])
    assert list(first) == found.columns() and len(export.CORE_COLUMNS) == 61
    assert (first["title"], first["title_length"], first["canonical_is_self"], first["header:server"], first["header:x-a"], first["meta:og:image"]) == ("Multi line", "10", "true", "nginx", "'=1", "1 | 2")
    assert (first["hreflang_2_url"], first["redirect_1"], first["perf_ttfb"], first["perf_cls"], first["outlink_count"]) == ("f", "p", "5", "0.25", "2")
    assert (second["header:server"], second["error"], second["meta:og:image"], second["perf_ttfb"]) == ("apache", "'-oops", "", "")
    links = list(csv.DictReader(io.StringIO((tmp_path / "out_outlinks.csv").read_text("utf-8-sig"))))
    assert {(r["target_url"], r["link_scope"]) for r in links} == {("https://a.com/x", "internal"), ("https://b.com/y", "external")}
    names = export.write_bundle(df, str(tmp_path / "b.zip"))
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert z.testzip() is None and len(names) == 4 and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    export.save_crawl(df, {"x": 1}, str(tmp_path / "c.json"))
    saved = json.loads((tmp_path / "c.json").read_text())
    assert saved["version"] == 2 and {r["url"] for r in saved["results"]} == {"https://a.com/", "https://a.com/2"}


def test_failed_export_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        export.write_export(results(spark, [{"url": "x"}]).withColumn("url", F.raise_error(F.lit("no"))), str(tmp_path / "out.csv"))
    assert list(tmp_path.iterdir()) == []


def test_grid_tabs(one):
    for tab in grid.TABS:
        assert grid.tab(one, tab, ("price",)).columns[-1] == "scraper_price_appears"
    assert grid.tab(one, "Unknown").columns == grid.tab(one, "Internal").columns
    got = {(r.section, r.name): r.value for r in grid.details(one.where("id = 6")).collect()}
    assert got[("URL Details", "Title")] == "Article" and got[("Scraper", "price")] == "$10" and got[("Directives", "Meta Robots")] == "(none)" and ("URL Details", "Error") not in got
