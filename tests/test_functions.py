"""Urls, robots, dates, pages, images and sources on tables of cases."""

import gzip
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spiderglass.functions import classify, html, robots, text, urls
from spiderglass.sources import readers

NORMAL = [
    ("https://Example.com/a?b=2&a=1#frag", "https://example.com/a?a=1&b=2"), ("https://example.com:443/", "https://example.com/"), ("http://example.com:80/x", "http://example.com/x"), ("https://example.com/?utm_source=x&UTM_Medium=y&id=5", "https://example.com/?id=5"),
    ("https://example.com/?gclid=1", "https://example.com/"), ("https://example.com/Page", "https://example.com/Page"), ("https://example.com", "https://example.com/"), ("not a url", "not a url"), ("https://example.com/a/../b/./c", "https://example.com/b/c"), ("https://example.com/?q=a b", "https://example.com/?q=a+b"),
]


@pytest.mark.parametrize("raw,want", NORMAL)
def test_normalize(raw, want):
    assert urls.normalize_one(raw) == want == urls.normalize_one(want)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/.?=&#%:@ é", max_size=30))
def test_normalize_settles(tail):
    once = urls.normalize_one("https://h.example/" + tail)
    assert urls.normalize_one(once) == once


def test_native_urls(spark):
    cases = [c for c in NORMAL if ".." not in c[0] and " " not in c[0]]
    got = [r.u for r in spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, url string").orderBy("i").select(urls.normalize(F.col("url")).alias("u")).collect()]
    assert got == [c[1] for c in cases]
    df = spark.createDataFrame([("http://U@H.com:8/p?q#f", "https://www.a.com"), ("nope", "x")], "a string, b string")
    rows = df.select(urls.host_of(F.col("a")).alias("h"), urls.authority(F.col("a")).alias("o"), urls.scope_base(F.col("b")).alias("s"), urls.in_scope(F.lit("it.a.com"), urls.scope_base(F.col("b")), F.lit("")).alias("i"), robots.path_of(F.col("a")).alias("p"), urls.ensure_protocol(F.col("a")).alias("e")).collect()
    assert tuple(rows[0]) == ("h.com", "U@H.com:8", "a.com", True, "/p?q", "http://U@H.com:8/p?q#f") and rows[1].h == "" and rows[1].o == "nope" and rows[1].e == "https://nope"


MATCH = [("/a", "/abc", True), ("/a$", "/a", True), ("/a$", "/ab", False), ("/*.php$", "/x/y.php", True), ("/*.php$", "/x.php5", False), ("/*.php", "/x.php5", True), ("*", "/x", True), ("/a*b*c", "/a1b2c3", True), ("/a*b*c$", "/a1b2c3", False), ("/", "/", True), ("/a*a*a*a*a*$", "/" + "a" * 200, True), ("/x.y", "/xzy", False)]


def test_robots(spark):
    assert [robots.matches(p, path) for p, path, _ in MATCH] == [w for *_, w in MATCH]
    df = spark.createDataFrame([(p, path, w) for p, path, w in MATCH], "p string, path string, w boolean")
    assert df.where(robots.matched(F.col("p"), F.col("path")) != F.col("w")).count() == 0
    body = "User-agent: A\nUser-agent: MyBot\nDisallow: /x # c\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\nSitemap: https://s/1.xml"
    rules, maps = robots.parse(body, "MyBot/2.0")
    assert rules == [(False, "/x"), (True, "/x/y")] and maps == ["https://s/1.xml"] and robots.parse(body, "zzz")[0] == [(False, "/")] and robots.parse("Disallow: /", "b") == ([], [])
    assert robots.allowed("/x/y/z", rules) and not robots.allowed("/x/z", rules) and robots.allowed("/q", rules) and robots.allowed("/p", [(False, "/p"), (True, "/p")])


def test_dates(spark):
    cases = {"2024-06-15T10:30:00Z": ("15-06-2024", "10:30:00 UTC"), "2023-12-25": ("25-12-2023", "00:00:00 UTC"), "2024-01-10T01:00:00+02:00": ("09-01-2024", "23:00:00 UTC"), "Wed, 21 Oct 2015 07:28:00 GMT": ("21-10-2015", "07:28:00 UTC"), "junk": ("", ""), "": ("", "")}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    date, time = text.standardize_date(F.col("c"))
    assert {r.c: (r.d, r.t) for r in df.select("c", date.alias("d"), time.alias("t")).collect()} == cases


def test_status_labels(spark):
    cases = [(200, None, "OK"), (301, None, "Moved Permanently"), (418, None, "Client Error"), (0, "host_blocked_by_detector:x", "Parked"), (0, "net::ERR_NAME_NOT_RESOLVED", "DNS failed"), (0, "x" * 50, "x" * 38 + "…"), (0, None, ""), (307, None, "Redirect")]
    df = spark.createDataFrame([(s, e, w) for s, e, w in cases], "s int, e string, w string")
    assert df.where(classify.status_text(F.col("s"), F.col("e")) != F.col("w")).count() == 0


PAGE = """<!doctype html><html><head><title> T </title><meta name="description" content=" D "><link rel="canonical" href="/c"><meta property="article:published_time" content="2024-06-15T10:30:00Z"><meta http-equiv="refresh" content="5">
<link rel="alternate" hreflang="en" href="/en"><script type="application/ld+json">{"@graph":[{"@type":["A","B"]},{"@type":"A","dateModified":"2024-01-10"}]}</script><script type="application/ld+json">{bad</script></head>
<body><h1>Head <b>line</b></h1><h2>Sub</h2><h2>Two</h2><p>one two<br>three</p><script>var x = 1</script><a href="/about">a</a><a href="/about#x">b</a><a href="https://other.com/">c</a><a href="https://sub.site.com/">d</a>
<img src="/i.png"><img src="j.png" alt=""><div class="price main"><span>$29.99</span></div><span data-testid="sku">SKU-1</span></body></html>"""


def test_page_facts():
    f = html.facts(PAGE, "https://site.com/dir/", None, {n: html.compile_selector(s) for n, s in {"price": "div.price > span", "sku": '[data-testid="sku"]', "none": "#x, .y", "second": "h2:nth-child(3)"}.items()})
    assert (f["title"], f["h1"], f["h2"], f["h1Count"], f["h2Count"], f["metaDescription"], f["canonical"]) == ("T", "Head line", "Sub", 1, 2, "D", "/c")
    assert (f["internalLinks"], f["externalLinks"], f["outlinks"]) == (2, 2, ["https://site.com/about", "https://other.com/", "https://sub.site.com/"])
    assert (f["imageCount"], f["imagesMissingAlt"], f["missingAltImages"], f["structuredDataTypes"], f["publishedRaw"], f["modifiedRaw"]) == (2, 1, ["https://site.com/i.png"], ["A", "B"], "2024-06-15T10:30:00Z", "2024-01-10")
    assert {k: v["value"] for k, v in f["scraper"].items()} == {"price": "$29.99", "sku": "SKU-1", "none": "", "second": "Two"} and not f["scraper"]["none"]["appears"]
    assert html.facts(PAGE, "https://site.com/", "site.com")["internalLinks"] == 3 and f["wordCount"] == 10 and len(f["metaTags"]) == 3
    assert html.facts("", "x")["contentHash"] == "" and html.words_and_hash(" a  b\n") == html.words_and_hash("a b ") != html.words_and_hash("a b")
    with pytest.raises(ValueError):
        html.compile_selector("a:hover!")


def test_fnv():
    assert html.words_and_hash("a") == (1, "e40c292c") and html.words_and_hash("foobar")[1] == "bf9cf968"


def test_dimensions():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 9
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [html.dimensions(x) for x in (png, gif, jpg, webp, b"", b"junk" * 10)] == [(640, 480), (7, 9), (40, 30), (100, 50), (0, 0), (0, 0)]


def test_sitemaps(spark):
    files = [("i", b"<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc> b </loc></sitemap><loc>i</loc></sitemapindex>"), ("a", b"<urlset><loc>https://x/?a=1&amp;b=2</loc></urlset>"), ("b", gzip.compress(b"<urlset><LOC lang='x'>https://y/</LOC><loc></loc></urlset>")), ("c", b"<loc>unseen</loc>")]
    df = spark.createDataFrame(files, "url string, content binary")
    assert {r.url for r in readers.sitemap_urls(df, "i").collect()} == {"https://x/?a=1&b=2", "https://y/"} and readers.sitemap_urls(df, "zz").count() == 0


def test_sitemaps_without_limits(spark, tmp_path):
    from spiderglass.catalog import QUERIES

    spark.range(50_500).select(F.col("id").alias("page_id"), F.concat(F.lit("https://x.example/?a=1&lt;&b=<"), "id").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["source_sitemap_xml"](spark, str(tmp_path))
    assert got.count() == 50_500 and got.exceptAll(spark.read.parquet(f"{tmp_path}/pages.parquet").select("url")).isEmpty()


def test_sitemaps_are_capped_in_all(spark):
    index = lambda *names: f"<sitemapindex>{''.join(f'<sitemap><loc>{n}</loc></sitemap>' for n in names)}</sitemapindex>"
    files = {"i": index("a", "b"), "a": index("c", "d"), "b": index("e")} | {k: f"<urlset><url><loc>https://{k}/</loc></url></urlset>" for k in "cde"}
    df = spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "url string, content binary")
    assert {r.url for r in readers.sitemap_urls(df, "i", max_sitemaps=4).collect()} == {"https://c/"}
    assert readers.sitemap_urls(df, "i", max_sitemaps=3).count() == 0 and readers.sitemap_urls(df, "i").count() == 3


def test_lists_and_relays(spark, tmp_path):
    (tmp_path / "urls.csv").write_text("https://a/,x\n # no\nftp://b\n http://c \n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "urls.csv")).collect()] == ["https://a/", "http://c"]
    config = "QUJD" * 30
    (tmp_path / "relays").write_text(f"*vpn\n#HostName,IP,Score,Ping,Speed,CountryLong,CountryShort,NumVpnSessions,Conf\nh1,1.1.1.1,5,x,12345678,Japan,JP,3,{config}\nh2,2.2.2.2,5,1,1,J,J,3,short\n*\n")
    r = readers.relay_csv(spark, str(tmp_path / "relays")).collect()
    assert [tuple(x)[:8] for x in r] == [("h1", "1.1.1.1", 5, 0, 12.3, "Japan", "JP", 3)]


def test_redirects_and_sizes(spark):
    hops = [("a", 301, {"server": "x"}), ("b", 302, {}), ("c", 200, {})]
    df = spark.createDataFrame([(hops, {"content-length": "12"}, "abc"), (hops[2:], {}, "abé")], "hops array<struct<url:string,status:int,headers:map<string,string>>>, headers map<string,string>, body string")
    one, two = df.select(html.redirect_info(F.col("hops")).alias("r"), html.size_of(F.col("headers"), F.col("body")).alias("size")).collect()
    assert (one.r.redirectChain, one.r.redirectUrl, one.r.status, one.r.headers, one.size) == (["a", "b", "c"], "c", 301, {"server": "x"}, 12) and (two.r.redirectChain, two.r.redirectUrl, two.size) == ([], "", 4)


def glob_brute(pattern, path):
    exact, body = pattern.endswith("$"), pattern.removesuffix("$")
    reach = {0}
    for c in body:
        reach = set(range(min(reach), len(path) + 1)) if c == "*" and reach else {i + 1 for i in reach if i < len(path) and path[i] == c}
    return len(path) in reach if exact else bool(reach)


def test_robots_patterns_like_brute_force(spark):
    import random

    rng = random.Random(6)
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=rng.randint(0, n)))
    cases = [("/" + pick("ab**$\\E(.é", 7) + rng.choice(["", "$"]), "/" + pick("aab\\E(.é$", 9)) for _ in range(1500)]
    cases += [("$", "/"), ("$", ""), ("", "/x"), ("*", ""), ("**", "/"), ("*$", "/a"), ("/a\\E(", "/a\\E(b"), ("/[a-z]+", "/[a-z]+x"), ("/" + "a*" * 50 + "Z", "/" + "a" * 2000), ("/" + "*a" * 50 + "$", "/" + "ba" * 1000), ("/a$$", "/a$")]
    df = spark.createDataFrame(cases, "p string, path string")
    got = {(r.p, r.path): r.m for r in df.select("p", "path", robots.matched(F.col("p"), F.col("path")).alias("m")).collect()}
    for p, path in cases:
        assert got[p, path] == glob_brute(p, path) == robots.matches(p, path), (p, path)


def test_robots_verdicts_over_many_rules(spark):
    import random

    rng = random.Random(3)
    piece = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    rules = [("https://big.example", rng.random() < 0.5, "/" + "/".join(piece() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "*", "*b", "$", "/*c$"])) for _ in range(10_000)]
    rules += [("https://odd.example", False, "/a\\E("), ("https://odd.example", False, "/*a*a*a*a*b"), ("https://tie.example", False, "/p"), ("https://tie.example", True, "/p"), ("https://tie.example", False, "$")]
    paths = ["/" + "/".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(400)]
    urls = sorted({("https://big.example" + p, "https://big.example") for p in paths} | {(o + p, o) for o in ("https://odd.example", "https://tie.example", "https://none.example") for p in ("/a\\E(x", "/" + "a" * 300, "/p/q", "")})
    df = spark.createDataFrame(urls, "url string, origin string")
    got = {r.url: r.allowed for r in robots.verdicts(df, spark.createDataFrame(rules, "origin string, allow boolean, pattern string")).collect()}
    for url, origin in urls:
        path = url[len(origin) :] or "/"
        assert got[url] == robots.allowed(path, [(a, p) for o, a, p in rules if o == origin]), url
    assert len(got) == len(urls) and robots.verdicts(df, spark.createDataFrame([], "origin string, allow boolean, pattern string")).where("allowed").count() == len(urls)


def test_content_hash(spark):
    def fold(body):
        h, before = 2166136261, True
        units = body.encode("utf-16-be", "surrogatepass")
        for i in range(0, len(units), 2):
            c = units[i] << 8 | units[i + 1]
            blank = c in (32, 9, 10, 11, 12, 13, 160)
            if not (blank and before):
                h = (h ^ (32 if blank else c)) * 16777619 & 0xFFFFFFFF
            before = blank
        return f"{h:x}"

    texts = ["", "  \n\xa0", "a", " a  b\t\xa0c ", "abc", "abc ", "éü", "😀", "a😀b 😁\U0010ffff", "a b", "x" * 5000, "word " * 3000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", text.content_hash(F.col("t")).alias("h"), text.word_count(F.col("t")).alias("n")).collect()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0d\xa0]+", r.t or "")
        assert (r.n, r.h) == (len(words), fold(r.t) if words else ""), r.t


def test_redirect_chains(spark):
    from spiderglass.operators import redirects

    rows = [(1, i, f"c{i:04}", f"c{i + 1:04}", 301) for i in range(1000)]  # a chain of a thousand
    rows += [(1, 0, "a", "b", 302), (1, 1, "b", "c", 301), (1, 2, "c", "b", 301), (1, 3, "t", "c", 307), (1, 4, "self", "self", 301), (1, 5, "x", "old", 301), (1, 6, "x", "y", 308), (1, 7, None, "q", 301), (1, 8, "q", None, 301)]
    rows += [(2, i, f"m{i}", "hub", 301) for i in range(50)] + [(2, 99, "hub", "end", 302), (2, 100, "p", "q", 301), (2, 101, "q", "r", 301), (2, 102, "r", "p", 301)]
    df = spark.createDataFrame(rows, "session_id long, seq long, from_url string, to_url string, status long")
    got = {(r.session_id, r.start_url): (r.chain, r.hops, r.first_status, r.final_url, r.is_loop) for r in redirects.chains(df).collect()}
    want = {(1, "c0000"): ([f"c{i:04}" for i in range(1001)], 1000, 301, "c1000", False), (1, "a"): (["a", "b", "c"], 3, 302, "b", True), (1, "t"): (["t", "c", "b"], 3, 307, "c", True), (1, "b"): (["b", "c"], 2, 301, "b", True)}
    want |= {(1, "self"): (["self"], 1, 301, "self", True), (1, "x"): (["x", "y"], 1, 308, "y", False), (2, "p"): (["p", "q", "r"], 3, 301, "p", True)}
    want |= {(2, f"m{i}"): ([f"m{i}", "hub", "end"], 2, 301, "end", False) for i in range(50)}
    assert got == want and redirects.chains(df.where("false")).count() == 0
