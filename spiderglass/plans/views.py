"""The crawl model over the driver's tables, by formulas that Spark and DuckDB share.

`events` is the crawl log: each event is a fetched url of one of three sessions. Columns are SQL text;
where the dialects differ, both forms stand side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import blank_non_content, last_wins

_BASE = {
    "spark": "SELECT event_id AS e, user_id AS u, event_type AS kind, value, ts, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "duckdb": "SELECT event_id AS e, user_id AS u, event_type AS kind, value, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
_URL = "'https://h' || CAST(u % 20 AS STRING) || '.example.com/p' || CAST(k AS STRING) || CASE WHEN k % 7 = 0 THEN '?utm_source=x&b=2&a=1' ELSE '' END"
_TYPED = f"""SELECT *, {_URL} AS url, 1 + u % 3 AS session_id,
  CASE WHEN u % 5 = 0 THEN 'JavaScript' WHEN u % 5 = 1 AND k % 9 = 0 THEN 'Image' WHEN u % 13 = 0 THEN '' ELSE 'HTML' END AS resource_type,
  CASE kind WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 301 ELSE 302 END WHEN 'signup' THEN CASE k % 8 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN 403 ELSE 404 END
    WHEN 'error' THEN 0 ELSE CASE WHEN k % 17 = 0 THEN 204 ELSE 200 END END AS status FROM base"""

#: Columns that read alike in both dialects.
_SHARED = {
    "id": "e", "session_id": "session_id", "url": "url", "status": "CAST(status AS BIGINT)",
    "title": "CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN NULL WHEN k % 10 = 2 THEN ' Shared title ' ELSE 'Title ' || CAST(k % 40 AS STRING) || repeat(' word', CAST(k % 15 AS INT)) END",
    "h1": "CASE WHEN k % 12 = 0 THEN '' ELSE 'Heading ' || CAST(k % 25 AS STRING) || repeat('h', CAST(k AS INT)) END",
    "h2": "CASE WHEN k % 9 = 0 THEN '' ELSE 'Sub ' || CAST(k % 9 AS STRING) END",
    "meta_description": "CASE WHEN k % 6 = 0 THEN '' ELSE repeat('d', CAST((k * 3) % 200 AS INT)) || CAST(k % 30 AS STRING) END",
    "canonical": "CASE k % 4 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN url || '/' ELSE 'https://c.example.com/' || CAST(k AS STRING) END",
    "internal_links": "k % 30", "external_links": "k % 7", "response_time": "CAST(floor(value * 10) AS BIGINT)",
    "content_type": "CASE resource_type WHEN 'JavaScript' THEN 'application/javascript' WHEN 'Image' THEN 'image/png' WHEN '' THEN '' ELSE 'text/html; charset=utf-8' END",
    "resource_type": "resource_type", "size": "(k * 1000 + e % 977) * (1 + (u % 4) * 500)",
    "error": "CASE WHEN kind = 'error' THEN CASE k % 4 WHEN 0 THEN 'host_blocked_by_detector:h' || CAST(u % 20 AS STRING) || '.example.com' WHEN 1 THEN 'Timeout 30000ms exceeded' WHEN 2 THEN 'net::ERR_CONNECTION_RESET' ELSE 'some rather long failure text that goes on beyond forty characters' END WHEN k % 31 = 0 THEN '' END",
    "word_count": "(k * 37) % 2500",
    "meta_robots": "CASE k % 6 WHEN 0 THEN 'noindex, nofollow' WHEN 1 THEN 'Max-Snippet:-1, max-image-preview:large' WHEN 2 THEN 'none' WHEN 3 THEN 'index; follow, noarchive' ELSE '' END",
    "is_indexable": "NOT (k % 6 IN (0, 2) OR k % 11 = 0)", "is_noindex": "k % 6 IN (0, 2) OR k % 11 = 0", "is_nofollow": "k % 6 IN (0, 2)",
    "og_title": "CASE WHEN k % 3 = 0 THEN 'og ' || CAST(k AS STRING) ELSE '' END", "og_description": "''",
    "og_image": "CASE WHEN k % 4 = 1 THEN 'https://img.example.com/' || CAST(k AS STRING) || '.png' ELSE '' END",
    "og_image_width": "CASE WHEN k % 4 = 1 THEN 1200 ELSE 0 END", "og_image_height": "CASE WHEN k % 8 = 1 THEN 630 ELSE 0 END",
    "date_published": "CASE WHEN k % 5 = 0 THEN '15-06-2024' ELSE '' END", "date_modified": "''",
    "redirect_url": "CASE WHEN kind = 'click' THEN url || '/new' ELSE '' END", "server_header": "CASE WHEN k % 2 = 1 THEN 'nginx' ELSE '' END",
}
#: Overflow fields, as flat columns seo_<key>.
_OVERFLOW = {
    "metaGooglebot": "CASE k % 11 WHEN 0 THEN 'noindex' WHEN 1 THEN 'max-video-preview: 10' ELSE '' END", "xRobotsTag": "CASE k % 13 WHEN 0 THEN 'noai, noimageai' WHEN 1 THEN 'googlebot: nofollow' ELSE '' END",
    "ogType": "CASE WHEN k % 3 = 0 THEN 'article' ELSE '' END", "ogUrl": "''", "datePublishedTime": "CASE WHEN k % 5 = 0 THEN '10:30:00 UTC' ELSE '' END", "dateModifiedTime": "''",
    "contentHash": "CASE WHEN k % 9 = 0 THEN '' ELSE 'h' || CAST(k % 33 AS STRING) END", "ogImageWidthReal": "(k % 5) * 100", "ogImageHeightReal": "(k % 3) * 100", "ogImageFileSize": "k * 11",
    "h1Count": "k % 4", "h2Count": "k % 6", "imageCount": "k % 8", "imagesMissingAlt": "CASE WHEN k % 8 > 3 THEN k % 3 ELSE 0 END", "crawlDepth": "k % 6", "inSitemap": "k % 2 = 0", "blockedByRobots": "k % 19 = 0",
    "hsts": "CASE WHEN u % 7 = 3 THEN NULL ELSE k % 2 = 0 END", "csp": "CASE WHEN u % 7 = 3 THEN NULL ELSE k % 3 = 0 END", "xFrameOptions": "CASE WHEN u % 7 = 3 THEN NULL ELSE k % 5 < 3 END",
    "ttfb": "k * 7", "cls": "CAST(k AS DOUBLE) / 300",
}
_NUMBERED = {
    "spark": lambda n, item: f"CASE WHEN {n} > 0 THEN transform(sequence(1L, {n}), i -> {item}) ELSE CAST(array() AS ARRAY<STRING>) END",
    "duckdb": lambda n, item: f"list_transform(range(1, ({n}) + 1), lambda i: {item})",
}
_ARRAYS = {
    "outlinks": ("k % 6", "'https://h' || CAST((u + i) % 20 AS STRING) || '.example.com/p' || CAST((k * 3 + i) % 100 AS STRING)"),
    "redirectChain": ("CASE WHEN kind = 'click' AND k % 3 > 0 THEN k % 3 ELSE 0 END", "url || repeat('/r', CAST(i - 1 AS INT))"),
    "structuredDataTypes": ("k % 3", "CASE (k + i) % 4 WHEN 0 THEN 'Article' WHEN 1 THEN 'WebPage' WHEN 2 THEN 'Product' ELSE 'Event' END"),
    "jsErrors": ("CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END", "'TypeError ' || CAST(k AS STRING)"), "consoleErrors": ("CASE WHEN k % 10 = 4 THEN 2 ELSE 0 END", "'warn ' || CAST(i AS STRING)"),
    "failedRequests": ("CASE WHEN k % 10 = 5 THEN 2 ELSE 0 END", "'https://cdn.example.com/' || CAST(k + i AS STRING) || '.js'"),
    "missingAltImages": ("CASE WHEN k % 8 > 3 THEN k % 3 ELSE 0 END", "'/img/' || CAST(k + i AS STRING)"), "hreflangLangs": ("CASE WHEN k % 7 = 2 THEN 2 ELSE 0 END", "CASE i WHEN 1 THEN 'en' ELSE 'fr' END"),
}

_BLANK_STRINGS = ["title", "h1", "h2", "meta_description", "canonical", "seo_contentHash"]
_BLANK_NUMBERS = ["word_count", "seo_h1Count", "seo_h2Count", "seo_imagesMissingAlt"]
_BLANK_LISTS = ["seo_structuredDataTypes", "seo_missingAltImages", "seo_hreflangLangs"]
_BLANK_NULLS = ["seo_hsts", "seo_csp", "seo_xFrameOptions"]


def _flat(dialect: str) -> str:
    columns = [*_SHARED.items(), *[(f"seo_{k}", v) for k, v in _OVERFLOW.items()]]
    number = _NUMBERED[dialect]
    columns += [(f"seo_{k}", number(f"CAST({n} AS BIGINT)", item)) for k, (n, item) in _ARRAYS.items()]
    return f"WITH base AS ({_BASE[dialect]}), typed AS ({_TYPED}) SELECT {', '.join(f'{v} AS {k}' for k, v in columns)}, ts, u, k FROM typed"


def _duckdb_blank() -> str:
    keep = "resource_type = 'HTML' AND status >= 200 AND status < 300"
    put = [f"CASE WHEN {keep} THEN {c} ELSE '' END AS {c}" for c in _BLANK_STRINGS] + [f"CASE WHEN {keep} THEN {c} ELSE 0 END AS {c}" for c in _BLANK_NUMBERS]
    put += [f"CASE WHEN {keep} THEN {c} ELSE [] END AS {c}" for c in _BLANK_LISTS] + [f"CASE WHEN {keep} THEN {c} END AS {c}" for c in _BLANK_NULLS]
    return f"SELECT * REPLACE ({', '.join(put)}) FROM raw_log"


#: DuckDB: raw_log (all fetches), log (blanked), crawl (the last fetch of each session and url), page (CONTENT_PAGE rows of crawl).
CRAWL_SQL = f"""raw_log AS ({_flat("duckdb")}), log AS ({_duckdb_blank()}),
crawl AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY session_id, url ORDER BY id DESC) = 1),
page AS (SELECT * FROM crawl WHERE resource_type = 'HTML' AND status >= 200 AND status < 300)"""
#: Links that were seen; frontier: seen, not yet crawled in the session.
FRONTIER_SQL = "seen AS (SELECT DISTINCT session_id, unnest(seo_outlinks) AS url FROM raw_log), frontier AS (SELECT * FROM seen WHERE NOT EXISTS (SELECT 1 FROM crawl c WHERE c.session_id = seen.session_id AND c.url = seen.url))"
SESSION_SQL = """sessions AS (SELECT o_orderkey AS id, 'https://h' || (o_custkey % 20)::VARCHAR || '.example.com/p1' AS start_url, o_orderdate AS started_at,
  CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
  CASE o_orderkey % 3 WHEN 0 THEN '{"inputs":{"urls":["a","b","c"]}}' WHEN 1 THEN '{"urls":["a"]}' ELSE '{}' END AS config_json FROM orders)"""


def with_crawl(sql: str, *more: str) -> str:
    return f"WITH {', '.join([CRAWL_SQL, *more])} {sql}"


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fetches in the result schema, as they came."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    flat = spark.sql(_flat("spark").replace("FROM events", "FROM {events}"), events=events)
    s = lambda k: F.col(f"seo_{k}")
    longs = {"ogImageWidthReal", "ogImageHeightReal", "ogImageFileSize", "h1Count", "h2Count", "imageCount", "imagesMissingAlt", "crawlDepth"}
    fields = [(s(k).cast("long") if k in longs else s(k)).alias(k) for k in _OVERFLOW if k not in ("hsts", "csp", "xFrameOptions", "ttfb", "cls")]
    fields += [s(k).alias(k) for k in _ARRAYS if k != "hreflangLangs"]
    n, text = F.lit(None).cast("long"), lambda x: x.cast("string")
    security = F.struct(s("hsts").alias("hsts"), s("csp").alias("csp"), s("xFrameOptions").alias("xFrameOptions"), *[F.lit(None).cast("boolean").alias(k) for k in ("xContentTypeOptions", "referrerPolicy", "permissionsPolicy")])
    fields += [
        F.array(F.struct(F.lit("robots").alias("name"), F.lit("").alias("property"), F.col("meta_robots").alias("content")), F.struct(F.lit("").alias("name"), F.lit("OG:Title").alias("property"), F.col("og_title").alias("content"))).alias("metaTags"),
        F.transform(s("hreflangLangs"), lambda x: F.struct(x.alias("lang"), F.concat(F.col("url"), F.lit("?l="), x).alias("href"))).alias("hreflang"),
        F.create_map(F.lit("Server"), F.col("server_header"), F.lit("X-Num"), text(F.col("k"))).alias("responseHeaders"), F.create_map().cast("map<string,string>").alias("redirectHeaders"),
        F.when(F.col("k") % 3 > 0, F.create_map(F.lit("price"), F.struct(F.when(F.col("k") % 3 == 1, F.concat(F.lit("$"), text(F.col("k")))).otherwise("").alias("value"), (F.col("k") % 3 == 1).alias("appears")))).otherwise(F.create_map().cast("map<string,struct<value:string,appears:boolean>>")).alias("scraper"),
        F.when(s("hsts").isNotNull(), security).alias("securityHeaders"),
        F.struct(s("ttfb").alias("ttfb"), n.alias("domContentLoaded"), n.alias("loadTime"), n.alias("fcp"), n.alias("lcp"), s("cls").alias("cls")).alias("perf"),
    ]
    casts = {"og_image_width": "long", "og_image_height": "long"}
    return flat.select(*[F.col(c).cast(casts[c]) if c in casts else F.col(c) for c in _SHARED], F.struct(*fields).alias("seo"), "ts", "u", "k")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank_non_content(raw_log(spark, sf_dir))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored results: blanked, last fetch of each session and url."""
    return last_wins(log(spark, sf_dir), order="id")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log(spark, sf_dir).select("session_id", F.explode("seo.outlinks").alias("url")).distinct()


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    config = F.when(F.col("o_orderkey") % 3 == 0, '{"inputs":{"urls":["a","b","c"]}}').when(F.col("o_orderkey") % 3 == 1, '{"urls":["a"]}').otherwise("{}")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://h"), (F.col("o_custkey") % 20).cast("string"), F.lit(".example.com/p1")).alias("start_url"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderkey") % 4 != 1, F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("completed_at"), config.alias("config_json"),
    )
