"""Sources: event lines, url lists, sitemaps, robots files, relay lists, saved crawls."""

from __future__ import annotations

import gzip
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import robots as rules
from ..operators.graph import _keep

MAX_SITEMAPS, MAX_DEPTH, MAX_URLS = 50, 3, 50_000
MAX_BYTES, MAX_TEXT = 30 << 20, 60 << 20


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(value): each line that is not blank, parsed as an event; a null record marks what is no JSON object."""
    parsed = F.from_json("value", schema.EVENT, {"mode": "PERMISSIVE"})
    json = F.trim("value").startswith("{") & F.trim("value").endswith("}") & F.get_json_object("value", "$").isNotNull()
    return lines.where(F.trim("value") != "").select(*keep, "value", F.when(json, parsed).alias("record"))


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def listed_urls(lines: DataFrame) -> DataFrame:
    """(value): one url a line, or the first field of a CSV line."""
    return lines.select(F.trim(F.split("value", ",")[0]).alias("url")).where(F.col("url").startswith("http"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return listed_urls(spark.read.text(path))


def excluded_urls(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("url")).where(F.col("url").startswith("http"))


def exclude_list(spark: SparkSession, path: str) -> DataFrame:
    return excluded_urls(spark.read.text(path))


def _replaced(old: str, new: str):
    return lambda x: F.replace(x, F.lit(old), F.lit(new))


def locs(xml):
    """The urls of a sitemap's loc elements, entities decoded."""
    found = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc[^>]*>(.*?)</loc>"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    # &amp; comes last, for what it leaves is text.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = F.transform(found, _replaced(entity, char))
    return found


def is_index(xml):
    return xml.rlike(r"(?i)<sitemapindex\b")


@F.pandas_udf(T.StringType())
def sitemap_text(content: pd.Series) -> pd.Series:
    """A sitemap's text; gzip is told by its first bytes, and inflated up to a limit."""

    def one(raw):
        if raw is None or len(raw) > MAX_BYTES:
            return None
        if raw[:2] == b"\x1f\x8b":
            try:
                with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
                    raw = f.read(MAX_TEXT + 1)
            except (OSError, EOFError):
                return None
            if len(raw) > MAX_TEXT:
                return None
        return bytes(raw).decode("utf-8", "replace")

    return content.map(one)


def sitemap_urls(files: DataFrame, seed: str, max_sitemaps: int | None = MAX_SITEMAPS, max_depth: int = MAX_DEPTH, max_urls: int | None = MAX_URLS) -> DataFrame:
    """(url): what a sitemap lists, following indexes level by level; max_sitemaps files in all, the seed included.
    The limits are the crawler's; None is no limit. files: (url, content), as fetched."""
    spark = files.sparkSession
    texts = files.select(F.col("url").alias("sitemap"), sitemap_text("content").alias("xml")).where("xml is not null")
    level = spark.createDataFrame([(seed,)], "sitemap string")
    visited, leaves, left = level, None, None if max_sitemaps is None else max_sitemaps - 1
    for _ in range(max_depth + 1):
        here = texts.join(level, "sitemap", "left_semi")
        found = here.where(~is_index(F.col("xml"))).select(F.explode(locs(F.col("xml"))).alias("url"))
        leaves = found if leaves is None else leaves.union(found)
        children = here.where(is_index(F.col("xml"))).select(F.explode(locs(F.col("xml"))).alias("sitemap")).distinct().join(visited, "sitemap", "left_anti")
        if left is None:
            level = _keep(children, "sitemaps")
            if level.isEmpty():
                break
        else:
            # The list of sitemaps is capped, so it may come to the driver and cut the plan.
            rows = children.orderBy("sitemap").limit(max(left, 0)).collect()
            if not rows:
                break
            left -= len(rows)
            level = spark.createDataFrame(rows, "sitemap string")
        visited = visited.union(level)
    urls = leaves.distinct()
    return urls if max_urls is None else urls.limit(max_urls)


def robots(files: DataFrame, user_agent: str) -> DataFrame:
    """(origin, allow, pattern): the rules for an agent of each robots.txt (origin, status, body); no rules: all is allowed."""
    parsed = rules.robots_rules(user_agent)(F.when(F.col("status").between(200, 299), F.substring("body", 1, 512 * 1024)).otherwise(""))
    return files.select("origin", F.explode(parsed).alias("r")).select("origin", "r.allow", "r.pattern")


def relay_csv(spark: SparkSession, path: str) -> DataFrame:
    return relays(spark.read.text(path))


def relays(lines: DataFrame) -> DataFrame:
    """(value): a relay list: * and # lines mark, fields are unquoted; the first two and the last are anchored."""
    spark = lines.sparkSession
    header = lines.where(F.col("value").startswith("#")).limit(1).collect()
    if not header:
        return spark.createDataFrame([], "host_name string, ip string, score long, ping long, speed_mbps double, country_long string, country_short string, sessions long, config string")
    names = [h.strip() for h in header[0].value.lstrip("#").rstrip("\r").split(",")]
    f = F.split(F.regexp_replace("value", "\r$", ""), ",")
    at = lambda n: F.get(f, F.lit(names.index(n))) if n in names else F.lit(None).cast("string")
    num = lambda n: F.coalesce(F.regexp_extract(F.coalesce(at(n), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    config = F.trim(F.element_at(f, -1))
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("*") & (F.trim("value") != "") & (F.size(f) >= 6) & (F.length(config) >= 100) & config.rlike(r"^[A-Za-z0-9+/=]+$"))
    return rows.select(
        F.trim(F.get(f, F.lit(0))).alias("host_name"), F.trim(F.get(f, F.lit(1))).alias("ip"), num("Score").alias("score"), num("Ping").alias("ping"), (F.floor(num("Speed") / 1e6 * 10 + 0.5) / 10).alias("speed_mbps"),
        F.trim(F.coalesce(at("CountryLong"), F.lit(""))).alias("country_long"), F.trim(F.coalesce(at("CountryShort"), F.lit(""))).alias("country_short"), num("NumVpnSessions").alias("sessions"), config.alias("config"),
    )


def saved_crawl(spark: SparkSession, path: str, by_line: bool = False) -> tuple[dict, DataFrame]:
    """The configuration of a saved crawl and its results. (Opening one restores the configuration only.) A file is a
    document; by_line: each of its lines is one, as a large crawl is saved in parts."""
    import json

    whole = spark.read.option("multiLine", not by_line).json(path)
    config = whole.select(F.to_json("config").alias("c")).first()
    return json.loads(config.c or "{}") if config else {}, whole.select(F.explode("results").alias("r")).select("r.*")


def scan_session(results: DataFrame, session_id: int) -> DataFrame:
    return results.where(F.col("session_id") == session_id).orderBy("id")


def files_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
