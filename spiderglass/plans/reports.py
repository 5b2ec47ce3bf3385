"""The report kinds: one DataFrame each, composed of operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, urls
from ..operators import aggregates, graph
from ..operators.filters import text_of
from ..operators.ingest import content_page


def redirects(results: DataFrame) -> DataFrame:
    rows = results.where("status >= 300 AND status < 400")
    return rows.select("session_id", "url", "status", classify.redirect_hops(F.col("seo.redirectChain"), F.col("redirect_url")).alias("hops"), classify.redirect_path(F.col("seo.redirectChain"), F.col("redirect_url")).alias("path"))


def duplicates(results: DataFrame) -> DataFrame:
    """Groups by title, meta description, h1 and body hash, largest first within a field."""
    parts = [aggregates.group_duplicates(results, f) for f in ("title", "meta_description", "h1", "seo.contentHash")]
    return reduce(DataFrame.union, parts)


def orphans(results: DataFrame, start_urls: DataFrame | None = None) -> DataFrame:
    return graph.orphans(results, start_urls)


def pagerank(results: DataFrame, top: int = 100, **how) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(F.desc("score"), "url")
    return graph.pagerank(results, **how).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def indexability(results: DataFrame) -> DataFrame:
    return results.where((F.col("resource_type") == "HTML") & ~F.col("is_indexable")).select("session_id", "url", classify.non_indexable_reason().alias("reason"))


def missing(results: DataFrame) -> DataFrame:
    """(session_id, url, field) for each of title, description and h1 that is blank on a content page."""
    fields = ["title", "meta_description", "h1"]
    blank = F.filter(F.array(*[F.when(F.trim(text_of(f)) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return results.where(content_page()).select("session_id", "url", F.explode(blank).alias("field"))


def insecure(results: DataFrame) -> DataFrame:
    return results.where(urls.insecure(F.col("url"))).select("session_id", "url", "status")


def pagespeed(results: DataFrame, top: int = 100) -> DataFrame:
    return results.where((F.col("resource_type") == "HTML") & (F.col("response_time") > 0)).orderBy(F.desc("response_time"), "id").limit(top).select("session_id", "url", "response_time", "size")


def structured(results: DataFrame) -> DataFrame:
    return aggregates.structured_types(results)


def security(results: DataFrame) -> DataFrame:
    """(session_id, url, header) for each security header a content page recorded as absent."""
    s = lambda k: F.coalesce(~F.col(f"seo.securityHeaders.{k}"), F.lit(False))
    gone = F.filter(F.array(*[F.when(s(k), F.lit(k)) for k in ("hsts", "csp", "xFrameOptions")]), lambda x: x.isNotNull())
    return results.where(content_page()).select("session_id", "url", F.explode(gone).alias("header"))


def hreflang(results: DataFrame) -> DataFrame:
    rows = results.where(F.size("seo.hreflang") > 0)
    return rows.select("session_id", "url", F.array_join(F.transform("seo.hreflang", lambda h: h["lang"]), ", ").alias("languages"), F.size("seo.hreflang").cast("long").alias("n"))


def broken(results: DataFrame) -> DataFrame:
    return graph.broken_links(results)


def images(results: DataFrame, shown: int = 50) -> DataFrame:
    return results.where("seo.imagesMissingAlt > 0").select("session_id", "url", F.col("seo.imagesMissingAlt").alias("n"), F.slice("seo.missingAltImages", 1, shown).alias("images"))


def sitemap(results: DataFrame) -> DataFrame:
    return aggregates.sitemap_coverage(results)


def directives(results: DataFrame) -> DataFrame:
    return aggregates.directives_summary(results)


def overview(results: DataFrame) -> DataFrame:
    return aggregates.overview(results)


REPORTS = {
    "overview": overview, "redirects": redirects, "duplicates": duplicates, "orphans": orphans, "pagerank": pagerank, "indexability": indexability, "missing": missing, "insecure": insecure, "pagespeed": pagespeed,
    "structured": structured, "security": security, "hreflang": hreflang, "broken": broken, "images": images, "sitemap": sitemap, "directives": directives,
}
