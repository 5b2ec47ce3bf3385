"""Aggregates over crawl results: one-pass health, distributions, duplicates groups, phase statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .filters import is_2xx, text_of
from .ingest import content_page


def _n(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def health(results: DataFrame, frontier: DataFrame) -> DataFrame:
    """A row a session: 19 aggregates in one scan, and the number of frontier urls."""
    status, ok = F.col("status"), is_2xx()
    security = lambda k: F.col(f"seo.securityHeaders.{k}")
    one = results.groupBy("session_id").agg(
        F.count("*").alias("total"), _n(ok, "status_2xx"), *[_n((status >= k * 100) & (status < (k + 1) * 100), f"status_{k}xx") for k in (3, 4, 5)], _n((status < 200) | (status >= 600), "status_other"),
        _n(text_of("error") != "", "errors"), _n(text_of("redirect_url") != "", "redirects"), _n(F.col("is_indexable"), "indexable"), _n(F.col("is_noindex"), "noindex"), _n(F.col("is_nofollow"), "nofollow"),
        _n(content_page() & (text_of("h1") == ""), "empty_h1"), _n(content_page() & (text_of("title") == ""), "empty_title"),
        F.coalesce(F.avg(F.when(ok, F.col("response_time"))), F.lit(0.0)).alias("avg_response_time"), F.coalesce(F.max(F.when(ok, F.col("response_time"))), F.lit(0)).alias("max_response_time"),
        _n(security("hsts").isNotNull(), "sec_html"), _n(~security("hsts"), "sec_missing_hsts"), _n(~security("csp"), "sec_missing_csp"), _n(~security("xFrameOptions"), "sec_missing_xframe"),
    )
    waiting = frontier.groupBy("session_id").agg(F.count("*").alias("frontier"))
    return one.join(waiting, "session_id", "left").withColumn("frontier", F.coalesce("frontier", F.lit(0).cast("long")))


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(text.js_round(n / total * 100)).cast("long")


def health_pct(h: DataFrame) -> DataFrame:
    return h.select("session_id", *[percent(F.col(c), F.col("total")).alias(f"{c}_pct") for c in ("empty_h1", "empty_title", "noindex", "errors")])


def health_severity(h: DataFrame) -> DataFrame:
    """ok, amber or red for each card."""
    grade = lambda x, red, amber: F.when(x >= red, "red").when(x >= amber, "amber").otherwise("ok")
    share = lambda n: F.when(F.col("total") > 0, n / F.col("total") * 100).otherwise(0.0)
    hsts, other = F.col("sec_missing_hsts") / F.col("sec_html") * 100, F.greatest("sec_missing_csp", "sec_missing_xframe") / F.col("sec_html") * 100
    return h.select(
        "session_id", grade(share(F.col("status_4xx") + F.col("status_5xx")), 25, 10).alias("status_mix"), grade(percent(F.col("empty_h1"), F.col("total")), 50, 25).alias("empty_h1"), grade(percent(F.col("empty_title"), F.col("total")), 25, 10).alias("empty_title"),
        F.when(F.col("sec_html") == 0, "ok").when(hsts >= 50, "red").when((hsts >= 10) | (other >= 50), "amber").otherwise("ok").alias("security"), grade(share(F.col("noindex")), 25, 10).alias("indexability"),
    )


def found_remaining(h: DataFrame) -> DataFrame:
    return h.select("session_id", (F.col("total") + F.col("frontier")).alias("found"), F.col("frontier").alias("remaining"))


def count_results(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n"))


def distinct_status_codes(results: DataFrame) -> DataFrame:
    return results.where("status > 0").select("status").distinct().orderBy("status")


def resource_types(results: DataFrame) -> DataFrame:
    return results.groupBy(text_of("resource_type").alias("resource_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "resource_type")


def resource_segments(results: DataFrame) -> DataFrame:
    """Each type's share of all rows; an empty type is Unknown."""
    by = resource_types(results).where("n > 0")
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select(F.when(F.col("resource_type") == "", "Unknown").otherwise(F.col("resource_type")).alias("label"), "n", (F.col("n") / F.col("total")).alias("share"))


def group_duplicates(results: DataFrame, field: str) -> DataFrame:
    """(session_id, field, value, n, urls): values, trimmed, that more than one row of a session has."""
    name = field.split(".")[-1]
    value = F.trim(F.coalesce(F.col(field), F.lit(""))) if name != "contentHash" else F.coalesce(F.col(field), F.lit(""))
    rows = results.select("session_id", value.alias("value"), "url").where("value <> ''")
    groups = rows.groupBy("session_id", "value").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("url")).alias("urls")).where("n > 1")
    return groups.select("session_id", F.lit(name).alias("field"), "value", "n", "urls")


def structured_types(results: DataFrame) -> DataFrame:
    """(type, n): how often each structured data type stands on content pages."""
    return results.where(content_page()).select(F.explode("seo.structuredDataTypes").alias("type")).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def structured_coverage(results: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("seo.structuredDataTypes"), F.lit(0))
    return results.where(content_page()).groupBy("session_id").agg(_n(n > 0, "with_data"), _n(n <= 0, "missing"), F.count("*").alias("total"))


def security_summary(results: DataFrame) -> DataFrame:
    s = lambda k: ~F.col(f"seo.securityHeaders.{k}")
    return results.where(content_page()).groupBy("session_id").agg(
        F.count("*").alias("total"), _n(s("hsts"), "no_hsts"), _n(s("csp"), "no_csp"), _n(s("xFrameOptions"), "no_xframe"), F.coalesce(F.bool_or(F.col("seo.securityHeaders").isNotNull()), F.lit(False)).alias("has_data")
    )


def sitemap_coverage(results: DataFrame) -> DataFrame:
    inside, ok = F.col("seo.inSitemap"), is_2xx()
    return results.where("resource_type = 'HTML'").groupBy("session_id").agg(
        F.count("*").alias("total"), _n(inside, "in_sitemap"), _n(inside & ~ok, "non_ok"), _n(inside & ok & ~F.col("is_indexable"), "non_indexable"), _n(~inside & ok, "not_in_sitemap")
    )


def directives_summary(results: DataFrame) -> DataFrame:
    return results.where(content_page()).groupBy("session_id").agg(
        F.count("*").alias("total"), _n(F.col("is_noindex"), "noindex"), _n(F.col("is_nofollow"), "nofollow"), _n(F.trim(F.coalesce("seo.xRobotsTag", F.lit(""))) != "", "x_robots"), _n(urls.canonicalised(F.col("canonical"), F.col("url")), "canonicalised")
    )


def overview(results: DataFrame) -> DataFrame:
    return results.groupBy("session_id").agg(F.count("*").alias("total"), text.js_round(F.sum(F.coalesce("response_time", F.lit(0))) / F.count("*")).alias("avg_time"), F.sum(F.coalesce("size", F.lit(0))).alias("total_size"), _n(text_of("error") != "", "errors"))


def overview_by_status(results: DataFrame) -> DataFrame:
    group = F.when(F.coalesce("status", F.lit(0)) == 0, "Error").otherwise(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    return results.groupBy("session_id", group.alias("status_group")).agg(F.count("*").alias("n"))


def overview_by_type(results: DataFrame) -> DataFrame:
    kind = F.when(text_of("resource_type") == "", "Other").otherwise(F.col("resource_type"))
    return results.groupBy("session_id", kind.alias("type")).agg(F.count("*").alias("n"))


def progress_state(log: DataFrame, history: int = 200) -> DataFrame:
    """A row a session: rows, errors, the last url, and the last statuses. The history is cut before it is collected."""
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    last = log.select("session_id", "id", "status", "url", F.row_number().over(w).alias("n")).where(F.col("n") <= history)
    ordered = F.array_sort(F.collect_list(F.struct("id", "status", "url")))
    last = last.groupBy("session_id").agg(ordered.alias("h")).select("session_id", F.element_at("h", -1)["url"].alias("last_url"), F.transform("h", lambda x: x["status"]).alias("latest_statuses"))
    return log.groupBy("session_id").agg(F.count("*").alias("row_count"), _n(text_of("error") != "", "error_count")).join(last, "session_id")


def at_floor(sorted_values: Column, p: float) -> Column:
    """The element floor(n * p) of a sorted list, from 0."""
    return F.try_element_at(sorted_values, F.floor(F.size(sorted_values) * p).cast("int") + 1)


PHASES = ["dns", "tcp", "tls", "ttfb", "download"]


def phase_stats(timings: DataFrame, last: int = 80) -> DataFrame:
    """(phase, n, avg_ms, p95_ms) over each phase's last values; connection phases skip reused connections, all skip 0."""
    pairs = ", ".join(f"'{p}', CAST({p} AS DOUBLE)" for p in PHASES)
    long = timings.select("seq", "reused", F.expr(f"stack({len(PHASES)}, {pairs}) AS (phase, ms)"))
    long = long.where(~((F.col("reused") & F.col("phase").isin("dns", "tcp", "tls")) | (F.col("ms") == 0)))
    w = Window.partitionBy("phase").orderBy(F.desc("seq"))
    recent = long.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    values = F.sort_array(F.collect_list("ms"))
    return recent.groupBy("phase").agg(F.count("*").alias("n"), text.js_round(F.avg("ms")).alias("avg_ms"), text.js_round(at_floor(values, 0.95)).alias("p95_ms"))


def total_stats(timings: DataFrame, last: int = 200) -> DataFrame:
    """(n, p50_ms, p95_ms, reuse_pct): percentiles over the last totals, reuse over all."""
    recent = timings.orderBy(F.desc("seq")).limit(last).agg(F.sort_array(F.collect_list("total")).alias("t"))
    share = timings.agg(F.count("*").alias("n"), text.js_round(F.count_if("reused") / F.count("*") * 100).alias("reuse_pct"))
    return recent.join(share).select("n", text.js_round(at_floor(F.col("t"), 0.5)).alias("p50_ms"), text.js_round(at_floor(F.col("t"), 0.95)).alias("p95_ms"), "reuse_pct")


def host_baseline(responses: DataFrame, samples: int = 20) -> DataFrame:
    """Medians of body bytes and internal links over each host's first ok responses; null before there are `samples`."""
    w = Window.partitionBy("host").orderBy("seq")
    first = responses.where("classification = 'ok'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= samples)
    full = lambda c: F.when(F.count("*") == samples, F.percentile(c, 0.5))
    return first.groupBy("host").agg(F.count("*").alias("samples"), full("body_bytes").alias("median_body_bytes"), full("internal_links").alias("median_internal_links"))


def cookies_by_domain(cookies: DataFrame) -> DataFrame:
    return cookies.groupBy(F.regexp_replace("domain", r"^\.", "").alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


def image_stats(files: DataFrame) -> DataFrame:
    """Count and bytes of a file listing (binaryFile without content)."""
    return files.agg(F.count("*").alias("count"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
