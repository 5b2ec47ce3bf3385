"""Classification of responses, resources and directives, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Phrases of bot walls.
BLOCK_PHRASES = (
    "access denied|attention required|just a moment|verify you are human|are you a robot|pardon our interruption|request unsuccessful|you have been blocked|you've been blocked|"
    r"sorry,?\s+you have been blocked|security check|cloudflare to restrict access|please verify you are a human|bot detected|access to this page has been denied|"
    "website is using a security service to protect itself"
)
# Resource types by the first content-type substring that matches.
RESOURCES = [("text/html", "HTML"), ("text/css", "CSS"), ("javascript", "JavaScript"), ("image/", "Image"), ("font", "Font"), ("pdf", "PDF")]
DIRECTIVES = ["index", "noindex", "follow", "nofollow", "noarchive", "nosnippet", "noimageindex", "notranslate", "nocache", "noai", "noimageai"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def classify_resource(content_type: Column) -> Column:
    low, out = F.lower(_text(content_type)), F.lit("Other")
    for part, name in reversed(RESOURCES):
        out = F.when(low.contains(part), name).otherwise(out)
    return out


def robots_directives(meta: Column, googlebot: Column, x_robots: Column) -> Column:
    """struct(is_indexable, is_noindex, is_nofollow): split at commas only, parameters not stripped."""
    tokens = F.transform(F.split(F.lower(F.concat_ws(",", _text(meta), _text(googlebot), _text(x_robots))), ","), lambda t: F.trim(t))
    none = F.array_contains(tokens, "none")
    noindex = F.array_contains(tokens, "noindex") | none
    return F.struct((~noindex).alias("is_indexable"), noindex.alias("is_noindex"), (F.array_contains(tokens, "nofollow") | none).alias("is_nofollow"))


def directive_tokens(meta: Column, googlebot: Column, x_robots: Column) -> Column:
    """Distinct grid tokens: split at , and ; with what follows a colon stripped; none is noindex and nofollow."""
    parts = F.transform(F.split(F.lower(F.concat_ws(",", _text(meta), _text(googlebot), _text(x_robots))), "[,;]"), lambda t: F.trim(t))
    tokens = F.array_distinct(F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.trim(F.split(t, ":")[0])))
    return F.when(F.array_contains(tokens, "none"), F.array_union(tokens, F.array(F.lit("noindex"), F.lit("nofollow")))).otherwise(tokens)


def directive_numeric(name: str, meta: Column, googlebot: Column, x_robots: Column) -> Column:
    return F.regexp_extract(F.concat_ws(",", _text(meta), _text(googlebot), _text(x_robots)), rf"(?i){name}:\s*(-?\w+)", 1)


def max_image_preview(meta: Column) -> Column:
    return F.regexp_extract(_text(meta), r"(?i)max-image-preview:\s*(\w+)", 1)


def security_audit(headers: Column) -> Column:
    """Which security headers are there and not empty; names in lower case."""
    has = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(headers, F.lit(n)), F.lit("")) for n in names]).isNotNull()
    return F.struct(
        has("strict-transport-security").alias("hsts"), has("content-security-policy", "content-security-policy-report-only").alias("csp"), has("x-frame-options").alias("xFrameOptions"),
        has("x-content-type-options").alias("xContentTypeOptions"), has("referrer-policy").alias("referrerPolicy"), has("permissions-policy", "feature-policy").alias("permissionsPolicy"),
    )


def non_indexable_reason() -> Column:
    noindex = F.col("is_noindex") | _text(F.col("meta_robots")).rlike("(?i)noindex") | _text(F.col("seo.xRobotsTag")).rlike("(?i)noindex")
    return (
        F.when(F.col("status") == 0, "HTTP error").when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when((F.col("status") >= 300) & (F.col("status") < 400), "Redirect")
        .when(noindex, "noindex").when(urls.canonicalised(F.col("canonical"), F.col("url")), "Canonicalised").otherwise("Non-indexable")
    )


def status_text(status: Column, error: Column) -> Column:
    """A label of the status; for 0 a short form of the error."""
    err, fixed = _text(error), {301: "Moved Permanently", 302: "Found", 304: "Not Modified", 404: "Not Found", 410: "Gone", 429: "Too Many Requests"}
    out = F.when((status >= 200) & (status < 300), "OK")
    for code, label in fixed.items():
        out = out.when(status == code, label)
    out = out.when(status >= 500, "Server Error").when(status >= 400, "Client Error").when(status >= 300, "Redirect").when(err.startswith("host_blocked_by_detector"), "Parked")
    for rx, label in [("timeout", "Timeout"), ("ERR_CONNECTION_RESET|ECONNRESET", "Connection reset"), ("ERR_NAME_NOT_RESOLVED|ENOTFOUND", "DNS failed"), ("ERR_CERT|SSL|TLS", "TLS error"), ("ERR_HTTP2", "HTTP/2 error"), ("ERR_ABORTED|aborted", "Aborted")]:
        out = out.when(err.rlike(f"(?i){rx}"), label)
    return out.when(F.length(err) > 40, F.concat(F.substring(err, 1, 38), F.lit("…"))).otherwise(err)


def queue_status(status: Column, error: Column) -> Column:
    return F.when((status == 0) & (_text(error) != ""), "Pending").when(status >= 400, "Pending").when((status >= 200) & (status < 400), "Done").otherwise("")


def block_reason(status: Column, title: Column) -> Column:
    """Why a response alone counts as blocked (null: it doesn't); repeats of titles need a host's state."""
    return (
        F.when(status == 403, "status_403").when(status == 429, "status_429").when((status >= 500) & (status < 600), "status_5xx")
        .when((_text(title) != "") & title.rlike(f"(?i){BLOCK_PHRASES}"), "soft_title_phrase")
    )


def response_classification(status: Column, title: Column, body: Column, links: Column, median_body: Column, median_links: Column) -> Column:
    reason = block_reason(status, title)
    cloaked = median_body.isNotNull() & (body < median_body * 0.05) & (links < median_links * 0.05)
    return (
        F.when(status.isin(403, 429, 503), F.concat(F.lit("blocked-status:"), status.cast("string"))).when(reason == "status_5xx", "blocked-status:5xx").when(reason.isNotNull(), "blocked-content")
        .when((status < 200) | (status >= 300), "other").when(cloaked, "cloaked").otherwise("ok")
    )


def pacing_bucket(delay_ms: Column) -> Column:
    return F.when(delay_ms < 1000, "AGGRESSIVE").when(delay_ms < 3000, "STEADY").when(delay_ms < 8000, "CAUTIOUS").otherwise("PROBING")


def redirect_hops(chain: Column, redirect_url: Column) -> Column:
    n = F.coalesce(F.size(chain), F.lit(0))
    return F.when(n > 0, n).when(_text(redirect_url) != "", 1).otherwise(0).cast("long")


def redirect_path(chain: Column, redirect_url: Column) -> Column:
    hops = F.coalesce(chain, F.array().cast("array<string>"))
    more = (_text(redirect_url) != "") & ~F.coalesce(F.try_element_at(hops, F.lit(-1)) == redirect_url, F.lit(False))
    return F.array_join(F.when(more, F.concat(hops, F.array(redirect_url))).otherwise(hops), " → ")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait: digits are seconds, else an HTTP date against now; 0 where it says nothing."""
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    until = F.greatest(F.unix_millis(date) - F.unix_millis(now), F.lit(0).cast("long"))
    return F.coalesce(F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).cast("long") * 1000).otherwise(until), F.lit(0).cast("long"))


def retryable(status: Column, retry_after: Column, attempt: Column) -> Column:
    """One retry, of 429 and 503 only, if a wait of at most a minute is asked for."""
    return status.isin(429, 503) & (attempt == 0) & (retry_after > 0) & (retry_after <= 60_000)


def block_vendor(headers: Column, body: Column) -> Column:
    """Hints of who blocked: the server, edge headers, or a reference number in the body."""
    get = lambda k: _text(F.try_element_at(headers, F.lit(k)))
    return F.struct(
        get("server").alias("server"), get("cf-ray").alias("cf_ray"), F.coalesce(F.nullif(get("x-datadome"), F.lit("")), F.nullif(get("x-dd-b"), F.lit("")), F.lit("")).alias("datadome"),
        F.regexp_extract(_text(body), r"(?i)reference\s*(?:#|&#35;)\s*([0-9a-f.]+)", 1).alias("akamai_ref"),
    )


def phase_timings(t: Column) -> Column:
    """Durations from a request's marks (ms; negative: not reached): dns, tcp, tls, ttfb, download, total, reused."""
    gap = lambda a, b: F.when((t[a] >= 0) & (t[b] >= 0), F.greatest(t[b] - t[a], F.lit(0).cast("double"))).otherwise(F.lit(0).cast("double"))
    secure = t["secureConnectionStart"] > 0
    tcp_end = F.when(secure, t["secureConnectionStart"]).otherwise(t["connectEnd"])
    return F.struct(
        gap("domainLookupStart", "domainLookupEnd").alias("dns"), F.when((t["connectStart"] >= 0) & (tcp_end >= 0), F.greatest(tcp_end - t["connectStart"], F.lit(0).cast("double"))).otherwise(F.lit(0).cast("double")).alias("tcp"),
        F.when(secure, gap("secureConnectionStart", "connectEnd")).otherwise(F.lit(0).cast("double")).alias("tls"), gap("requestStart", "responseStart").alias("ttfb"), gap("responseStart", "responseEnd").alias("download"),
        F.greatest(t["responseEnd"], F.lit(0).cast("double")).alias("total"), ((t["connectStart"] < 0) | (t["connectEnd"] < 0) | (t["connectStart"] == t["connectEnd"])).alias("reused"),
    )
