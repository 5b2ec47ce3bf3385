"""The data model: promoted columns of a crawl result, the typed overflow struct, and event records."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
STRINGS = T.ArrayType(S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


META_TAG = _struct(name=S, property=S, content=S)
HREFLANG = _struct(lang=S, href=S)
SECURITY = _struct(hsts=B, csp=B, xFrameOptions=B, xContentTypeOptions=B, referrerPolicy=B, permissionsPolicy=B)
PERF = _struct(ttfb=L, domContentLoaded=L, loadTime=L, fcp=L, lcp=L, cls=D)
SCRAPED = T.MapType(S, _struct(value=S, appears=B))

# Overflow keys by type; every key is always there, with its type's default.
SEO_STRINGS = ["metaGooglebot", "xRobotsTag", "ogType", "ogUrl", "datePublishedTime", "dateModifiedTime", "contentHash"]
SEO_LONGS = ["ogImageWidthReal", "ogImageHeightReal", "ogImageFileSize", "h1Count", "h2Count", "imageCount", "imagesMissingAlt", "crawlDepth"]
SEO_ARRAYS = ["outlinks", "redirectChain", "structuredDataTypes", "jsErrors", "consoleErrors", "failedRequests", "missingAltImages"]
SEO_BOOLEANS = ["inSitemap", "blockedByRobots"]

SEO = _struct(
    **{k: S for k in SEO_STRINGS}, **{k: L for k in SEO_LONGS}, **{k: STRINGS for k in SEO_ARRAYS}, metaTags=T.ArrayType(META_TAG), hreflang=T.ArrayType(HREFLANG),
    responseHeaders=T.MapType(S, S), redirectHeaders=T.MapType(S, S), scraper=SCRAPED, securityHeaders=SECURITY, perf=PERF, **{k: B for k in SEO_BOOLEANS},
)

# Promoted columns with the JSON key of each.
PROMOTED: list[tuple[str, T.DataType, str]] = [
    ("id", L, "id"), ("session_id", L, "sessionId"), ("url", S, "url"), ("status", L, "status"), ("title", S, "title"), ("h1", S, "h1"), ("h2", S, "h2"),
    ("meta_description", S, "metaDescription"), ("canonical", S, "canonical"), ("internal_links", L, "internalLinks"), ("external_links", L, "externalLinks"),
    ("response_time", L, "responseTime"), ("content_type", S, "contentType"), ("resource_type", S, "resourceType"), ("size", L, "size"), ("error", S, "error"),
    ("word_count", L, "wordCount"), ("meta_robots", S, "metaRobots"), ("is_indexable", B, "isIndexable"), ("is_noindex", B, "isNoindex"), ("is_nofollow", B, "isNofollow"),
    ("og_title", S, "ogTitle"), ("og_description", S, "ogDescription"), ("og_image", S, "ogImage"), ("og_image_width", L, "ogImageWidth"), ("og_image_height", L, "ogImageHeight"),
    ("date_published", S, "datePublished"), ("date_modified", S, "dateModified"), ("redirect_url", S, "redirectUrl"), ("server_header", S, "serverHeader"),
]
CAMEL = {name: key for name, _, key in PROMOTED}

RESULT = T.StructType([*[T.StructField(n, t) for n, t, _ in PROMOTED], T.StructField("seo", SEO)])
FRONTIER = _struct(session_id=L, url=S)
SESSION = _struct(id=L, start_url=S, started_at=T.TimestampType(), completed_at=T.TimestampType(), config_json=S)

#: One line of the crawler's stream: a bare result (no `type`) or a typed event.
EVENT = T.StructType(
    [
        *[T.StructField(k, t) for n, t, k in PROMOTED if n not in ("id", "session_id")], *SEO.fields,
        *_struct(
            type=S, event=S, generation=L, ts=L, host=S, level=S, msg=S, name=S, queue=L, inFlight=L, processed=L, errors=L, pagesPerSec=D, dns=L, tcp=L, tls=L, ttfb=L,
            download=L, total=L, reused=B, bytes=L, urls=STRINGS, sampleUrls=STRINGS, cooldownMs=L, attempt=L, delayMs=L, multiplier=D, blockRate=D, classification=S, action=S, reason=S, sampleUrl=S,
        ).fields,
    ]
)
