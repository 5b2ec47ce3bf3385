"""The grid: projection to JSON names, overflow merge, sort, paging, tabs, and the detail pane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import classify, text

# What may be sorted by, as JSON names and columns.
SORTABLE = {
    "url": "url", "status": "status", "title": "title", "h1": "h1", "responseTime": "response_time", "size": "size", "internalLinks": "internal_links", "externalLinks": "external_links",
    "wordCount": "word_count", "contentType": "content_type", "resourceType": "resource_type", "id": "id",
}


def sort_column(field: str | None) -> str | None:
    return SORTABLE.get(field or "")


def sort_results(results: DataFrame, column: str | None = None, direction: str = "asc") -> DataFrame:
    """By a sortable column, then id; by id alone for any other."""
    if column not in SORTABLE.values():
        return results.orderBy("id")
    by = F.col(column).desc() if (direction or "").lower() == "desc" else F.col(column).asc()
    return results.orderBy(by, F.col("id").asc())


def page(results: DataFrame, number: int, size: int, column: str | None = None, direction: str = "asc") -> DataFrame:
    """Page `number` (from 0). Deep pages sort what comes before them; keyset paging by id is `after`."""
    return sort_results(results, column, direction).offset(number * size).limit(size)


def after(results: DataFrame, last_id: int, size: int) -> DataFrame:
    return results.where(F.col("id") > last_id).orderBy("id").limit(size)


def last_page(total: int, size: int) -> int:
    return max(1, -(-total // size))


def point_lookup(results: DataFrame, session_id: int, url: str) -> DataFrame:
    return results.where((F.col("session_id") == session_id) & (F.col("url") == url)).limit(1)


def project_camel(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON names, missing values as "" or 0 or false; an empty error is null."""
    out = []
    for name, kind, key in schema.PROMOTED:
        if name == "session_id":
            continue
        if name == "error":
            out.append(F.nullif(F.col(name), F.lit("")).alias(key))
        else:
            out.append(F.coalesce(F.col(name), {"string": F.lit(""), "bigint": F.lit(0).cast("long"), "boolean": F.lit(False)}[kind.simpleString()]).alias(key))
    return results.select(*out, *keep)


def merge_overflow(results: DataFrame) -> DataFrame:
    """Column keys first; overflow keys only fill gaps."""
    return project_camel(results, ("seo",)).select("*", "seo.*", og_ratio().alias("ogImageRatio")).drop("seo")


def og_ratio() -> Column:
    """Width over height, real sizes first, else declared ones, else 0."""
    real = (F.coalesce("seo.ogImageWidthReal", F.lit(0)) > 0) & (F.coalesce("seo.ogImageHeightReal", F.lit(0)) > 0)
    declared = (F.coalesce(F.col("ogImageWidth"), F.lit(0)) > 0) & (F.coalesce(F.col("ogImageHeight"), F.lit(0)) > 0)
    return F.when(real, F.round(F.col("seo.ogImageWidthReal") / F.col("seo.ogImageHeightReal"), 2)).when(declared, F.round(F.col("ogImageWidth") / F.col("ogImageHeight"), 2)).otherwise(F.lit(0.0))


# The columns of each tab, by the short names of `grid_columns`.
_DIRECTIVES = "index noindex follow nofollow noarchive nosnippet noimageindex notranslate nocache noai noimageai maxImgPreview maxSnippet maxVideoPreview"
TABS = {
    "Internal": f"address contentType statusCode statusText redirectUrl title titleLen metaDesc metaDescLen h1 h1Len h1Count h2 h2Len h2Count canonical indexable {_DIRECTIVES} xRobotsTag ogTitle ogDesc ogImage ogType ogUrl ogImgW ogImgH ogImgWReal ogImgHReal ogImgRatio ogImgSize datePub datePubTime dateMod dateModTime crawlDepth intLinks extLinks uniqueOutlinks wordCount resource responseTime ttfb lcp cls size server sdTypes hreflangCount imageCount imagesMissingAlt hsts csp xFrame",
    "External": "address contentType statusCode statusText server intLinks extLinks responseTime resource size", "Security": "address statusCode hsts csp xFrame xContentType referrerPolicy server",
    "Response Codes": "address statusCode statusText redirectUrl server contentType responseTime", "URL": "address statusCode contentType size responseTime", "Page Titles": "address title titleLen statusCode indexable",
    "Meta Description": "address metaDesc metaDescLen statusCode indexable", "H1": "address h1 h1Len h1Count statusCode", "H2": "address h2 h2Len h2Count statusCode",
    "Content": "address wordCount contentType size statusCode responseTime", "Images": "address imageCount imagesMissingAlt ogImage ogImgW ogImgH ogImgWReal ogImgHReal ogImgRatio ogImgSize maxImgPreview statusCode",
    "Canonicals": "address canonical statusCode indexable", "Directives": f"address statusCode metaRobots metaGooglebot xRobotsTag indexable {_DIRECTIVES}", "JavaScript": "address statusCode size responseTime",
    "Links": "address intLinks extLinks uniqueOutlinks statusCode", "Structured Data": "address statusCode sdTypes ogTitle ogType datePub dateMod",
    "Overview": "address statusCode statusText title metaDesc h1 canonical ogImage ogImgW ogImgH metaRobots indexable intLinks extLinks wordCount responseTime size", "Issues": "address statusCode statusText title metaDesc h1 canonical indexable noindex",
    "Site Structure": "address statusCode crawlDepth intLinks extLinks wordCount size", "Response Times": "address responseTime ttfb fcp lcp cls statusCode size server",
    "Recrawl Queue": "address queueStatus statusCode statusText contentType responseTime size",
}


def grid_columns() -> dict[str, Column]:
    """Every grid column by its short name, over result rows."""
    c, s = F.col, lambda k: F.col(f"seo.{k}")
    robots = (c("meta_robots"), s("metaGooglebot"), s("xRobotsTag"))
    has = lambda d: F.array_contains(classify.directive_tokens(*robots), d)
    size_of = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    ratio = F.when((s("ogImageWidthReal") > 0) & (s("ogImageHeightReal") > 0), F.round(s("ogImageWidthReal") / s("ogImageHeightReal"), 2)).when((c("og_image_width") > 0) & (c("og_image_height") > 0), F.round(c("og_image_width") / c("og_image_height"), 2)).otherwise(F.lit(0.0))
    made = {
        "address": c("url"), "contentType": c("content_type"), "statusCode": c("status"), "statusText": classify.status_text(c("status"), c("error")), "title": c("title"), "titleLen": text.length_quality(c("title"), 30, 60),
        "h1": c("h1"), "h1Len": F.length("h1"), "h1Count": s("h1Count"), "h2": c("h2"), "h2Len": F.length("h2"), "h2Count": s("h2Count"), "metaDesc": c("meta_description"), "metaDescLen": text.length_quality(c("meta_description"), 70, 155),
        "canonical": c("canonical"), "intLinks": c("internal_links"), "extLinks": c("external_links"), "uniqueOutlinks": size_of(s("outlinks")), "responseTime": c("response_time"), "resource": c("resource_type"), "size": text.format_bytes(c("size")),
        "server": c("server_header"), "redirectUrl": c("redirect_url"), "wordCount": c("word_count"), "metaRobots": c("meta_robots"), "metaGooglebot": s("metaGooglebot"), "indexable": c("is_indexable"), "xRobotsTag": s("xRobotsTag"),
        "maxImgPreview": classify.max_image_preview(c("meta_robots")), "maxSnippet": classify.directive_numeric("max-snippet", *robots), "maxVideoPreview": classify.directive_numeric("max-video-preview", *robots), "ogTitle": c("og_title"), "ogDesc": c("og_description"),
        "ogImage": c("og_image"), "ogType": s("ogType"), "ogUrl": s("ogUrl"), "ogImgW": c("og_image_width"), "ogImgH": c("og_image_height"), "ogImgWReal": s("ogImageWidthReal"), "ogImgHReal": s("ogImageHeightReal"), "ogImgRatio": ratio,
        "ogImgSize": text.format_bytes(s("ogImageFileSize")), "datePub": c("date_published"), "datePubTime": s("datePublishedTime"), "dateMod": c("date_modified"), "dateModTime": s("dateModifiedTime"), "ttfb": s("perf.ttfb"), "fcp": s("perf.fcp"), "lcp": s("perf.lcp"),
        "cls": s("perf.cls"), "sdTypes": F.array_join(s("structuredDataTypes"), ", "), "imageCount": s("imageCount"), "imagesMissingAlt": s("imagesMissingAlt"), "hreflangCount": size_of(s("hreflang")), "crawlDepth": s("crawlDepth"), "hsts": s("securityHeaders.hsts"),
        "csp": s("securityHeaders.csp"), "xFrame": s("securityHeaders.xFrameOptions"), "xContentType": s("securityHeaders.xContentTypeOptions"), "referrerPolicy": s("securityHeaders.referrerPolicy"), "queueStatus": classify.queue_status(c("status"), c("error")),
    }
    return made | {d: c(f"is_{d}") if d in ("noindex", "nofollow") else has(d) for d in classify.DIRECTIVES}


def tab(results: DataFrame, name: str, rules: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a tab (Internal for an unknown one), then two for each scraper rule."""
    made = grid_columns()
    return results.select(*[made[c].alias(c) for c in TABS.get(name, TABS["Internal"]).split()], *scraper_columns(rules))


def scraper_columns(rules: tuple[str, ...]) -> list[Column]:
    out = []
    for rule in rules:
        found = F.try_element_at("seo.scraper", F.lit(rule))
        out += [F.coalesce(found["value"], F.lit("")).alias(f"scraper_{rule}"), F.coalesce(found["appears"], F.lit(False)).alias(f"scraper_{rule}_appears")]
    return out


def details(results: DataFrame) -> DataFrame:
    """(id, section, name, value): the detail pane of each row as key and value lists."""
    c, s = F.col, lambda k: F.col(f"seo.{k}")
    t = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    none = lambda x, other="(none)": F.when(t(x) == "", other).otherwise(t(x))
    px = lambda x: F.when(F.coalesce(x, F.lit(0)) > 0, F.concat(x.cast("string"), F.lit("px"))).otherwise("")
    yes = lambda x: F.when(x, "Yes").otherwise("No")
    made = grid_columns()
    sections = {
        "URL Details": [
            ("URL", t(c("url"))), ("Status Code", t(c("status"))), ("Content Type", t(c("content_type"))), ("Resource Type", t(c("resource_type"))), ("Server", t(c("server_header"))), ("Redirect URL", F.nullif(t(c("redirect_url")), F.lit(""))), ("Title", t(c("title"))),
            ("H1", t(c("h1"))), ("H2", t(c("h2"))), ("Meta Description", t(c("meta_description"))), ("Canonical", t(c("canonical"))), ("Word Count", t(c("word_count"))), ("Internal Links", t(c("internal_links"))), ("External Links", t(c("external_links"))),
            ("Unique Outlinks", t(made["uniqueOutlinks"])), ("Response Time", F.concat(t(c("response_time")), F.lit("ms"))), ("Size", text.format_bytes(c("size"))), ("Error", F.nullif(t(c("error")), F.lit(""))),
        ],
        "Directives": [("Meta Robots", none(c("meta_robots"))), ("Meta Googlebot", none(s("metaGooglebot"))), ("X-Robots-Tag", none(s("xRobotsTag"))), ("Indexable", yes(c("is_indexable"))), ("Noindex", yes(c("is_noindex"))), ("Nofollow", yes(c("is_nofollow"))), ("Canonical", none(c("canonical")))],
        "Open Graph": [
            ("og:title", t(c("og_title"))), ("og:description", t(c("og_description"))), ("og:type", t(s("ogType"))), ("og:url", t(s("ogUrl"))), ("og:image", t(c("og_image"))), ("og:image Width", px(c("og_image_width"))), ("og:image Height", px(c("og_image_height"))),
            ("og:image Width (Real)", px(s("ogImageWidthReal"))), ("og:image Height (Real)", px(s("ogImageHeightReal"))), ("og:image Ratio", F.when(made["ogImgRatio"] > 0, made["ogImgRatio"].cast("string")).otherwise("")), ("og:image File Size", F.when(s("ogImageFileSize") > 0, text.format_bytes(s("ogImageFileSize"))).otherwise("")),
        ],
        "Dates": [("Date Published", none(c("date_published"))), ("Published Time", t(s("datePublishedTime"))), ("Date Modified", none(c("date_modified"))), ("Modified Time", t(s("dateModifiedTime")))],
    }
    item = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))
    fixed = F.array(*[item(section, F.lit(name), value) for section, rows in sections.items() for name, value in rows])
    headers = F.transform(F.array_sort(F.map_entries("seo.responseHeaders")), lambda e: item("HTTP Headers", e["key"], e["value"]))
    metas = F.transform("seo.metaTags", lambda m: item("Meta Tags", F.when(m["name"] != "", m["name"]).otherwise(m["property"]), m["content"]))
    scraped = F.flatten(F.transform(F.array_sort(F.map_keys("seo.scraper")), lambda k: F.array(item("Scraper", k, none(F.try_element_at(F.col("seo.scraper"), k)["value"], "(empty)")), item("Scraper", F.concat(k, F.lit(" appears")), yes(F.try_element_at(F.col("seo.scraper"), k)["appears"])))))
    links = F.transform("seo.outlinks", lambda u: item("Outlinks", u, u))
    every = F.concat(F.filter(fixed, lambda r: r["value"].isNotNull()), *[F.coalesce(x, F.array().cast("array<struct<section:string,name:string,value:string>>")) for x in (links, metas, headers, scraped)])
    return results.select("id", F.posexplode(every).alias("position", "r")).select("id", "position", "r.section", "r.name", "r.value")
