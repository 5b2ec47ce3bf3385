"""The typed results filter: 31 optional fields joined by AND, and the grid's token language for it.

Each field is one function from its value to a Column, so a filter is a list of predicates that
Catalyst pushes down. Only `duplicateField` needs more than the row itself: a count of 2xx rows with
the same value in the session, over one shuffle by (session, value).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import content_page
from .textindex import TextIndex

FEW_URLS = 1000


@dataclass(frozen=True)
class ResultsFilter:
    statusMin: int | None = None
    statusMax: int | None = None
    hasRedirect: bool | None = None
    indexability: str | None = None
    errorPrefix: str | None = None
    text: str | None = None
    emptyScraperRule: str | None = None
    resourceType: str | None = None
    issuesOnly: bool | None = None
    errorsOnly: bool | None = None
    urlIn: tuple[str, ...] | None = None
    hasOgImage: bool | None = None
    missingOgImage: bool | None = None
    missingField: str | None = None
    titleLengthMin: int | None = None
    titleLengthMax: int | None = None
    metaDescLengthMin: int | None = None
    metaDescLengthMax: int | None = None
    h1LengthMin: int | None = None
    h1LengthMax: int | None = None
    wordCountMin: int | None = None
    wordCountMax: int | None = None
    responseTimeMin: int | None = None
    responseTimeMax: int | None = None
    duplicateField: str | None = None
    canonicalState: str | None = None
    urlPattern: str | None = None
    securityMissing: str | None = None
    structuredData: str | None = None
    imagesMissingAlt: bool | None = None
    h1State: str | None = None


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def is_2xx() -> Column:
    return (F.col("status") >= 200) & (F.col("status") < 300)


def _scraped(rule: str) -> Column:
    return F.coalesce(F.try_element_at("seo.scraper", F.lit(rule))["value"], F.lit(""))


def _issues() -> Column:
    empty = (text_of("title") == "") | (text_of("h1") == "") | (text_of("meta_description") == "")
    return (content_page() & empty) | (F.col("status") >= 400) | F.coalesce(F.col("is_noindex"), F.lit(False))


def _between(column: Column, least: str, most: str) -> dict:
    return {least: lambda v: column >= v, most: lambda v: column < v}


def _choice(**made) -> callable:
    """A field of few values; an unknown one filters nothing."""
    return lambda v: made[v]() if v in made else None


def _missing(name: str):
    return lambda: content_page() & (text_of(name) == "")


def _types() -> Column:
    return F.coalesce(F.size("seo.structuredDataTypes"), F.lit(0))


def _security(name: str):
    return lambda: F.coalesce(~F.col(f"seo.securityHeaders.{name}"), F.lit(False))


def predicates() -> dict:
    length = lambda name: F.length(text_of(name))
    only = lambda column: lambda v: column() if v else None
    return {
        **_between(F.col("status"), "statusMin", "statusMax"),
        "hasRedirect": lambda v: (text_of("redirect_url") != "") if v else (text_of("redirect_url") == ""),
        "indexability": _choice(indexable=lambda: F.col("is_indexable"), noindex=lambda: F.col("is_noindex"), nofollow=lambda: F.col("is_nofollow")),
        "errorPrefix": lambda v: F.lower(F.col("error")).startswith(v.lower()),
        "text": lambda v: (F.lower(F.col("url")).contains(v.strip().lower()) | F.coalesce(F.lower(F.col("title")).contains(v.strip().lower()), F.lit(False))) if v.strip() else None,
        "emptyScraperRule": lambda v: _scraped(v) == "",
        "resourceType": lambda v: (F.col("resource_type") == v) if v else None,
        "issuesOnly": only(_issues),
        "errorsOnly": only(lambda: text_of("error") != ""),
        "urlIn": lambda v: F.col("url").isin(*v) if v else F.lit(False),
        "hasOgImage": only(lambda: content_page() & (text_of("og_image") != "")),
        "missingOgImage": only(lambda: content_page() & (text_of("og_image") == "")),
        "missingField": _choice(**{k: _missing(k) for k in ("title", "h1", "h2", "meta_description", "canonical")}),
        **_between(length("title"), "titleLengthMin", "titleLengthMax"),
        **_between(length("meta_description"), "metaDescLengthMin", "metaDescLengthMax"),
        **_between(length("h1"), "h1LengthMin", "h1LengthMax"),
        **_between(F.col("word_count"), "wordCountMin", "wordCountMax"),
        **_between(F.col("response_time"), "responseTimeMin", "responseTimeMax"),
        "canonicalState": _choice(missing=_missing("canonical"), self=lambda: F.col("canonical") == F.col("url"), cross=lambda: (text_of("canonical") != "") & (F.col("canonical") != F.col("url"))),
        "urlPattern": _choice(long=lambda: F.length("url") > 100, params=lambda: F.col("url").contains("?")),
        "securityMissing": _choice(hsts=_security("hsts"), csp=_security("csp"), xframe=_security("xFrameOptions")),
        "structuredData": _choice(has=lambda: _types() > 0, missing=lambda: content_page() & (_types() <= 0)),
        "imagesMissingAlt": only(lambda: F.col("seo.imagesMissingAlt") > 0),
        "h1State": _choice(multiple=lambda: F.col("seo.h1Count") > 1),
    }


def duplicates(results: DataFrame, field: str) -> DataFrame:
    """2xx rows that share a non-empty value with another 2xx row of their session."""
    rows = results.where(is_2xx() & (text_of(field) != ""))
    n = F.count("*").over(Window.partitionBy("session_id", field))
    return rows.withColumn("_n", n).where("_n > 1").drop("_n")


def apply_filter(results: DataFrame, f: ResultsFilter) -> DataFrame:
    made = predicates()
    for field in fields(f):
        value = getattr(f, field.name)
        if value is None or field.name == "duplicateField":
            continue
        if field.name == "urlIn" and len(value) > FEW_URLS:
            # A long literal list is a relation: the optimizer sees its size and picks the join.
            spark = results.sparkSession
            results = results.join(spark.createDataFrame([(u,) for u in set(value)], "url string"), "url", "left_semi")
            continue
        predicate = made[field.name](value)
        if predicate is not None:
            results = results.where(predicate)
    return results


def filtered(results: DataFrame, f: ResultsFilter, index: TextIndex | None = None) -> DataFrame:
    """The rows of a session that pass f. Duplicates are judged among all of the session's rows. With an index of url and
    title over these rows, a text is looked up there."""
    if f.duplicateField in ("title", "meta_description", "h1"):
        results = duplicates(results, f.duplicateField)
    elif index is not None and f.text and f.text.strip():
        results, f = index.search(f.text), replace(f, text=None)
    return apply_filter(results, f)


# ---- the token language of the grid -----------------------------------------------------------

# Status ranges, tabs that show HTML rows only, and the tokens each tab offers.
STATUS_RANGES = {"2xx": (200, 300), "3xx": (300, 400), "4xx": (400, 500), "5xx": (500, 600)}
HTML_TABS = {"Page Titles", "Meta Description", "H1", "H2", "Content", "Canonicals", "Directives", "Structured Data", "Response Times", "URL"}
TAB_TOKENS = {
    "Internal": ["all", "reqfail", "type:HTML", "type:JavaScript", "type:CSS", "type:Image", "type:Font", "type:PDF", "type:Other"],
    "External": ["all", "status:2xx", "status:3xx", "status:4xx", "status:5xx"], "Security": ["all", "sec:hsts", "sec:csp", "sec:xframe"], "Response Codes": ["all"],
    "URL": ["all", "url:long", "url:params"], "Page Titles": ["all", "missing:title", "title_len:lt:30", "title_len:gt:60", "duplicate:title"],
    "Meta Description": ["all", "missing:meta_description", "meta_desc_len:lt:70", "meta_desc_len:gt:160", "duplicate:meta_description"],
    "H1": ["all", "missing:h1", "h1count:multiple", "h1_len:lt:10", "h1_len:gt:70", "duplicate:h1"], "H2": ["all", "missing:h2"],
    "Content": ["all", "word_count:lt:200", "word_count:lt:500", "word_count:gt:2000"], "Images": ["all", "img:missingalt", "has_og_image", "missing_og_image"],
    "Structured Data": ["all", "sd:has", "sd:missing"], "Canonicals": ["all", "canonical:missing", "canonical:self", "canonical:cross"],
    "Directives": ["all", "idx:indexable", "idx:noindex", "idx:nofollow"], "Response Times": ["all", "rt:lt:500", "rt:gt:3000", "rt:gt:10000"], "Recrawl Queue": ["all"],
}
_PREFIXES = {
    "missing": ("missingField", {"title", "h1", "h2", "meta_description", "canonical"}), "duplicate": ("duplicateField", {"title", "meta_description", "h1"}), "canonical": ("canonicalState", {"missing", "self", "cross"}),
    "idx": ("indexability", {"indexable", "noindex", "nofollow"}), "url": ("urlPattern", {"long", "params"}), "sec": ("securityMissing", {"hsts", "csp", "xframe"}), "sd": ("structuredData", {"has", "missing"}),
}
_FLAGS = {"reqfail": {"errorsOnly": True}, "has_og_image": {"hasOgImage": True}, "missing_og_image": {"missingOgImage": True}, "img:missingalt": {"imagesMissingAlt": True}, "h1count:multiple": {"h1State": "multiple"}}
_NUMBERS = {"title_len": "titleLength", "meta_desc_len": "metaDescLength", "h1_len": "h1Length", "word_count": "wordCount", "rt": "responseTime"}


def _range(low_high: tuple[int, int] | None) -> dict:
    return {"statusMin": low_high[0], "statusMax": low_high[1]} if low_high else {}


def token_fields(token: str, tab: str) -> dict | None:
    """The filter fields a token sets; None if it is no token."""
    if token == "all":
        return {}
    if token in _FLAGS:
        return _FLAGS[token]
    head, _, rest = token.partition(":")
    if m := re.fullmatch(r"(\w+):(lt|gt):(\d+)", token):
        if m[1] in _NUMBERS:
            return {f"{_NUMBERS[m[1]]}Max": int(m[3])} if m[2] == "lt" else {f"{_NUMBERS[m[1]]}Min": int(m[3]) + 1}
    if rest or token.endswith(":"):
        if head == "type":
            return {"resourceType": rest}
        if head == "status":
            return _range(STATUS_RANGES.get(rest))
        if head in _PREFIXES:
            field, known = _PREFIXES[head]
            return {field: rest} if rest in known else {}
    if tab == "Response Codes" and token.isdigit():
        return _range((int(token), int(token) + 1))
    return None


def build_filter(tab: str, token: str = "All", search: str = "", recrawl: tuple[str, ...] = ()) -> ResultsFilter:
    """The filter behind a tab of the grid, a filter token and a search text."""
    if tab == "Issues":
        f = ResultsFilter(issuesOnly=True)
    elif tab == "Recrawl Queue":
        f = ResultsFilter(urlIn=tuple(recrawl), issuesOnly=True)
    elif tab == "Images":
        f = ResultsFilter(resourceType="HTML", hasOgImage=True)
    else:
        f = ResultsFilter(resourceType="HTML" if tab in HTML_TABS else None)
    if token and token != "All":
        found = token_fields(token, tab)
        if found is None:
            number = re.match(r"\s*[+-]?\d+", token)
            if token in STATUS_RANGES:
                found = _range(STATUS_RANGES[token])
            elif tab == "Response Codes":
                found = _range((int(number[0]), int(number[0]) + 1)) if number else {}
            else:
                found = {"resourceType": "Image" if token == "Images" else token}
        f = replace(f, **found)
        if tab == "Images" and token == "missing_og_image":
            f = replace(f, hasOgImage=None)
    return replace(f, text=search.strip()) if search.strip() else f


# The presets of the export menu.
EXPORT_PRESETS = {
    "Internal HTML": ResultsFilter(resourceType="HTML"), "All Links": ResultsFilter(), "Response Codes": ResultsFilter(statusMin=400), "Page Titles": ResultsFilter(titleLengthMin=1), "Redirects": ResultsFilter(statusMin=300, statusMax=400),
}


def log_filter(logs: DataFrame, levels: list[str], search: str = "", index: TextIndex | None = None) -> DataFrame:
    """Log lines of some levels that hold a text, which an index of their messages looks up."""
    if index is not None and levels and search:
        return index.search(search, strip=False).where(F.col("level").isin(*levels))
    out = logs.where(F.col("level").isin(*levels)) if levels else logs.where("false")
    return out.where(F.lower("msg").contains(search.lower())) if search else out
