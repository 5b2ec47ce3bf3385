"""URL functions: native columns where the rule is simple, one pandas UDF for full canonicalization."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that never change a page's content.
TRACKING_PARAMS = frozenset(
    """utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_source_platform utm_creative_format gclid gclsrc dclid gbraid wbraid fbclid msclkid
    mc_eid mc_cid _ga _gl igshid yclid ttclid twclid""".split()
)
_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def ensure_protocol(url: Column) -> Column:
    return F.when(url.rlike(r"^(?i:https?://)"), url).otherwise(F.concat(F.lit("https://"), url))


def host_of(url: Column) -> Column:
    """The host name, lower-cased; "" where a url has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def authority(url: Column) -> Column:
    """What stands after :// up to the path, with port, user and case; the url itself without a scheme."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)://(.*)$", 1)).otherwise(url)
    return F.regexp_extract(rest, r"^([^/?#]*)", 1)


def link_scope(source: Column, target: Column) -> Column:
    return F.when(authority(source) == authority(target), F.lit("internal")).otherwise(F.lit("external"))


def scope_base(seed: Column) -> Column:
    """The seed's host without one leading www."""
    return F.regexp_replace(host_of(seed), r"^www\.", "")


def in_scope(host: Column, base: Column, page_host: Column) -> Column:
    return F.when(base == "", host == page_host).otherwise((host == base) | host.endswith(F.concat(F.lit("."), base)))


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def strip_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def is_self(canonical: Column, url: Column) -> Column:
    """For the export: "" without a canonical, else whether both are equal but for one trailing slash."""
    return F.when(F.coalesce(canonical, F.lit("")) == "", F.lit("")).otherwise((strip_slash(canonical) == strip_slash(url)).cast("string"))


def canonicalised(canonical: Column, url: Column) -> Column:
    """For reports: a canonical that differs after stripping all trailing slashes."""
    return (F.coalesce(canonical, F.lit("")) != "") & (strip_slashes(canonical) != strip_slashes(url))


def insecure(url: Column) -> Column:
    return url.startswith("http://")


def pasted(text: Column) -> Column:
    """The distinct urls in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i:https?)://[^\s<>\"',;\\]+"), F.lit(0)))


def normalize(url: Column) -> Column:
    """normalize_one for plain http(s) urls, native: fragment dropped, host lowered, default port dropped,
    tracking parameters dropped and the others sorted by name. Paths with dot segments or odd characters
    need normalize_udf."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))
    host = F.when((scheme == "http"), F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*sorted(TRACKING_PARAMS)))
    ordered = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.split(p, "=")[0].alias("name"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["p"]), "&")
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))).otherwise(url)


def normalize_one(raw: str | None) -> str | None:
    """One form for the spellings of a resource: parsed, without fragment and tracking parameters, other
    parameters sorted by name; host lower-cased, default ports dropped, dot segments resolved. What is no
    absolute url stays as it is."""
    if raw is None:
        return None
    text = raw.strip().replace("\t", "").replace("\n", "").replace("\r", "")
    try:
        u = urlsplit(text)
        scheme = u.scheme.lower()
        if scheme not in _PORTS or not (u.hostname or ""):
            return raw
        port = u.port
    except ValueError:
        return raw
    host = u.hostname.encode("idna").decode() if not u.hostname.isascii() else u.hostname
    host = f"[{host}]" if ":" in host else host
    login = u.netloc.rpartition("@")[0]
    netloc = (login + "@" if login else "") + host + (f":{port}" if port and port != _PORTS[scheme] else "")
    path = _no_dots(quote(u.path.replace("\\", "/"), safe="/%:@!$&'()*+,;=~-._|[]^")) or "/"
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING_PARAMS]
    kept.sort(key=lambda kv: kv[0])
    query = urlencode(kept)
    return f"{scheme}://{netloc}{path}" + (f"?{query}" if query else "")


def _no_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


@F.pandas_udf(T.StringType())
def normalize_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_one)


def resolve(base: str, href: str) -> str | None:
    """An absolute http(s) url without fragment, or None."""
    try:
        u = urlsplit(urljoin(base, href.strip()))
    except ValueError:
        return None
    if not u.scheme or u.scheme in ("http", "https") and not u.netloc:
        return None
    path = u.path or ("/" if u.scheme in ("http", "https") else "")
    return u._replace(scheme=u.scheme.lower(), netloc=u.netloc.lower(), path=path, fragment="").geturl()
