"""Page facts from HTML: one Arrow pass over the html column returns a struct.

The static document stands for the rendered one: text is what is left without scripts, styles and
comments, with block elements as line breaks. Selectors of scraper rules are a subset of CSS: tag, #id,
.class, [attr], [attr=value], :nth-child(n), descendants, children and commas.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .urls import resolve

LINK_CAP, IMAGE_CAP, HREFLANG_CAP = 5000, 200, 500
# Meta names of dates, in order of preference.
PUBLISHED = [("property", "article:published_time"), ("name", "date"), ("name", "publish-date"), ("name", "pubdate"), ("name", "dcterms.date"), ("name", "DC.date.issued"), ("property", "datePublished")]
MODIFIED = [("property", "article:modified_time"), ("name", "last-modified"), ("name", "dcterms.modified"), ("name", "DC.date.modified"), ("property", "dateModified")]
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul option title".split())
_UNSEEN = frozenset("script style noscript template head title".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)
        self.all: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.here.tag == "p" or tag == "li" and self.here.tag == "li":
            self.here = self.here.parent
        made = {}
        for k, v in attrs:
            made.setdefault(k, v or "")
        node = Node(tag, made, self.here)
        self.here.children.append(node)
        self.all.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def visible_text(tree: _Tree) -> str:
    body = next((n for n in tree.all if n.tag == "body"), tree.root)
    out, todo = [], [body]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in _UNSEEN:
            if x.tag in _BLOCK:
                out.append("\n")
                todo.append("\n")
            todo.extend(reversed(x.children))
    return "".join(out)


_WHITE = re.compile("[ \t\n\r\v\f\xa0]+")


def words_and_hash(text: str) -> tuple[int, str]:
    """The number of words, and FNV-1a (32 bits) over UTF-16 units with white space runs as one space, a leading one left out."""
    folded = _WHITE.sub(" ", text)
    folded = folded[1:] if folded.startswith(" ") else folded
    n = len(folded.split(" ")) - folded.endswith(" ") if folded.strip(" ") else 0
    if not n:
        return 0, ""
    units = folded.encode("utf-16-le", "surrogatepass")
    h = 2166136261
    for i in range(0, len(units), 2):
        h = (h ^ (units[i] | units[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
    return n, f"{h:x}"


_SIMPLE = re.compile(r"([#.]?)(-?[A-Za-z_*][\w-]*|\*)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*\]|:nth-child\((\d+)\)|:(first-child)")


def compile_selector(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives; each a list of (combinator, tests) from left to right. Unknown syntax raises ValueError."""
    out = []
    for part in re.split(r",(?![^\[]*\])", selector):
        steps, combine = [], " "
        for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip()):
            if token == ">":
                combine = ">"
                continue
            tests, at = [], 0
            while at < len(token):
                m = _SIMPLE.match(token, at)
                if not m:
                    raise ValueError(f"selector {selector!r}")
                if m[2]:
                    tests.append(("tag" if not m[1] else "id" if m[1] == "#" else "class", m[2].lower() if not m[1] else m[2]))
                elif m[3]:
                    value = next((x for x in (m[4], m[5], m[6]) if x is not None), None)
                    tests.append(("attr", (m[3].lower(), value)))
                else:
                    tests.append(("nth", int(m[7] or 1)))
                at = m.end()
            steps.append((combine, tests))
            combine = " "
        if not steps:
            raise ValueError(f"selector {selector!r}")
        out.append(steps)
    return out


def _passes(node: Node, tests: list) -> bool:
    for kind, v in tests:
        if kind == "tag" and v not in ("*", node.tag) or kind == "id" and node.attrs.get("id") != v or kind == "class" and v not in node.attrs.get("class", "").split():
            return False
        if kind == "attr" and (v[0] not in node.attrs or v[1] is not None and node.attrs[v[0]] != v[1]):
            return False
        if kind == "nth" and (node.parent is None or [c for c in node.parent.children if isinstance(c, Node)].index(node) + 1 != v):
            return False
    return True


def _reaches(node: Node, steps: list) -> bool:
    combine, tests = steps[-1]
    if not _passes(node, tests):
        return False
    if len(steps) == 1:
        return True
    up = node.parent
    while up is not None and up.tag != "#root":
        if _reaches(up, steps[:-1]):
            return True
        if combine == ">":
            return False
        up = up.parent
    return False


def select_first(tree: _Tree, compiled: list) -> Node | None:
    return next((n for n in tree.all if any(_reaches(n, steps) for steps in compiled)), None)


def facts(html: str, url: str, base_host: str | None = None, rules: dict | None = None) -> dict:
    """Everything the audit asks of a page."""
    tree = parse(html)
    by: dict[str, list[Node]] = {}
    for n in tree.all:
        by.setdefault(n.tag, []).append(n)
    first = lambda tag: by[tag][0].text().strip() if tag in by else ""
    metas = by.get("meta", [])

    def meta(attr: str, name: str) -> str:
        return next((m.attrs.get("content", "").strip() for m in metas if m.attrs.get(attr) == name), "")

    text = visible_text(tree)
    words, digest = words_and_hash(text)
    published, modified, types = "", "", {}
    for s in by.get("script", []):
        if s.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(s.text() or "{}")
        except ValueError:
            continue
        items = data if isinstance(data, list) else data.get("@graph") or [data] if isinstance(data, dict) else []
        for item in items if isinstance(items, list) else ():
            if not isinstance(item, dict):
                continue
            published, modified = published or str(item.get("datePublished") or ""), modified or str(item.get("dateModified") or "")
            kind = item.get("@type")
            types |= dict.fromkeys([kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else [])
    host = re.sub(r"^[a-zA-Z]+://([^/?#:]*).*", r"\1", url, flags=re.S).lower()
    links, internal, external = {}, 0, 0
    for a in by.get("a", []):
        if "href" not in a.attrs:
            continue
        target = resolve(url, a.attrs["href"])
        if target is None:
            continue
        if len(links) < LINK_CAP:
            links[target] = None
        there = re.sub(r"^[a-zA-Z]+://([^/?#:]*).*", r"\1", target, flags=re.S).lower()
        inside = there == host if not base_host else there == base_host or there.endswith("." + base_host)
        internal, external = internal + inside, external + (not inside)
    images = by.get("img", [])
    bare = [i for i in images if "alt" not in i.attrs]
    rel = lambda n, r: r in n.attrs.get("rel", "").lower().split()
    number = lambda s: int(m[0]) if (m := re.match(r"\s*[+-]?\d+", s)) else 0
    scraped = {}
    for name, compiled in (rules or {}).items():
        hit = select_first(tree, compiled)
        scraped[name] = {"value": hit.text().strip()[:1000] if hit else "", "appears": hit is not None}
    return {
        "title": first("title"), "h1": first("h1"), "h2": first("h2"), "h1Count": len(by.get("h1", [])), "h2Count": len(by.get("h2", [])), "metaDescription": meta("name", "description") or meta("property", "description"),
        "canonical": next((n.attrs.get("href", "") for n in by.get("link", []) if rel(n, "canonical")), ""), "wordCount": words, "contentHash": digest, "metaRobots": meta("name", "robots"), "metaGooglebot": meta("name", "googlebot"),
        "ogTitle": meta("property", "og:title"), "ogDescription": meta("property", "og:description"), "ogType": meta("property", "og:type"), "ogUrl": meta("property", "og:url"), "ogImage": meta("property", "og:image"),
        "ogImageWidth": number(meta("property", "og:image:width")), "ogImageHeight": number(meta("property", "og:image:height")),
        "publishedRaw": next((v for a, k in PUBLISHED if (v := meta(a, k))), published), "modifiedRaw": next((v for a, k in MODIFIED if (v := meta(a, k))), modified), "structuredDataTypes": list(types),
        "metaTags": [{"name": m.attrs.get("name") or m.attrs.get("http-equiv", ""), "property": m.attrs.get("property", ""), "content": m.attrs["content"]} for m in metas if m.attrs.get("content") and any(m.attrs.get(k) for k in ("name", "property", "http-equiv"))],
        "hreflang": [{"lang": n.attrs["hreflang"], "href": n.attrs["href"]} for n in by.get("link", []) if rel(n, "alternate") and n.attrs.get("hreflang") and n.attrs.get("href")][:HREFLANG_CAP],
        "internalLinks": internal, "externalLinks": external, "outlinks": list(links), "imageCount": len(images), "imagesMissingAlt": len(bare),
        "missingAltImages": [resolve(url, i.attrs.get("src", "")) or i.attrs.get("src", "") for i in bare[:IMAGE_CAP]], "scraper": scraped,
    }


_LONGS = ["h1Count", "h2Count", "wordCount", "ogImageWidth", "ogImageHeight", "internalLinks", "externalLinks", "imageCount", "imagesMissingAlt"]
_TEXTS = ["title", "h1", "h2", "metaDescription", "canonical", "contentHash", "metaRobots", "metaGooglebot", "ogTitle", "ogDescription", "ogType", "ogUrl", "ogImage", "publishedRaw", "modifiedRaw"]
FACTS = T.StructType(
    [*[T.StructField(k, T.StringType()) for k in _TEXTS], *[T.StructField(k, T.LongType()) for k in _LONGS], *[T.StructField(k, schema.STRINGS) for k in ("structuredDataTypes", "outlinks", "missingAltImages")]]
    + [T.StructField("metaTags", T.ArrayType(schema.META_TAG)), T.StructField("hreflang", T.ArrayType(schema.HREFLANG)), T.StructField("scraper", schema.SCRAPED)]
)


def extract_udf(rules: dict[str, str] | None = None, base_host: str | None = None):
    """A UDF (html, url) -> facts. rules: {name: selector}."""
    compiled = {name: compile_selector(s) for name, s in (rules or {}).items()}

    def run(batches):
        for html, url in batches:
            yield pd.DataFrame([facts(h or "", u or "", base_host, compiled) for h, u in zip(html, url, strict=True)], columns=FACTS.names)

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, FACTS)


def size_of(headers, body):
    """Content-length, else the body's bytes."""
    declared = F.try_element_at(headers, F.lit("content-length")).try_cast("bigint")
    return F.coalesce(declared, F.octet_length(body).cast("bigint"), F.lit(0).cast("bigint"))


def redirect_info(hops):
    """Of an ordered array of hops (url, status, headers): the chain of urls, where it ends, and the first hop's status and headers."""
    chain = F.transform(hops, lambda h: h["url"])
    return F.struct(
        F.when(F.size(hops) > 1, chain).otherwise(F.array().cast("array<string>")).alias("redirectChain"), F.when(F.size(hops) > 1, F.element_at(chain, -1)).otherwise("").alias("redirectUrl"),
        F.element_at(hops, 1)["status"].alias("status"), F.element_at(hops, 1)["headers"].alias("headers"),
    )


def dimensions(data: bytes) -> tuple[int, int]:
    """(width, height) from the head of a PNG, GIF, JPEG or WebP file; (0, 0) else."""
    big = lambda at, n: int.from_bytes(data[at : at + n], "big")
    little = lambda at, n: int.from_bytes(data[at : at + n], "little")
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return big(16, 4), big(20, 4)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return little(6, 2), little(8, 2)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8 ":
            return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
        if kind == b"VP8L":
            bits = little(21, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark in (0xC0, 0xC1, 0xC2):
                return big(at + 7, 2), big(at + 5, 2)
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 0x01 else 2 + max(big(at + 2, 2), 2)
    return 0, 0


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def dimensions_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(bytes(c)) if c is not None else (0, 0) for c in content], columns=["width", "height"])
