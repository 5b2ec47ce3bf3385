"""HTML extraction with site template removal.

Pages are parsed (a forgiving tokenizer with HTML's implied end tags). Every block element's subtree is
hashed; Spark counts, for each host, on how many pages each subtree stands (partial aggregates, so a hot
host never gathers), and subtrees that recur on many pages of their host are deleted, besides what its
tag, role or class names as menu, header, footer, sidebar, notice, advert, form or comment. What is left
of the article (or the main element, or else the body) is the text: a block a paragraph.

A subtree outside articles recurs if it stands on at least `min_pages` pages and `min_share` of its
host's pages. Inside an article or main element far more is asked for, as passages may repeat and articles
be mirrored there: `article_pages` pages and `article_share` of the host's; and articles of which
recurrence would take more than half stay whole. Where a page (one without an article, say) would lose
more than half to what recurs outside of articles, the same evidence is asked for there; a page of which
nothing would be left stays. A host has at most (subtrees a page) / min_share such subtrees, so its list is
small whatever its number of pages.

Names: classes, roles, ids and labels are read as words, camel case split. On a container (CONTAINERS) a name is
unwanted if it has a word of STRONG, which names no content, unless a word of GUARD is beside it ("has-sidebar",
"tag-cookies"); or if it is made up of words of NAMES and STRONG and of words that only tell place or kind (NEUTRAL), so
"promo-box" is and "related-work" is not. Ids of sections are anchors as often, so there only STRONG counts; articles go
only where a STRONG word is the whole name. Paragraphs, headings and the like are never judged by a name. What browsers
show only in place of the element (object, audio, video, canvas, iframe, noscript) is no text of the page.

Edge cases: null or empty html has empty text; text without markup is one block; a very long page is one
row of one task, read twice (once to count, once to extract), in time in proportion to its length, whatever its markup;
unclosed comments, scripts and tags run to the end, a quote that is never closed is part of an unquoted value; a url without host (or null) counts under the host ""; repeated rows count as
pages; an empty table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import re
import sys
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from . import common
from .common import small_batches, stash, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(common)

MIN_PAGES, MIN_SHARE, ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.3, 20, 0.9
#: Elements that stand in one another; beyond that they follow one another, as in browsers.
DEEPEST = 512
#: Template hashes of all hosts (8 bytes each) up to which the hosts' lists are broadcast, else they are joined by a shuffle.
HASHES_TO_BROADCAST = 500_000

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption option optgroup".split())
# An element of the first kind ends an open one of the second kinds, up to the nearest of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
DROPPED = frozenset("nav header footer aside form script style title textarea xmp iframe noembed noframes noscript head template svg canvas object button select dialog menu audio video datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names that mark what is no article, by themselves or beside words of place and kind.
NAMES = frozenset(
    """promo promos promotion banner widget widgets menu menus nav navigation footer notice notices notification notifications popup modal overlay subscribe subscription signup share sharing
    social related recommended recommendations teaser teasers comment reply replies respond responses discussion pager toolbar login search contentinfo complementary alert skip topbar""".split()
)
# Names of what is no article whatever stands beside them.
STRONG = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot adsbox adunit doubleclick dfp sponsor sponsored sponsors taboola outbrain sidebar sidebars navbar
    breadcrumb breadcrumbs masthead cookie cookies cookiebar cookiebanner consent gdpr ccpa newsletter comments commentlist commentform disqus pagination paginator""".split()
)
# Beside these a strong name tells what a part is about or has, not what it is.
GUARD = frozenset("has with no without not hide show open closed status count enabled tag tags category cat topic type format layout about".split())
# Words that tell the place or kind of a named part.
NEUTRAL = frozenset(
    """left right top bottom upper lower center middle inner outer first last primary secondary main global site page sticky fixed floating mobile desktop small large mini
    box block bar wrapper wrap container content holder area section panel column col row item items list slot unit link links button buttons icon icons form field group
    header title heading head body text message msg label post posts article articles story stories news js id thread
    reader readers user users visitor visitors guest guests google legal privacy policy terms media follow us more read also you may like""".split()
)
CONTAINERS = frozenset("div section aside ul ol dl li table form iframe figure nav header footer menu details span ins center".split())
_LABELLED = frozenset("div section aside nav ul ol form".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
_CAMEL, _NAME, _SIZE = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-z0-9]+"), re.compile(r"[0-9x]+")
_USED = frozenset(("class", "id", "role", "aria-label", "hidden", "aria-hidden", "style"))


def words_of(name: str) -> list[str]:
    return [w for w in _NAME.split(_CAMEL.sub("-", name).lower()) if w and not _SIZE.fullmatch(w)]


def names_furniture(words: list[str], strong_only: bool = False) -> bool:
    """Whether the words of a class, role, id or label name what is no article."""
    if not STRONG.isdisjoint(words) and GUARD.isdisjoint(words):
        return True
    known = not (NAMES.isdisjoint(words) and STRONG.isdisjoint(words))
    return not strong_only and known and all(w in NAMES or w in STRONG or w in NEUTRAL for w in words)


def _unwanted(tag: str, attrs: list[tuple[str, str]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if tag == "article":
            if name in ("class", "role", "id") and any(len(w := words_of(x)) == 1 and (w[0] in STRONG or w[0] == "comment") for x in value.split()):
                return True
        elif tag not in CONTAINERS:
            continue
        elif name in ("class", "role") or name == "id" and tag != "span":
            if any(names_furniture(words_of(x), name == "id" and tag in ("section", "li")) for x in value.split()):
                return True
        elif name == "aria-label" and tag in _LABELLED and len(w := words_of(value)) <= 3 and (names_furniture(w) or w == ["comment"]):
            return True
    return False


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


class Page:
    """A parsed page: elements (tag, parent, dropped, hash) and text runs between block ends."""

    def __init__(self, html: str):
        self.tags, self.parent, self.drop, self.hashes = ["#root"], [-1], [False], [0]
        self.inside = [False]  # an article or main element
        self.runs: list[tuple[int, str] | None] = []  # None: a block ends
        self._parts: list[list[str]] = [[]]
        self._stack = [0]
        self._open: dict[str, int] = {}  # how many elements of a tag are open
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                break
            m = _TAG.match(html, lt)
            if m is None:
                if html.startswith("<!--", lt):
                    end, width = html.find("-->", lt + 4), 3
                elif html.startswith(("<!", "<?"), lt):
                    end, width = html.find(">", lt), 1
                else:  # a sign of the text
                    self._text(html[at : lt + 1])
                    at = lt + 1
                    continue
                self._text(html[at:lt])
                at = end + width if end >= 0 else n
                continue
            self._text(html[at:lt])
            tag, attrs, at = m[2].lower(), [], m.end()
            while True:
                a = _ATTR.match(html, at)
                if a is None or not a[1] and not a[2]:
                    at = n  # the page ends inside a tag
                    break
                at = a.end()
                if a[1]:
                    break
                if (name := a[2].lower()) in _USED:
                    attrs.append((name, unescape(a[3] or a[4] or a[5] or "")))
            if not (at < n or a and a[1]):
                break
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, attrs)
            if tag in RAW:
                raw_end = _raw_end(tag).search(html, at)
                at = raw_end.end() if raw_end else n
                self._end(tag)
        while len(self._stack) > 1:
            self._pop()

    def _text(self, text: str) -> None:
        if not text or text.isspace() and not self.runs:
            return
        here = self._stack[-1]
        self.runs.append((here, text))
        self._parts[here].append(text)

    def _start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        stack, opened = self._stack, self._open
        if tag in CLOSES_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                t = self.tags[stack[k]]
                if t == "p":
                    while len(stack) > k:
                        self._pop()
                    break
                if t in ("button", "td", "th", "caption", "object"):
                    break
        if tag in IMPLIED and any(map(opened.get, IMPLIED[tag][0])):
            ends, scope = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                t = self.tags[stack[k]]
                if t in ends:
                    while len(stack) > k:
                        self._pop()
                    if tag != "tr" or t == "tr":
                        break
                elif t in scope:
                    break
        if tag in BLOCK:
            self.runs.append(None)
        elif tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        if len(stack) > DEEPEST:
            self._pop()
        up = stack[-1]
        opened[tag] = opened.get(tag, 0) + 1
        self.tags.append(tag)
        self.parent.append(up)
        inside = self.inside[up]
        drop = (tag in DROPPED and not (tag == "header" and inside)) or bool(attrs and tag not in ("html", "body", "main") and _unwanted(tag, attrs))
        self.drop.append(drop)
        self.inside.append(inside or tag in ("article", "main"))
        self.hashes.append(0)
        self._parts.append([])
        stack.append(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        stack = self._stack
        for k in range(len(stack) - 1 if self._open.get(tag) else 0, 0, -1):
            if self.tags[stack[k]] == tag:
                while len(stack) > k:
                    self._pop()
                return

    def _pop(self) -> None:
        i = self._stack.pop()
        self._open[self.tags[i]] -= 1
        words = " ".join("".join(self._parts[i]).split())
        self._parts[i] = []
        if words:
            self.hashes[i] = xxh3_64_intdigest(f"{self.tags[i]}\n{words}".encode("utf-8", "surrogatepass"))
        up = self._parts[self.parent[i]]
        if self.tags[i] in BLOCK:
            self.runs.append(None)
            up.append(f" \x01{self.tags[i]}\x01{self.hashes[i]:x} ")
        else:
            up.append(words)

    def subtrees(self) -> set[tuple[int, bool]]:
        """(hash, inside an article) of the block elements with text that no rule drops."""
        dead = self._dead(frozenset(), frozenset())
        return {(h, self.inside[p]) for h, t, p, d in zip(self.hashes, self.tags, self.parent, dead, strict=True) if h and not d and t in BLOCK and t not in ("html", "body")}

    def _dead(self, anywhere, in_article) -> list[bool]:
        dead = []
        for i, (p, drop, h) in enumerate(zip(self.parent, self.drop, self.hashes, strict=True)):
            dead.append(p >= 0 and dead[p] or drop or bool(i) and h in (in_article if self.inside[p] else anywhere))
        return dead

    def text(self, anywhere=frozenset(), in_article=frozenset()) -> str:
        """The main text, without the subtrees of these hashes."""
        dead = self._dead(anywhere, in_article)
        in_header = [False]
        for t, p in zip(self.tags[1:], self.parent[1:], strict=True):
            in_header.append((in_header[p] or t == "header") and t not in HEADINGS)
        top = self._tops(dead)
        sizes: set[int] = set()
        blocks: list[tuple[int, str]] = []
        held: list[str] = []
        of = -1
        for run in [*self.runs, None]:
            if run is None:
                text = " ".join(unescape("".join(held)).split())
                if text:
                    blocks.append((of, text))
                    sizes.add(of)
                held, of = [], -1
            elif not dead[run[0]] and not (in_header[run[0]] and self.inside[run[0]]):
                held.append(run[1])
                if of < 0 and not run[1].isspace():
                    of = top[run[0]]
        if any(k > 0 for k in sizes):
            blocks = [b for b in blocks if b[0] > 0]
        return "\n\n".join(t for _, t in blocks)

    def without_templates(self, anywhere, strong, in_article) -> str:
        """The main text without the recurring subtrees; strong: those outside articles for which far more speaks."""
        whole = self.text()
        if not anywhere and not in_article:
            return whole
        inner = self.text(frozenset(), in_article) if in_article else whole
        if 2 * len(inner) < len(whole):
            in_article, inner = frozenset(), whole
        out = self.text(anywhere, in_article)
        if 2 * len(out) < len(inner):
            out = self.text(strong, in_article)
        return out or inner

    def _tops(self, dead) -> list[int]:
        """For each element the outermost article around it; main elements where no article has text; else 0."""
        for kind in ("article", "main"):
            if kind in self.tags:
                top = [0]
                for i, (t, p) in enumerate(zip(self.tags[1:], self.parent[1:], strict=True), 1):
                    top.append(top[p] or (i if t == kind else 0))
                if any(run and top[run[0]] and not dead[run[0]] and not run[1].isspace() for run in self.runs):
                    return top
        return [0] * len(self.tags)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, article_pages: int = ARTICLE_PAGES, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """(host, anywhere, strong, in_article): hashes of the subtrees that recur on each host's pages."""
    small_batches(pages.sparkSession)

    def hashed(batches):
        for batch in batches:
            hosts, hashes, places = [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for h, place in Page(html or "").subtrees():
                    hosts.append(host)
                    hashes.append(_signed(h))
                    places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(places, pa.bool_())], names=["host", "h", "inside"])

    rows = pages.select(_host().alias("host"), "html")
    least = min(min_pages, article_pages)
    found = rows.mapInArrow(hashed, "host string, h long, inside boolean").groupBy("host", "h", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("inside"), article_pages).otherwise(min_pages))
    total = pages.select(_host().alias("host")).groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    often = found.join(total, "host").where(F.col("n") >= F.col("pages") * F.when(F.col("inside"), article_share).otherwise(min_share))
    sure = (F.col("n") >= article_pages) & (F.col("n") >= F.col("pages") * article_share)
    lists = {"anywhere": ~F.col("inside"), "strong": ~F.col("inside") & sure, "in_article": F.col("inside")}
    return often.groupBy("host").agg(*[F.collect_list(F.when(which, F.col("h"))).alias(name) for name, which in lists.items()])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, article_pages: int = ARTICLE_PAGES, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    marks = stash(templates(pages, min_pages, min_share, article_pages, article_share), "templates")
    # A row a host: broadcast where the hashes are counted to be few, else shuffled.
    size = marks.agg(F.sum(F.size("anywhere") + F.size("strong") + F.size("in_article") + 8)).first()[0] or 0
    marks = F.broadcast(marks) if size <= HASHES_TO_BROADCAST else marks

    def run(batches):
        for batch in batches:
            texts, gone = [], []
            for html, *lists in zip(*[batch.column(c).to_pylist() for c in ("html", "anywhere", "strong", "in_article")], strict=True):
                page = Page(html or "")
                drop = [frozenset(h % (1 << 64) for h in x or ()) for x in lists]
                texts.append(page.without_templates(*drop))
                gone.append(sum(1 for h in set(page.hashes) if h and (h in drop[0] or h in drop[2])))
            text = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    fields = pages.schema
    schema = T.StructType([fields["page_id"], fields["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    rows = pages.withColumn("host", _host()).join(marks, "host", "left").select("page_id", "url", "html", "anywhere", "strong", "in_article")
    return rows.mapInArrow(run, schema)


def op1_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
