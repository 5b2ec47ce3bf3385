"""HTML extraction: pages made for single rules, template removal, and the small table."""

import random
import re
from collections import Counter
from html import unescape

import pytest

from spiderglass.llm.extract import Page, extract

CASES = [
    (None, ""),
    ("", ""),
    ("just text  with\n spaces", "just text with spaces"),
    ("<p>a<p>b &amp; c&nbsp;d", "a\n\nb & c d"),
    ("<html><head><title>T</title></head><body><nav><ul><li>m</ul></nav><article><h1>H</h1><p><b>x<br>y<p>z</article><footer>f</footer>", "H\n\nx y\n\nz"),
    ("<article><header><h1>Title</h1><p>By me</p></header><p>Body</p></article>", "Title\n\nBody"),
    ("<div class='ad'>buy</div><div class=\"main-text\">keep</div><div id=cookie-notice>ok?</div>", "keep"),
    ("<article><p>one</p><div class='comments'><article><p>reader</p></article></div></article>", "one"),
    ("<p>a<script>var x='</p>'; if (a<b) c();</script>b</p><!-- <p>no</p> --><style>p{}</style>", "ab"),
    ("<p>unclosed <!-- comment goes on <p>gone", "unclosed"),
    ("<p>unclosed <script>script goes on <p>gone", "unclosed"),
    ("<form><p>name</p><input></form><p>1 < 2 and a > b</p>", "1 < 2 and a > b"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<p hidden>no</p><p style='display: none'>no</p><p data-hidden=1>yes</p><p aria-hidden=false>too</p>", "yes\n\ntoo"),
    ("<p>t<span class=ad>no</span>ail</p>", "tail"),
    ("<main><p>m</p></main><p>outside</p>", "m"),
    ("<ARTICLE><P TITLE='a>b'>Case</P></ARTICLE>", "Case"),
    ("<p>😀 &#128512; &lt;b&gt;</p>", "😀 😀 <b>"),
    ("</p></div><p>stray ends</div></p>", "stray ends"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<article><p>The first of two articles, a long one with many words in it.</p></article><article><p>Short.</p></article>", "The first of two articles, a long one with many words in it.\n\nShort."),
    ("<article><h2 id='search'>Search</h2><section id=\"related-work\"><p>Others did it.</p></section><p class='alert-levels'>Levels are three.</p></article>", "Search\n\nOthers did it.\n\nLevels are three."),
    ("<div id=sidebar-left>menu</div><p id=comments>Comments on the text</p><div class='post-body'>post</div><div class='x ad-slot-2'>buy</div><section class=related-posts>more</section>", "Comments on the text\n\npost"),
    ("<article><p>one</p><section id='comments'><p>reader</p></section><section aria-label='Comments' class=discussion><p>r</p></section><div class='reader-comments'>r</div><div class=userComments>r</div><div id=disqus_thread>r</div></article>", "one"),
    ("<article><p>one</p><div class='google-ad'>buy</div><div class='ad-728x90'>buy</div><div class='legal-notice'>l</div><div class=cookieBanner>c</div><ins class=adsbygoogle></ins><p>two</p></article>", "one\n\ntwo"),
    ("<article><p class='search'>a</p><p class=subscription>b</p><h2 class='social'>c</h2><pre class=ad>d</pre><blockquote class='comment'>e</blockquote></article>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<article class='post tag-cookies category-ads has-sidebar comments-open'><p>kept</p></article><article class=comment><p>gone</p></article>", "kept"),
    ("<div class='layout with-sidebar'><p>kept</p><div class=sidebar>gone</div></div><section id=search><p>about search</p></section>", "kept\n\nabout search"),
    ('<p>x <a href="foo>bad</a> y</p>', "x bad y"),
    ("<p>a<b", "a"),
    ("<p>a</p><p class='x' data-a=\"q>r\" hidden>no</p><p>b<br/>c<img src=x alt='>'>d", "a\n\nb cd"),
    ("<p>a<!doctype x>b<?php x ?>c</p><!---->d", "abc\n\nd"),
    ("<p>" + "long words " * 200_000 + "</p><p>end", "long words " * 199_999 + "long words\n\nend"),
]


@pytest.mark.parametrize("html,text", CASES, ids=range(len(CASES)))
def test_rules(html, text):
    assert Page(html or "").text() == text


@pytest.mark.parametrize("part", ["<a ", "<a x='", '<a x="y', "<", "</", "<!--", "<!", "<p a=b ", "<a b='c\" ", "<div><p>", "<script>", "</a ", "<a\n\n", "<a/", "=\"<a ", "<li><tr>"])
def test_any_markup_in_linear_time(part):
    import time

    def took(n):
        began = time.process_time()
        Page(part * (n // len(part))).text()
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 10


def test_templates_are_counted_per_host(spark):
    rows = [(i, f"https://a.example/{i}", f"<div class=k><p>Follow our channel</p></div><div><p>text {i}</p></div><section><h2>Read on</h2><p>Always the same</p></section>") for i in range(20)]
    rows += [(100 + i, f"https://b.example/{i}", f"<div class=k><p>Follow our channel</p></div><p>text {i}</p>") for i in range(3)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>passage in many articles</p><p>own {i}</p></article>" if i % 2 else f"<article><p>own {i}</p></article>") for i in range(20)]
    rows += [(300 + i, "http://d.example/", "<div><p>copy of one page</p></div>") for i in range(9)] + [(400, None, None), (401, "no host", "<p>x</p>"), (402, None, "<p>y</p>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        assert got[i].text == f"text {i}" and got[i].n_template >= 2
        assert got[200 + i].text == ("passage in many articles\n\n" if i % 2 else "") + f"own {i}"
    assert got[100].text == "Follow our channel\n\ntext 0" and got[304].text == "copy of one page"
    assert got[400].text == "" and got[400].n_chars == 0 and got[401].text == "x" and got[402].text == "y"
    assert extract(df.where("false")).count() == 0


def test_mirrored_articles_keep_their_text(spark):
    shared = "".join(f"<p>Paragraph {k} of an article that many pages of the host repeat.</p>" for k in range(5))
    rows = [(i, "https://e.example/", f"<nav>menu</nav><article>{shared if i < 6 else ''}<p>seen {i}</p></article>") for i in range(9)]
    rows += [(100 + i, "https://f.example/", f"<div>{shared if i < 6 else ''}<p>seen {i}</p></div>") for i in range(9)]
    rows += [(200 + i, "https://g.example/", f"<article>{shared}<p>seen {i}</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "".join(f"Paragraph {k} of an article that many pages of the host repeat.\n\n" for k in range(5))
    assert got == {i: (whole if i % 100 < 6 or i >= 200 else "") + f"seen {i % 100}" for i, *_ in rows}


def test_subtrees_are_counted_like_brute_force(spark):
    rng = random.Random(3)
    pages = []
    for host in range(4):
        parts = [f"<div><p>part {k} of host {host}</p></div>" for k in range(12)]
        for i in range(rng.choice([4, 15, 40])):
            chosen = [parts[k] for k in range(12) if rng.random() < (k + 1) / 13]
            own = "".join(f"<p>own words {host} {i} {j} of this page, which are many more than the parts have</p>" for j in range(20))
            pages.append((len(pages), f"https://h{host}.example/{i}", host, chosen, own))
    df = spark.createDataFrame([(i, u, f"<main><p>in {i}</p></main>" if i % 11 == 0 else own + "".join(chosen)) for i, u, _, chosen, own in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    total = Counter(h for _, _, h, _, _ in pages)
    count = Counter((h, c) for i, _, h, chosen, _ in pages if i % 11 for c in chosen)
    gone = 0
    for i, _, h, chosen, own in pages:
        if i % 11 == 0:
            assert got[i] == f"in {i}"
            continue
        left = [c for c in chosen if count[(h, c)] < 5 or count[(h, c)] < 0.3 * total[h]]
        gone += len(chosen) - len(left)
        assert got[i] == "\n\n".join(re.findall("<p>(.*?)</p>", own + "".join(left)))
    assert gone > 100


def test_small_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
    assert Counter(map(type, got.values())) == {str: len(got)}
