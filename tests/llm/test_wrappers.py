import html
import re

import pytest

from keystead.llm import wrappers


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    return [r["text"] for r in wrappers.extract(df).orderBy("page_id").collect()]


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in wrappers.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:h1|p|br)>", article)
        lines = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks)
        assert r["text"] == " ".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_marked_article(spark):
    body = """<header><a href=/>Site</a></header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld&nbsp; word<br>next</p><div class="advert">Buy</div><ul><li>x<li>y</ul>
    <form><input><button>Go</button></form><script>if (a<b) {}</script><!-- <p>no</p> --><table><tr><td>1<td>2</table></article>
    <section id="comments"><p>first!</p></section><aside>more</aside><footer>&copy; foot</footer>"""
    assert texts(spark, [("http://a.example/1", page(body))]) == ["Head & line One bold word next x y 1 2"]


def test_article_found_by_what_differs(spark):
    def make(i, extra=""):
        return page(f"<div><ul><li><a href=/>home</a><li><a href=/x>other</a></ul></div><div><div><h2>Story number {i}</h2>{''.join(f'<p>Words of story {i} part {k}, quite a few of them here.</p>' for k in range(2 + i % 3))}{extra}</div></div><div><p>All rights reserved by the site.</p></div>")

    pages = [("https://b.example/%d" % i, make(i, "<blockquote>quoted %d</blockquote>" % i if i % 2 else "")) for i in range(8)]
    for i, text in enumerate(texts(spark, pages)):
        parts = " ".join(f"Words of story {i} part {k}, quite a few of them here." for k in range(2 + i % 3))
        assert text == f"Story number {i} {parts}" + (f" quoted {i}" if i % 2 else "")


def test_hosts_have_their_own_wrappers(spark):
    pages = [("http://one.example/a", page("<main><p>kept</p></main><p>out</p>")), ("http://two.example/a", page("<p>only text</p>")), ("HTTP://ONE.example:80/b", page("<main><p>kept too</p><p>more</p></main>"))]
    assert texts(spark, pages) == ["kept", "only text", "kept too more"]


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    pages = [
        (None, None), ("http://c.example/", ""), ("http://c.example/", "plain text only"), ("http://d.example/", "<p>un<b>closed <i>a<p>next < 5 & 6"),
        ("http://e.example/", page(deep)), ("http://f.example/", page("<article><p>" + "long " * 100_000 + "</p></article>")), ("http://g.example/", "<article><p>cut in the mid"),
        ("http://h.example/", "<article><p>a</p><script>never closed"), ("http://h.example/", "<article><p>a</p><script>never closed"), ("not a url", "<article>x &#233; &lt;y&gt; &am &notanentity;</article>"),
    ]
    out = texts(spark, pages)
    assert out[:5] == ["", "", "plain text only", "unclosed a next < 5 & 6", "deep"]
    assert out[5] == ("long " * 100_000).strip() and out[6:9] == ["cut in the mid", "a", "a"] and out[9] == "x é <y> &am ¬anentity;"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.extract(df).count() == 0


def test_expressions():
    def expression(markup):
        root = wrappers.parse(markup)
        wrappers.fold(root)
        return wrappers.skeleton(root)

    def show(item):
        occurrence = item[1] if item[1] != "1" else ""
        return wrappers.SLOT + occurrence if item[0] == wrappers.SLOT else f"{item[0]}({' '.join(map(show, item[2]))}){occurrence}"

    whole = wrappers.merge_wrappers([expression(m) for m in ("<h1>a</h1><p>x</p><p>y</p>", "<h1>b</h1><h2>c</h2><p>z</p>", "<h1>d</h1><p>q<b>r</b></p><hr>")])
    assert show(whole) == "#root(h1(#) h2(#)? p(# b(#)?) hr()?)"
    assert show(wrappers.merge_wrappers([expression("<p>a</p><p><i>b</i></p>")])) == "#root(p(#? i(#)?)+)"


@pytest.mark.parametrize("n", [1, 40])
def test_many_structures_of_one_host(spark, n):
    pages = [("http://z.example/%d" % i, page("<nav><a>m</a></nav><article>" + "".join(f"<h{1 + (i >> b) % 3}>t{i}</h{1 + (i >> b) % 3}><p>p{b}</p>" for b in range(i % 6 + 1)) + "</article>")) for i in range(n)]
    want = [" ".join(f"t{i} p{b}" for b in range(i % 6 + 1)) for i in range(n)]
    assert texts(spark, pages) == want


@pytest.mark.parametrize("url", ["http://mixed.example/%d", "no usable url %d"])
def test_templates_of_one_host(spark, url):
    """Pages of other templates are not blanked by those with an article."""
    nav = "<nav><a href=/>home</a></nav>"
    make = [
        lambda i: f"{nav}<article><p>Article {i} in its own words.</p></article><p>foot</p>",
        lambda i: f"{nav}<main><p>Main {i} in its own words.</p></main><p>foot</p>",
        lambda i: f"{nav}<div class=content><p>Content {i} in many words of its own, far more than the others have: {'word ' * 60}{i}.</p></div><h6>foot</h6>",
        lambda i: f"{nav}<section><p>Section {i} in its own words.</p></section><h6>foot</h6>",
    ]
    want = ["Article {i} in its own words.", "Main {i} in its own words.", "Content {i} in many words of its own, far more than the others have: " + "word " * 60 + "{i}.", "Section {i} in its own words."]
    out = texts(spark, [(url % i, page(make[i % 4](i))) for i in range(24)])
    assert out == [want[i % 4].format(i=i) for i in range(24)]


@pytest.mark.parametrize("open_tag, close_tag", [
    ("<div id='content-with-sidebar'><article>", "</article></div>"), ("<article class='social-policy share'>", "</article>"), ("<div class=sidebar><article>", "</article></div>"),
    ("<main id=comments>", "</main>"), ("<div class='popup menu'><main>", "</main></div>"), ("<div class='related-area'>", "</div>"), ("<div class=widget>", "</div>"),
])
def test_class_names_around_the_text(spark, open_tag, close_tag):
    def make(i):
        body = f"<div class=sidebar><p>side</p></div>{open_tag}<p>Text {i} in its own words.</p>{close_tag}<div class=ad>Buy</div>"
        return page(body).replace("<html>", "<html class='no-cookie menu'>").replace("<body>", "<body class='has-sidebar search'>")

    assert texts(spark, [(f"http://k.example/{i}", make(i)) for i in range(4)]) == [f"Text {i} in its own words." for i in range(4)]


def test_articles_in_comments(spark):
    body = "<div class=page><article><p>Text %d</p><div class='share popular'>Share</div></article><div class=comments><article><p>Reply %d, much longer than the text</p></article></div></div>"
    assert texts(spark, [(f"http://l.example/{i}", page(body % (i, i))) for i in range(4)]) == [f"Text {i}" for i in range(4)]
    body = "<main><p>Text %d, longer than the reply</p><div class=comments><article><p>Reply %d</p></article></div></main>"
    assert texts(spark, [(f"http://m.example/{i}", page(body % (i, i))) for i in range(4)]) == [f"Text {i}, longer than the reply" for i in range(4)]
