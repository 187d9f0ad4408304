import html
import re

import pytest

from bitloom.llm import html_text as H


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_pages_with_a_marked_article(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = H.main_text(pages, model).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search("<article>(.*)</article>", source[r.page_id], re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_without_a_mark(model):
    page = """<body><div id="page"><div class="top-menu"><a href=x>Home</a> <a href=y>News</a></div><div class="post-content"><h1>Title here</h1>
    <p>First paragraph of the text, with <a href=q>link</a> inside &amp; more.</p><div class="advert-box">Buy cheap watches now at our store, the best prices in town.</div>
    <p>Short.</p></div><div class="comments"><h3>Comments</h3><p>I really liked this article, thanks for sharing it with everyone here.</p></div>
    <div class="cookie-notice">We use cookies to improve the experience on this site.</div></div></body>"""
    assert H.extract(page, model) == "Title here\n\nFirst paragraph of the text, with link inside & more.\n\nShort."
    assert H.extract("<p>Only a plain\n page.</p><p>And&nbsp;another one, a bit longer.</p>", model) == "Only a plain page.\n\nAnd another one, a bit longer."
    assert H.extract("<main><h1>T</h1><section class='reader-comments'><p>Nice text, thanks.</p></section><p>Body <b>te</b>xt.</p><aside>side</aside><form>f<input></form></main>", model) == "T\n\nBody text."


def test_broken_markup(model):
    for source in ("<", "<p", "a < b", "</p></div>", "<!--", "<script>x", "<a b='", "<div>" * 3000 + "deep text here." + "</div>" * 3000, "<p>" * 20000, "&#xffffff; &bogus; &amp"):
        assert isinstance(H.extract(source, model), str)


def test_marginals_equal_enumeration(model):
    import itertools
    import math

    page = H.Page("<body><div class=ad><p>One two.</p><ul><li>a</li></ul></div><p>Three four five.</p></body>")
    n = len(page.parents)
    total, ones = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        e = sum(y[i] * (model["bias"] + sum(model["weights"].get(f, 0.0) for f in page.features[i])) for i in range(n))
        e += sum(model["pull"][page.texts[i] is not None] * (y[i] == y[p]) for i, p in enumerate(page.parents) if p >= 0)
        total += math.exp(e)
        ones = [o + math.exp(e) * v for o, v in zip(ones, y, strict=True)]
    assert [round(o / total, 9) for o in ones] == [round(p, 9) for p in H.marginals(page, model)]


def test_edges(spark, model):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>A b c d.</p>", "x"), (2, "u", "<p>A b c d.</p>", "x")], "page_id long, url string, html string, text string")
    got = H.main_text(pages, model).toPandas()
    assert list(got.text) == ["", "", "A b c d.", "A b c d."] and list(got.n_chars) == [0, 0, 8, 8]
    assert H.main_text(pages.limit(0)).count() == 0


def test_every_word_of_an_attribute_counts():
    many = " ".join("u" + "abcdefghij"[i % 10] * (i // 10 + 1) for i in range(60))
    page = H.Page(f"<div class='{many} sidebar'><p>Some text here.</p></div>")
    assert any("c:sidebar" in f for f in page.features)


def test_an_articles_own_header_is_judged_by_the_model(model):
    prose = "The committee met on Monday and agreed to publish its report, which had been delayed for several weeks. " * 2
    page = f"<html><body><header><p>Site of the week</p></header><article><header><h1>Report is out</h1></header><p>{prose}</p></article></body></html>"
    text = H.extract(page, model)
    assert text.startswith("Report is out\n\nThe committee") and "Site" not in text


def test_forms_that_hold_the_page():
    prose = "A paragraph of the page, long enough to be told from a label or a line of a menu that stands in a form. "
    page = H.Page(f"<body><form id=aspnetForm><h1>Title</h1><p>{prose}</p><input><select><option>x</select></form><form><p>Search here</p></form></body>")
    assert [t for t in page.texts if t] == ["Title", prose.strip()]
    page = H.Page(f"<form><div><p>{prose}</p><p>{prose}</p></div></form><p>Short</p>")
    assert [t for t in page.texts if t] == [prose.strip(), prose.strip(), "Short"]
    page = H.Page(f"<form><p>Name</p><p>{prose}</p></form><p>{prose * 3}</p>")
    assert [t for t in page.texts if t] == [(prose * 3).strip()]


def test_headers_of_main_and_unquoted_values():
    page = H.Page("<header><p>Site</p></header><main><header><h1>Head</h1></header><p>Text <a title=it's href=q>link</a> more <b title='a>b' x=\"c>d\">bold</b></p></main>")
    assert [t for t in page.texts if t] == ["Head", "Text link more bold"]


def test_parsing_is_linear():
    import time

    for source in ("<div>" * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<a <a " * 100_000, "<p>" * 50_000 + "<li>" * 50_000):
        begin = time.process_time()
        H.Page(source)
        assert time.process_time() - begin < 8, source[:20]
