"""Block reading on written pages, gradients against differences, and the
extracted text against the articles of the test pages."""

import random
import re
from html import unescape

import numpy as np
import pytest

from creditlake.llm import html_extract as hx
from creditlake.llm.html_blocks import blocks
from creditlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks():
    assert texts(None) == texts("") == texts("<script>a</script><!-- x --><style>p{}</style>") == []
    assert texts("<p>a &amp;&lt; b<p>c\n  d<br>e</div><div>f") == ["a &< b", "c d e", "f"]
    assert texts('<script>var t="</p>";x(0);</script><p title="a>b">x</p>') == ["x"]
    assert texts("<head><title>t</title></head><body>a<b>b</b>c < d") == ["abc < d"]
    assert texts("<!-- open <p>x") == texts("<script>open <p>x") == []
    assert texts("a &#233;&nbsp;&eacute; <p") == ["a é é"]
    assert texts("<p a='" + "<i " * 3000) == []
    page = blocks("<body><nav class='Top-Menu'><ul><li><a href=x>m</a><li>n</ul></nav><article><p><b>x<br><p>y</article><p>z")
    assert [b.path for b in page] == [
        ("body", "nav top menu", "ul", "li", "a"), ("body", "nav top menu", "ul", "li"), ("body", "article", "p", "b"),
        ("body", "article", "p"), ("body", "p")]
    assert page[0].link_chars == 1 and page[1].link_chars == 0


def test_gradients():
    rnd = random.Random(0)
    pages = hx.training_pages([])[:3]
    batch, labels = [hx.Sequence(p) for p, _ in pages], [np.array(y, float) for _, y in pages]
    w = hx.new_weights()
    _, g = hx.gradients(w, batch, labels)
    for k in w:
        flat = w[k].reshape(-1)
        for i in [rnd.randrange(len(flat)) for _ in range(4)] + [int(np.abs(g[k]).argmax())]:
            keep, eps = flat[i], 1e-5
            flat[i] = keep + eps
            up, _ = hx.gradients(w, batch, labels)
            flat[i] = keep - eps
            down, _ = hx.gradients(w, batch, labels)
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g[k].reshape(-1)[i]) < 1e-6


@pytest.fixture(scope="module")
def rows(spark):
    return QUERIES["op1_html_extract"](spark, SF).collect()


def test_articles(spark, rows):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(html)

    def article(h):
        inside = h.split("<article>", 1)[1].split("</article>")[0]
        parts = (" ".join(unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inside))
        return "\n".join(p for p in parts if p)
    assert all(r.n_chars == len(r.text) for r in rows)
    right = sum(r.text == article(html[r.page_id]) for r in rows)
    assert right >= 0.98 * len(rows)


def test_unseen_kinds(spark):
    """Held-out built pages: every kind of block that is not main text."""
    w = hx.train(hx.training_pages([]))
    rnd = random.Random(123)
    pages = [blocks(hx.built(["Held out words stand here, one by one.", "Another line of this text.", "Short."], rnd)) for _ in range(80)]
    n = wrong = 0
    for page, p in zip(pages, hx.label(w, [[b._replace(text=b.text.replace("\x01", "") or "-") for b in q] for q in pages])):
        for b, y in zip(page, p):
            n, wrong = n + 1, wrong + ((y >= 0.5) != ("\x01" in b.text))
    assert wrong <= 0.05 * n
    assert all(np.array_equal(a, b) for a, b in zip(w.values(), hx.train(hx.training_pages([])).values()))


def test_edges(spark):
    w = hx.new_weights()
    data = [(1, None, None, 5), (2, "u", "", 5), (3, "u", "   ", 5), (3, "u", "<p>x", 5), (3, "u", "<p>x", 5), (4, None, "<p>" + "word " * 50000, 5)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text int")
    got = hx.extract(df, w).collect()
    assert len(got) == len(data) and got[0].text == got[1].text == got[2].text == ""
    assert hx.extract(df.limit(0), w).count() == 0
    assert hx.extract(df.limit(0)).count() == 0


def test_far_elements_are_seen():
    deep = ("html", "body", "nav menu") + ("div",) * 40
    assert hx.path_features(deep)[:8] == hx.path_features(deep[:5])[:8]
    piled = hx.path_features(("html", "body", "footer") + ("font", "b") * 500)
    assert set(hx.path_features(("html", "body", "footer"))[:-1]) <= set(piled) and len(piled) < 20


def test_empty_raw_tags_swallow_nothing():
    def text(page):
        return [b.text for b in blocks(page)]
    assert text('<p>a</p><svg class="i" /><p>b</p><svg><path/>x</svg><p>c</p>') == ["a", "b", "c"]
    assert text("<p>a</p><math/><p>b</p><svg hidden/><p>c</p><iframe src='x'/><object data=\"y\" /><p>d</p>") == ["a", "b", "c", "d"]
    assert text('<p>a</p><svg width=10/>x</svg><iframe src=http://x/>y</iframe><p>b</p>') == ["a", "b"]
    assert text('<p>a</p><script src="x"/>y</script><p>b</p>') == ["a", "b"]
    head = '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><script src="x"/><title/></head>'
    assert text(head + "<body><p>a</p></body></html>") == ["a"]


def test_custom_elements_and_late_doctype():
    from creditlake.llm.html_blocks import blocks
    text = lambda h: [b.text for b in blocks(h)]
    assert text("<p>alpha</p><title-bar>x</title-bar><p>beta</p>") == ["alpha", "x", "beta"]
    assert text("<article><object-list><p>one</p></object-list><p>two</p></article>") == ["one", "two"]
    assert text("<p>a</p><style-guide/><p>b</p>") == ["a", "b"] and text("<p>a<style>x</style><script\n>y</script>b</p>") == ["ab"]
    late = "<!-- <p> " + "long " * 2000 + " --><!DOCTYPE html PUBLIC '-//W3C//DTD XHTML 1.0 Strict//EN'><html><script src='x'/><p>kept</p>"
    assert text(late) == ["kept"] and text("<html><script src='x'/><p>gone</p>") == []


def test_marked_leaves_comments_and_teasers_out():
    from creditlake.llm import html_extract as he
    from creditlake.llm.html_blocks import blocks
    label = lambda h: he.marked(blocks(h))
    assert label('<article><p>main</p><section class="comments"><article class="comment"><p>c</p></article></section></article>') == [1, 0]
    assert label('<article><p>main</p></article><aside class="related"><article><p>t</p></article></aside>') == [1, 0]
    assert label('<main><article><p>main</p><article><p>reply</p></article></article></main><article class="comment"><p>c</p></article>') == [1, 0, 0]
