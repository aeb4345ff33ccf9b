"""Rules, alias forms and block propagation on written cases."""

from pyspark.sql import functions as F

from creditlake.llm import url_filter as uf

CANON = '<html><head><link rel="canonical" href="{}"></head></html>'
REFRESH = '<meta http-equiv="refresh" content="0; url={}">'
PAGES = [
    (1, "https://www.a.example.com/de/1?utm_source=x", None),          # rule blocks
    (2, "http://q.example.com/en/1", CANON.format("http://a.example.com/de/1.html")),   # blocked alias
    (3, "http://r.example.com/en/2", REFRESH.format("//q.example.com/en/1/")),          # two links away
    (4, "http://s.example.org/fr/1", CANON.format("http://r.example.com/en/9")),        # rule allows
    (5, "http://r.example.com/en/9", CANON.format("http://b.example.com/de/1")),        # allowed: allow in component
    (6, "http://b.example.com/de/1", ""),                              # own block stands
    (7, None, "<p>"), (8, "no scheme/en/", CANON.format("http://a.example.com/de/1")), (9, "", None),
    (10, "HTTP://X.Example.NET/en/5", None), (11, "https://x.net", None), (12, "https://x.net/", None),
    (13, "https://notexample.com/de/1", None), (14, "http://t.example.com/en/x", CANON.format("/de/7")),
    (15, "http://t.example.com/de/7/", None), (2, "http://q.example.com/en/1", CANON.format("http://a.example.com/de/1.html")),
    (16, "http://m.q.example.com/en/1#f", None),                       # spelling of page 2
]
WANT = {1: ("example.com/de/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("org/fr/", "allow"), 5: (None, "allow"),
        6: ("example.com/de/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"),
        10: ("example.net/en/", "allow"), 11: (None, "block"), 12: ("net/", "block"), 13: (None, "allow"),
        14: (None, "block"), 15: ("example.com/de/", "block"), 16: (None, "block")}


def test_verdicts(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rows = uf.judge(df).collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == WANT
    host = {r.page_id: (r.host, r.path) for r in rows}
    assert host[10] == ("x.example.net", "/en/5") and host[7] == host[8] == ("", "") and host[11] == ("x.net", "")
    assert uf.judge(df.limit(0)).count() == 0


def test_alias(spark):
    forms = ["http://www.x.com/a/?utm_source=f&b=2&a=1#t", "https://x.com/a.html?a=1&b=2", "https://m.x.com:443/a/index.html?ref=1&a=1&b=2"]
    df = spark.createDataFrame([(f,) for f in forms], "u string").select(uf.alias(F.col("u")).alias("a"))
    assert {r.a for r in df.collect()} == {"x.com/a?a=1&b=2"}


def test_targets_that_are_no_pages(spark):
    pages = [
        (1, "http://a.example.org/1", REFRESH.format("http://x.foo.net/")),         # blocked by a target that was not crawled
        (2, "http://a.example.org/2", CANON.format("http://y.foo.net/2")),          # as above, but another target is allowed
        (3, "http://b.example.org/3", CANON.format("http://y.foo.net/2")),
        (4, "http://b.example.org/3", REFRESH.format("http://z.example.net/en/1")),
        (5, "http://c.example.com/a/b/c.html", CANON.format("../../de/5")),         # dots, query-only and references
        (6, "http://c.example.com/a/6", CANON.format("./x/./../../de/6?q=1#f")),
        (7, "http://d.example.org/p", CANON.format("?a=1&amp;b=2")),
        (8, "http://d.example.org/p?b=2&a=1", REFRESH.format("http&#58;//w.foo&period;net/&#x38;")),
        (9, "http://e.example.org/9", REFRESH.format("/go?u=http://x.foo.net/")),   # a url inside a parameter is no target
        (10, "http://f.example.org/1?a=1&copy=2", None), (11, "http://f.example.org/11", CANON.format("/1?a=1&copy=2")),
        (12, "http://f.example.org/1?a=1&copy=2", REFRESH.format("http://x.foo.net/12")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge(df).collect()}
    blocked = {1, 5, 6, 7, 8, 10, 11, 12}
    assert got == {i: (None, "block" if i in blocked else "allow") for i, _, _ in pages}


def test_decoded_as_html_does(spark):
    import html
    values = ["a&amp;b", "&#38;&#x26;&#X1F600;", "&eacute;&unknown;", "x&amp", "&lt;&amp;lt;", "&", "", "&#0;", "&#99999999;"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", uf.decoded(F.col("v")).alias("d"))
    for r in df.collect():
        assert r.d == html.unescape(r.v), r
