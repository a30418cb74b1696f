from itertools import product
from urllib.parse import parse_qsl, urljoin, urlparse

from pyspark.sql import functions as F

from lumenaudit.functions import urls as U

BASES = ["https://h.test", "https://h.test/", "http://h.test/a/b", "https://h.test/a/b/?q=1", "https://H.test:8443/x.html#top",
         "https://u:p@h.test/a;p/b"]
HREFS = ["/x", "/x/", "/x/y.html?a=1", "//o.test/z", "https://o.test", "https://o.test/p?q", "HTTP://o.test/x", "y", "./y", "../y",
         "../../y/../z", "?n=1", "x y", "/a b", "/.well-known/x", "/a//b", "/a/./b", "/é", "a;p", "http:rel", "/x?y&amp;z", "/x?",
         "/p#f", "https://o.test/p#f", "", "mailto:a@b", "/a/..", "&amp;q"]


def test_resolve_like_the_standard_library(spark):
    import html
    pairs = list(product(BASES, HREFS))
    d = spark.createDataFrame(pairs, "b string, h string").repartition(3)
    one = {(r.b, r.h): r.u for r in d.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("u")).collect()}
    kept = {(r.b, r.h): r.u for r in d.select("b", "h", U.resolve(F.col("b"), F.col("h"), keep_fragment=True).alias("u")).collect()}
    for b, h in pairs:
        want = urljoin(b, html.unescape(h).strip())
        assert kept[b, h] == want, (b, h)
        assert one[b, h] == want.split("#")[0], (b, h)


def test_resolve_all_is_resolve_of_each(spark):
    d = spark.createDataFrame([(b, HREFS) for b in BASES] + [("https://e.test", [])], "b string, hs array<string>")
    for r in d.select("b", "hs", U.resolve_all(F.col("b"), F.col("hs")).alias("us")).collect():
        import html
        assert sorted(r.us) == sorted(urljoin(r.b, html.unescape(h).strip()).split("#")[0] for h in r.hs)


def test_query_pairs_like_the_standard_library(spark):
    urls = ["http://h/?a=1&b=2", "http://h/?a=&b", "http://h/?a=1&a=2&a", "http://h/?a+b=c%20d&%zz=%41", "http://h/p",
            "http://h/?&&x=1&", "http://h/?a==b=c#f?x=1", "http://h/?k=%C3%A9&p=100%", "a b?x=1"]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    for blank in (True, False):
        for r in d.select("u", U.query_pairs(F.col("u"), blank).alias("p")).collect():
            want = parse_qsl(urlparse(r.u).query, keep_blank_values=blank)
            assert [(p.key, p.value) for p in r.p] == want, r.u


def test_parts_like_the_standard_library(spark):
    urls = ["http://Host:80/a/b;p?q#f", "https://h", "h/p", "//h/p", "http://h/a b", "http://u@h:1/x;y/z;w", "mailto:x", "http://h?x/y"]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in d.select("u", U.scheme(F.col("u")).alias("s"), U.authority(F.col("u")).alias("a"), U.path(F.col("u")).alias("p"),
                      U.query(F.col("u")).alias("q"), U.host(F.col("u")).alias("h")).collect():
        w = urlparse(r.u)
        assert (r.s, r.a, r.p, r.q, r.h) == (w.scheme, w.netloc.lower(), w.path if w.scheme != "mailto" else r.p, w.query,
                                             w.hostname or ""), r.u


def test_scope(spark):
    rows = [("https://www.a.test/x", "https://a.test", True), ("https://s.a.test", "https://www.a.test", True),
            ("https://bada.test", "https://a.test", False), ("https://a.test:8443", "https://a.test", False),
            ("https://A.TEST", "https://a.test", True), ("/rel", "https://a.test", False)]
    d = spark.createDataFrame(rows, "u string, t string, want boolean")
    assert all(r.want == r.got for r in d.withColumn("got", U.in_scope(F.col("u"), F.col("t"))).collect())
