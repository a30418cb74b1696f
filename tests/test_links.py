"""Links of odd pages, and time linear in their size."""

import time

import pytest

from lumenaudit.operators import discovery

TARGET = "https://a.test"


def links(spark, *bodies):
    pages = spark.createDataFrame([(TARGET, f"{TARGET}/d/p", b) for b in bodies], "target string, url string, body string")
    return sorted(r.dst.removeprefix(TARGET) for r in discovery.links(pages).collect())


@pytest.mark.parametrize("tag, expected", [
    ("<a title=\"<b > c\" href=\"/x\">", ["/x"]),
    ("<A HREF=/x class=y>", ["/x"]),
    ("<a href = '/x'>", ["/x"]),
    ("<a href=\n\"/x\n\">", ["/x"]),
    ("<a class=\"y\"href=\"/x\">", ["/x"]),
    ("<a \"stray\" href=/x>", ["/x"]),
    ("<a/href=/x>", ["/x"]),
    ("<a href=\"/x>y\">", ["/x>y"]),
    ("<a href=\"/x\" href=\"/y\">", ["/x"]),
    ("<a hreflang=en href=/x>", ["/x"]),
    ("<a title='a href=\"/no\"' name=b>", []),
    ("<a data-href=\"/no\"><a-b href=\"/no\"><div href=\"/no\"><abbr href=\"/no\">", []),
    ("<a href=\"\"><a href><a href=><a href=\"/no", []),
    ("<link rel=x href='./x'>", ["/d/x"]),
    ("<script\n src\n = \"/x\"></script>", ["/x"]),
    ("<img alt=\"\" src=/x><iframe src=/y></iframe>", ["/x", "/y"]),
    ("<form method=post action=\"/x?y=1\">", ["/x?y=1"]),
    ("<img href=/no><form src=/no><a action=/no src=/no>", []),
    ("", []),
])
def test_tags(spark, tag, expected):
    assert links(spark, tag) == expected
    assert links(spark, f"<p>{tag}</p><a href='/z'>") == sorted([*expected, "/z"]) or tag.endswith("\"/no")


def test_no_body(spark):
    assert links(spark, None) == []


@pytest.mark.parametrize("part", ["<a ", "<a href", "<img <a src=", "\"<a ", "<a \"'", "<a x=\"", "<form action "])
def test_linear(spark, part):
    """A megabyte of tags that are never closed."""
    links(spark, part * 1000)
    began = time.time()
    links(spark, part * (1_000_000 // len(part)) + "><a href=/x>")
    assert time.time() - began < 20
