import html
import math
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import text as X
from model import entropy

SAMPLES = [
    "", " ", "plain", "  both \t", " nbsp ", "\u001cfs\u001f", "a\u0085", "\r\nline\r\n", "tab\tin",
    "quote'single", 'quote"double', "both'\"", "back\\slash", "new\nline", "<a href='x'>&amp;</a>",
    "päss wörd/~*+?&=%41", "\U0001f511key\U0001f511", "aab", "abcdefgh", "aaaa", "٣٤", "x" * 300,
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(s,) for s in SAMPLES], "t string")


def column(frame, c):
    return [r[1] for r in frame.select("t", c).collect()]


def test_strip_like_python(frame):
    assert column(frame, X.strip(F.col("t"))) == [s.strip() for s in SAMPLES]


def test_quote_like_python(frame):
    assert column(frame, X.percent_quote(F.col("t"))) == [quote(s) for s in SAMPLES]


def test_escape_like_python(frame):
    assert column(frame, X.html_escape(F.col("t"))) == [html.escape(s) for s in SAMPLES]


def test_repr_like_python(spark):
    some = ["plain", "it's", 'say "x"', "both'\"", "back\\", "new\nline", "tab\t", "cr\r"]
    d = spark.createDataFrame([(s,) for s in some], "t string")
    assert column(d, X.python_repr(F.col("t"))) == [repr(s) for s in some]


def test_entropy_like_python(frame):
    for got, s in zip(column(frame, X.entropy(F.col("t"))), SAMPLES):
        assert math.isclose(got, entropy(s), abs_tol=1e-12)


@pytest.mark.parametrize("pattern", [
    r"a\s*b", r"[^\s]+", r"\d+", r"\bkey\b", r"(?i)pass", r"(?i)token", r"x.y", r"end$", r"\S\s\S", r"[\s,]+z",
])
def test_patterns_like_python(spark, pattern):
    texts = ["a b", "a\u001cb", "a b", "a b", "x\u0085y", "x\ry", "x\ny", "٣", "paſs", "toKen", "key",
             "ékey", "end\n", "end\r", "end", "q\u001fz", "a　b", "", ",  z"]
    d = spark.createDataFrame([(s,) for s in texts], "t string")
    got = column(d, F.regexp_extract_all("t", F.lit(X.java_pattern(pattern)), F.lit(0)))
    assert got == [[m.group(0) for m in re.finditer(pattern, s)] for s in texts]


def test_sql_text_round_trip(spark):
    for s in SAMPLES + ["a\\'b", "{braces}", "uni sep"]:
        assert spark.sql(f"SELECT {X.sql_text(s)} AS v").first().v == s


def test_bind_evaluates_to_the_expression(frame):
    got = column(frame, X.bind(F.length("t"), lambda n: n + n))
    assert got == [2 * len(s) for s in SAMPLES]
