"""Exact matches with as many baselines as pages."""

from lumenaudit.functions.skew import hot_join
from lumenaudit.operators import soft404
from lumenaudit.registry.queries import QUERIES
from lumenaudit.sources.captures import conform
from pyspark.sql import functions as F


def test_every_document_is_a_baseline(spark, tmp_path):
    """Equal documents that are neither short nor the longest of their source are found."""
    long = "words that go on " * 100
    rows = [(1, "en", "a", long + "7"), (2, "en", "a", long + " 19"), (3, "en", "a", long * 3), (4, "en", "b", long + "same 2"), (5, "de", "a", long + "7"),
            (6, "en", "b", long + "same  31"), (7, "en", "b", long * 4), (8, "en", "a", "short"), (9, "en", "b", ""), (10, "en", "b", None), (11, "de", "b", "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for other, shape in (("conversations", "conv_id bigint, turn bigint, role string, text string"), ("pages", "page_id bigint, url string, html string")):
        spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/{other}.parquet")
    got = {(r.target, r.url): r.n_baselines for r in QUERIES["soft404_exact"](spark, str(tmp_path)).collect()}
    assert got == {("en", "1"): 2, ("en", "2"): 2, ("en", "3"): 1, ("en", "4"): 2, ("de", "5"): 1, ("en", "6"): 2, ("en", "7"): 1, ("en", "8"): 1, ("de", "11"): 1}


def test_pages_without_a_baseline_are_left_out(spark):
    rows = [("t", f"u{i}", "page" if i % 3 else "baseline", 200 if i % 5 else None, f"{'abcd'[i % 4]} {i}") for i in range(60)] + [("o", "u1", "page", 200, "a 1")]
    d = conform(spark.createDataFrame(rows, "target string, url string, probe string, status_code int, body string"))
    got = {(r.target, r.url): r.n_baselines for r in soft404.exact_matches(d.filter("probe = 'page'"), soft404.baseline_signatures(d), counted=True).collect()}
    known = [(t, s, b[0]) for t, _, p, s, b in rows if p == "baseline"]
    want = {(t, u): known.count((t, s, b[0])) for t, u, p, s, b in rows if p == "page" and s is not None and (t, s, b[0]) in known}
    assert got == want and want


def test_hot_keys_join_as_others(spark):
    left = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (3, "y"), (9, "z")], "k bigint, v string")
    plain = sorted(map(tuple, left.join(right, "k").select("k", "id", "v").collect()))
    assert sorted(map(tuple, hot_join(left, right, ["k"], "inner", F.col("id"), hot=50).select("k", "id", "v").collect())) == plain
