"""Nothing is cut off: long values, bodies, paths, pages and names."""

import re

from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.operators import files, findings, secrets, soft404, web
from lumenaudit.sources.captures import conform, eligible


def test_long_secrets_stay_apart(spark):
    head = "eyJ" + "hbGciOi" * 20 + "." + "eyJzdWIi" * 20 + "."
    text = f"one {head}{'a1B2' * 8} two {head}{'c3D4' * 8} one {head}{'a1B2' * 8}"
    d = spark.createDataFrame([("t", "u", text)], "target string, url string, text string")
    got = findings.deduplicate(findings.enrich(secrets.secret_findings(d))).collect()
    assert sorted(r.value[-4:] for r in got if r.category == "tokens") == ["a1B2", "c3D4"]


def test_large_bodies(spark):
    big = "KEY=value\n" * 1_150_000
    rows = [("https://t.test", "https://t.test/.env", "page", 200, "text/plain", big)]
    d = conform(spark.createDataFrame(rows, "target string, url string, probe string, status_code int, content_type string, body string"))
    assert d.first().body_bytes > 11_000_000
    assert eligible(d).count() == 1 and eligible(d, 10_000_000).count() == 0
    assert files.exposed_files(d).count() == 1 and files.exposed_files(d, max_bytes=5_000_000).count() == 0


def test_long_paths(spark):
    path = "a/" * 200 + "dump.sql"
    d = spark.createDataFrame([("t", "u", f'see "{path}" here')], "target string, url string, body string")
    assert [r.value for r in files.file_references(d).collect()] == [path]


def test_pages_that_differ_late(spark):
    shell = "<html>" + "same words " * 600
    rows = [("t", "t/a", "page", 200, shell + "real token"), ("t", "t/b", "page", 200, shell + "gone 17"), ("t", "t/z", "baseline", 200, shell + "gone 4")]
    d = conform(spark.createDataFrame(rows, "target string, url string, probe string, status_code int, body string"))
    got = soft404.exact_matches(d.filter("probe = 'page'"), soft404.baseline_signatures(d))
    assert [r.url for r in got.collect()] == ["t/b"]


def test_long_names_pass_the_gate(spark):
    name = "internal_service_account_credential_for_api"
    det = C.Detector("tokens", rf"(?i){name}\s*=\s*([a-z0-9]+)", 1, "high", heads=(name,))
    d = spark.createDataFrame([("u", "x " * 50 + name.upper() + " " * 30 + "= abc123 and " + name + "=z9")], "url string, text string")
    got = [[r.value for r in secrets.secret_matches(d, detectors=(det,), gate=g).collect()] for g in (True, False)]
    assert got[0] == got[1] == ["abc123", "z9"]


def test_many_resources(spark):
    tags = [f'<script src="https://cdn{i % 700}.test/x.js"></script>' for i in range(4000)] + ['<SCRIPT SRC="https://cdn3.test/x.js" integrity="s"></script>']
    d = spark.createDataFrame([("https://t.test", "https://t.test/", 200, "text/html", "".join(tags))],
                              "target string, url string, status_code int, content_type string, body string")
    got = web.missing_sri(conform(d)).select("evidence", "match_ord").collect()
    seen = list(dict.fromkeys(re.findall(r'src="([^"]+)"', "".join(tags))))
    assert {r.evidence for r in got} == set(seen) and len(got) == 700
