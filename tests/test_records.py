"""One read of the bodies; findings as the checks give them one by one."""

import re

from pyspark.sql import functions as F

from lumenaudit.operators import endpoints, soft404
from lumenaudit.operators.findings import deduplicate, enrich, union_findings
from lumenaudit.plans import scan
from lumenaudit.registry.planted import view
from lumenaudit.schemas import FINDING_COLUMNS, detect
from lumenaudit.session import written
from lumenaudit.sources.captures import conform, eligible
from lumenaudit.operators.secrets import secret_findings


def captures(spark, sf):
    parts = ["captures", "file_captures", "catch_all_pages", "redirects", "endpoint_probes", "baselines"]
    return written(union_findings(*[conform(view(spark, sf, p)) for p in parts]), "test-captures")


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet .*?ReadSchema: struct<(.*)", plan)


def test_bodies_are_read_once(spark, sf):
    """One scan, no shuffle, for the records; none with bodies for all the rest."""
    for key, value in (("spark.sql.debug.maxToStringFields", "1000"), ("spark.sql.maxMetadataStringLength", "10000")):
        spark.conf.set(key, value)
    made = scan.capture_records(captures(spark, sf))
    assert [("body:" in s) for s in scans(made)] == [True]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    found = scan.scan_records(written(made, "test-records"))
    assert len(scans(found)) > 1 and not any("body:string" in s for s in scans(found))


def test_same_as_the_checks_apart(spark, sf):
    d = captures(spark, sf)
    pages = d.filter(scan.is_page())
    alone = union_findings(detect(d, *scan.capture_checks()), secret_findings(eligible(pages), "body"))
    soft = soft404.soft404_pages(pages.filter("status_code = 200"), soft404.baseline_signatures(d))
    alone = soft404.drop_soft404(alone, soft, (F.col("stage_ord") == scan.STAGE_CRAWL) & (F.col("category") != "open_redirect"))
    alone = union_findings(alone, endpoints.security_txt_missing(d), endpoints.graphql_introspection(d))
    expected = deduplicate(enrich(alone)).select(*FINDING_COLUMNS).collect()
    found = scan.scan_captures(d).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, expected)) and len(found) > 300


def test_odd_captures(spark):
    """No body, no status, no type, the same row twice, and none at all."""
    kind = "target string, url string, probe string, status_code int, body string, content_type string"
    rows = [("https://t.test", "https://t.test/a", p, s, b, c) for p in ("page", "root", "baseline", "securitytxt", "graphql", "cors", "options", "other")
            for s, b, c in ((None, None, None), (200, None, "text/html"), (200, "", "text/html"), (404, "x", None))]
    d = conform(spark.createDataFrame(rows + rows, kind))
    records = scan.capture_records(d)
    assert records.filter("capture is not null").count() == 2 * len(rows) and records.filter("secret is not null").isEmpty()
    found = scan.scan_captures(d)
    assert found.filter("category = 'security_txt_missing'").count() == 1
    assert found.count() == found.select("target", "url", "category", "value").distinct().count()
    assert scan.scan_captures(conform(spark.createDataFrame([], kind))).isEmpty()
