import json

import pytest
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.operators import endpoints, files, params, web
from lumenaudit.schemas import FINDING
from lumenaudit.sources.captures import conform, eligible, parse_headers


def captures(spark, *rows):
    """rows: dicts with any response fields; headers as 'Name: value' lines."""
    base = {"target": "https://t.test", "url": "https://t.test/", "status_code": 200, "content_type": "text/html", "body": "", "raw_headers": ""}
    full = [{**base, **r} for r in rows]
    names = sorted({k for r in full for k in r})
    types = {"status_code": "int", "redirected": "boolean"}
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names)
    return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))


def values(df):
    return sorted(r.value for r in df.collect())


def test_findings_have_the_fixed_schema(spark):
    d = captures(spark, {})
    for f in (web.missing_headers, web.cookie_flags, files.file_references, files.exposed_files, params.open_redirects, web.waf_detections):
        got = f(d).schema
        assert [(x.name, x.dataType) for x in got] == [(x.name, x.dataType) for x in FINDING]


def test_missing_headers_depend_on_scheme_and_policy(spark):
    d = captures(spark, {}, {"url": "http://t.test/"}, {"url": "https://t.test/c", "raw_headers": "content-SECURITY-policy: Frame-Ancestors 'none'"})
    by = {}
    for r in web.missing_headers(d).collect():
        by.setdefault(r.url, set()).add(r.value)
    assert len(by["https://t.test/"]) == 6
    assert len(by["http://t.test/"]) == 5 and not any("HSTS" in v for v in by["http://t.test/"])
    assert not any("Frame" in v or "Security-Policy" in v for v in by["https://t.test/c"])


def test_repeated_headers_and_evidence(spark):
    d = captures(spark, {"raw_headers": "Server: a\nX-Custom: 1\nserver: b\nX-Content-Type-Options: it's"})
    assert "Server: a, b" in values(web.version_banners(d))
    r = web.weak_nosniff(d).first()
    assert r.value == 'Weak X-Content-Type-Options value: "it\'s"'
    assert r.evidence == "Server: a\nserver: b\nX-Content-Type-Options: it's"


@pytest.mark.parametrize("raw,want", [
    ("sid=1", "Cookie 'sid' missing flag(s): Secure, HttpOnly, SameSite"),
    ("sid=1; secure; HTTPONLY", "Cookie 'sid' missing flag(s): SameSite"),
    ("__Secure-sid=1; HttpOnly; SameSite=Lax", None),
    ("bare", "Cookie 'bare' missing flag(s): Secure, HttpOnly, SameSite"),
])
def test_cookie_flags(spark, raw, want):
    got = values(web.cookie_flags(captures(spark, {"raw_headers": f"Set-Cookie: {raw}"})))
    assert got == ([want] if want else [])


def test_cookie_values_are_never_shown(spark):
    d = captures(spark, {"raw_headers": "Set-Cookie: incap_ses_9=LIVE; Path=/\nSet-Cookie: sid=HIDDEN=x; Path=/a=b\nSet-Cookie: csrftoken"})
    assert not any("LIVE" in r.evidence or "HIDDEN" in r.evidence
                   for f in (web.cookie_flags, web.waf_detections) for r in f(d).collect())
    some = spark.createDataFrame([("a=1; Path=/",), ("a",), ("a=b=c",), ("=x; y",)], "c string")
    assert [r[0] for r in some.select(web.redact_cookie(F.col("c"))).collect()] == ["a=<REDACTED>; Path=/", "a", "a=<REDACTED>", "=<REDACTED>; y"]


@pytest.mark.parametrize("origin,creds,want", [("*", "true", "high"), ("*", "", None), ("https://probe.invalid", "TRUE", "high"),
                                               ("https://probe.invalid", "no", "medium"), ("https://x.test", "true", None)])
def test_cors(spark, origin, creds, want):
    d = captures(spark, {"probe": "cors", "request_origin": "https://probe.invalid",
                         "raw_headers": f"Access-Control-Allow-Origin: {origin}\nAccess-Control-Allow-Credentials: {creds}"})
    assert [r.confidence for r in web.cors_issues(d).collect()] == ([want] if want else [])


def test_methods(spark):
    d = captures(spark, {"probe": "options", "raw_headers": "Allow: get, delete , PUT,TRACE, put"},
                 {"probe": "page", "raw_headers": "Allow: PUT"})
    assert values(web.risky_methods(d)) == ["Potentially risky HTTP methods enabled: DELETE, PUT, TRACE"]


def test_resources_once_per_page(spark):
    html = ('<script src="http://a.test/x.js"></script><SCRIPT async SRC = \'http://a.test/x.js\'></SCRIPT>'
            '<link rel=x href="http://b.test/y.css" integrity="sha"><script src="//rel.test/z.js"></script>'
            '<script src="https://t.test/own.js"></script><img src="http://c.test/i.png">'
            '<script integrity="q" src="https://d.test/1.js"></script><script src="https://d.test/1.js"></script>')
    d = captures(spark, {"body": html}, {"body": html, "content_type": "text/plain", "url": "https://t.test/2"})
    assert [v.rsplit(" ", 1)[1] for v in values(web.mixed_content(d))] == ["http://b.test/y.css", "http://a.test/x.js"]
    assert sorted(r.evidence for r in web.missing_sri(d).collect()) == ["http://a.test/x.js", "https://d.test/1.js"]
    assert web.mixed_content(captures(spark, {"url": "http://t.test/", "body": html})).isEmpty()


def test_technologies_and_generator(spark):
    d = captures(spark, {"raw_headers": "Server: nginx/1.2.3\nX-Powered-By: PHP\nSet-Cookie: laravel_session=1",
                         "body": '<meta name="generator" content="Site 5"><a href="/wp-content/">' + "z" * 300_000 + "react-dom"})
    got = values(web.tech_fingerprints(d))
    assert got == ["Detected: Laravel", "Detected: Nginx 1.2.3", "Detected: PHP", "Detected: React", "Detected: WordPress"]
    assert "Detected: React" not in values(web.tech_fingerprints(d, window=C.TECH_WINDOW_CHARS))
    assert all("Nginx%201.2.3" in r.context for r in web.tech_fingerprints(d).collect() if "Nginx" in r.value)
    assert values(web.meta_generators(d)) == ["Detected via meta generator tag: Site 5"]


def test_waf(spark):
    d = captures(spark, {"raw_headers": "SERVER: CloudFlare"}, {"url": "https://t.test/2", "raw_headers": "Set-Cookie: TSabc=1"},
                 {"url": "https://t.test/3", "raw_headers": "Server: other"})
    assert values(web.waf_detections(d)) == ["WAF/CDN detected: Cloudflare", "WAF/CDN detected: F5 BIG-IP ASM"]


def test_tls(spark):
    rows = [("https://a", "TLSv1.3", "Jun  1 12:00:00 2025 GMT", None), ("https://b", "TLSv1", "Jul 15 00:00:00 2025 GMT", None),
            ("https://c", "TLSv1.3", "Jul 16 00:00:00 2025 GMT", None), ("https://d", "SSLv3", "x", "bad chain"), ("https://e", "TLSv1.2", None, None),
            ("https://f", "TLSv1.2", "Jun 30 23:59:59 2025 GMT", None)]
    d = spark.createDataFrame([(t, "h", 443, p, n, v) for t, p, n, v in rows], "target string, host string, port int, protocol string, not_after string, verify_error string")
    got = {(r.url, r.value, r.confidence) for r in endpoints.tls_issues(d, "2025-07-01 00:00:00").collect()}
    assert got == {("https://a", "TLS certificate expired 30 day(s) ago", "high"), ("https://b", "Weak TLS protocol negotiated: TLSv1", "high"),
                   ("https://b", "TLS certificate expires in 14 day(s)", "medium"), ("https://d", "TLS certificate validation failed: bad chain", "high"),
                   ("https://f", "TLS certificate expired 1 day(s) ago", "high")}


def test_security_txt(spark):
    d = captures(spark, {"target": "https://none.test"},
                 {"target": "https://ok.test/", "probe": "securitytxt", "url": "https://ok.test/security.txt", "body": "Contact: x"},
                 {"target": "https://blank.test", "probe": "securitytxt", "url": "https://blank.test/security.txt", "body": "  \n"})
    got = {r.target: r.evidence for r in endpoints.security_txt_missing(d).collect()}
    assert got == {"https://none.test": "", "https://blank.test": "200 https://blank.test/security.txt"}


@pytest.mark.parametrize("schema,want", [({"q": 1}, True), ({}, False), (None, False), ("", False), ("0", True), (0, False), ([], False),
                                         ([1], True), (False, False), (True, True), ("false", True)])
def test_graphql_truth(spark, schema, want):
    d = captures(spark, {"probe": "graphql", "url": "https://t.test/graphql", "body": json.dumps({"data": {"__schema": schema}})},
                 {"probe": "graphql", "url": "https://t.test/api/graphql", "body": "{broken"})
    assert endpoints.graphql_introspection(d).count() == int(want)


@pytest.mark.parametrize("name,ctype,body,want", [
    ("config.json", "text/html", "{}", True), ("config.json", "text/html", "{broken", True), ("config.json", "", "<html>", False),
    ("x", "application/json", "nope", False), ("x", "application/json", '{"a":1,"a":2}', True), ("x", "application/json", "12", True),
    (".env", "text/html", "a\nAPP_KEY = 1", True), (".env.local", "text/plain", "app=1", False), ("config.yml", "text/html", "<p>\n  key: v", True),
    ("config.yml", "text/plain", "key:v", False), ("wp-config.php", "text/html", "<?php x", True), ("config.php", "text/plain", "rendered", False),
    (".sql", "text/html", "x insert INTO y", True), (".dump", "text/plain", "reinsert into", False), (".log", "text/plain", "any", True),
    ("error.log", "text/html", "x [2024-01-02", True), ("error.log", "text/html", "GETAWAY", False), (".xml", "", " \n<?xml", True),
    (".pem", "", "-----BEGIN X", True), ("id_rsa", "", "x", False), (".htaccess", "text/plain", "", True), (".htaccess", "text/html", "", False),
    (".git/HEAD", "text/plain", "ref", True), (".bak", "TEXT/HTML", "ref", False), (".bak", None, None, True),
])
def test_confirmation(spark, name, ctype, body, want):
    d = spark.createDataFrame([(name, ctype, body)], "n string, c string, b string")
    assert d.select(files.content_confirms(F.col("n"), F.col("c"), F.col("b"))).first()[0] is want


def test_longest_suffix_by_brute_force(spark):
    urls = [f"https://h.test/{d}x{s}{q}" for s in C.SENSITIVE_FILES for d in ("", "a/") for q in ("", "?y", ";p")] + \
           [f"https://h.test/{s.upper()}" for s in C.SENSITIVE_FILES] + ["https://h.test/plain", "https://h.test/.env/"]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    from urllib.parse import urlparse
    for r in d.select("u", files.sensitive_suffix(F.col("u")).alias("s")).collect():
        fit = [s for s in C.SENSITIVE_FILES if urlparse(r.u).path.lower().endswith(s.lower())]
        assert r.s == (max(fit, key=len) if fit else None), r.u


def test_exposed_file_limits(spark):
    d = captures(spark, {"url": "https://t.test/.env", "body": "A_B=1"}, {"url": "https://t.test/2/.env", "body": "A_B=1", "status_code": 404})
    assert values(files.exposed_files(d)) == ["Exposed .env file (5 bytes)"]
    assert files.exposed_files(d, max_bytes=4).isEmpty()


def test_references_and_listing(spark):
    d = captures(spark, {"body": "x \"a/b.sql\" 'a/b.sql' (cc.LOG) (d.sql) \"dd.txt\" \"ee.sql.gz\" \"ff.yaml", "url": "https://t.test/1"},
                 {"body": "<TITLE> Index of /x</title> [To Parent Directory]", "url": "https://t.test/2"},
                 {"body": "<title>Index of /x</title>", "url": "https://t.test/3"})
    assert values(files.file_references(d)) == ["a/b.sql", "cc.LOG", "ff.yaml"]
    assert [r.url for r in files.directory_listings(d).collect()] == ["https://t.test/2"]


def test_redirects(spark):
    def hit(url, final, strict=False, redirected=True):
        d = captures(spark, {"url": url, "final_url": final, "redirected": redirected})
        return [r.value for r in params.open_redirects(d, strict).collect()]

    off = "https://o.test/x"
    assert hit("https://t.test/?a=1&n=https://O.test", off) == ["Parameter 'n' steers redirect to external host: o.test"]
    assert hit("https://t.test/?p=zz&n=/x/", off) == ["Parameter 'n' steers redirect to external host: o.test"]
    assert hit("https://t.test/?n=https://o.test", "https://s.t.test/x") == []
    assert hit("https://t.test/?n=https://o.test", off, redirected=False) == []
    assert hit("https://t.test/?n=///", off) and not hit("https://t.test/?n=///", off, strict=True)
    assert hit("https://t.test/?n=", off) == [] and hit("https://t.test/", off) == []


def test_fetching_params(spark):
    d = captures(spark, {"url": "https://t.test/?URL=1&uri2=2&%20feed+=x&a=url"})
    assert sorted(r.evidence for r in params.ssrf_candidates(d).collect()) == ["Parameter name:  feed ", "Parameter name: URL"]


def test_headers_and_eligibility(spark):
    d = spark.createDataFrame([("A: 1\r\nB:2:3\n\nbad\nset-cookie: x\nSet-Cookie: y",)], "raw string")
    assert [(h.name, h.value) for h in d.select(parse_headers(F.col("raw"))).first()[0]] == \
        [("A", "1"), ("B", "2:3"), ("set-cookie", "x"), ("Set-Cookie", "y")]
    c = captures(spark, {"content_type": "Application/JSON; x"}, {"content_type": "image/png"}, {"status_code": 500}, {"content_type": None})
    assert eligible(c).count() == 1 and eligible(c, max_bytes=-1).count() == 0
