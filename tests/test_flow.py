"""Joins, crawl, recon, probes, findings, reports and streams."""

import csv
import difflib
import glob
import html
import json
import random

import pytest
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.functions.skew import first_per_key, salted_join
from lumenaudit.operators import discovery, probes, recon, secrets, soft404
from lumenaudit.operators import findings as O
from lumenaudit.plans.scan import scan_captures, scan_corpus
from lumenaudit.registry.planted import view
from lumenaudit.schemas import FINDING
from lumenaudit.sources import reports
from lumenaudit.sources.captures import conform, read_captures, read_words, stream_captures
from lumenaudit.streaming import streams


# --- skew helpers -------------------------------------------------------------

def test_salted_join_and_ranking_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(600)]
    d = spark.createDataFrame(rows, "k string, v int")
    r = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, w int")
    want = sorted((k, v, dict(hot=1, k0=2)[k]) for k, v in rows if k in ("hot", "k0"))
    assert sorted(map(tuple, salted_join(d, r, ["k"], "inner", F.col("v")).collect())) == want
    got = first_per_key(d, ["k"], [F.col("v")], 5, F.col("v")).collect()
    by = {}
    for k, v in sorted(rows, key=lambda x: x[1]):
        by.setdefault(k, []).append(v)
    assert sorted(map(tuple, got)) == sorted((k, v) for k, vs in by.items() for v in vs[:5])


# --- soft 404 -----------------------------------------------------------------

def test_soft404_by_brute_force(spark):
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "lost", "page", "12", "345", "<p>", "</p>"]
    base = [("t1", 200, " ".join(rnd.choices(words, k=n))) for n in (5, 40, 120, 400)] + [("t2", 404, "gone 1")]
    pages = []
    for i in range(160):
        t, s, b = rnd.choice(base)
        kind = i % 4
        if kind == 0:
            b = b.replace("1", "99")
        elif kind == 1:
            b = b[: len(b) // 2] + f"x{i}" + b[len(b) // 2:]
        elif kind == 2:
            b = " ".join(rnd.choices(words, k=rnd.choice((5, 40, 130))))
        pages.append((t, f"u{i}", s if i % 11 else 200, b))
    pd_ = conform(spark.createDataFrame(pages, "target string, url string, status_code int, body string"))
    bd = conform(spark.createDataFrame([(t, "b", "baseline", s, b) for t, s, b in base],
                                       "target string, url string, probe string, status_code int, body string"))
    import hashlib
    import re

    def fp(x):
        return hashlib.md5(re.sub(r"\s+", " ", re.sub(r"\d+", "#", x[:4000])).strip().encode()).hexdigest()

    def near(a, b):
        close = abs(len(a.encode()) - len(b.encode())) <= max(32, int(len(b.encode()) * 0.15))
        return close and difflib.SequenceMatcher(None, a[:1000], b[:1000]).ratio() >= 0.9

    exact = {u for t, u, s, b in pages if any((t, s, fp(b)) == (bt, bs, fp(bb)) for bt, bs, bb in base)}
    similar = {u for t, u, s, b in pages if any((t, s) == (bt, bs) and near(b, bb) for bt, bs, bb in base)}
    sig = soft404.baseline_signatures(bd)
    assert {r.url for r in soft404.exact_matches(pd_, sig).collect()} == exact and exact
    assert {r.url for r in soft404.similar_matches(pd_, sig).collect()} == similar and similar - exact
    assert {r.url for r in soft404.soft404_pages(pd_, sig).collect()} == exact | similar


def test_length_classes_cover_the_window(spark):
    d = spark.range(0, 40000, 7).select(F.col("id").alias("b"))
    slack = F.greatest(F.lit(32), F.floor(F.col("b") * 0.15)).cast("long")
    lo, hi = soft404._bucket(F.greatest(F.col("b") - slack, F.lit(0))), soft404._bucket(F.col("b") + slack)
    mid = soft404._bucket(F.col("b"))
    r = d.select(F.bool_and((lo <= mid) & (mid <= hi)).alias("ok"), F.max(hi - lo).alias("w")).first()
    assert r.ok and r.w <= 5


# --- discovery ----------------------------------------------------------------

def test_links_of_six_kinds(spark):
    body = ('<a href="/a">1</a><A class="x" HREF=\'b\'>2</A><a href=c>3</a><link href="https://s.t.test/l"><script src="/s.js"></script>'
            '<img src="i.png"><form action="/f?x=1&amp;y=2"><iframe src="//t.test/fr"></iframe><a href="#x"><a href="mailto:a@b"><a href="tel:1">'
            '<a href="javascript:x"><a href="data:x"><a href=""><a href="https://other.test/"><a name="/n"><div href="/no"><a href="/a#frag">'
            '<abbr href="/no2"><a href="../up"><a href="ftp://t.test/x">')
    d = spark.createDataFrame([("https://t.test", "https://t.test/d/p", body)], "target string, url string, body string")
    assert sorted(r.dst for r in discovery.links(d).collect()) == sorted(
        ["https://t.test/a", "https://t.test/d/b", "https://t.test/d/c", "https://s.t.test/l", "https://t.test/s.js",
         "https://t.test/d/i.png", "https://t.test/f?x=1&y=2", "https://t.test/fr", "https://t.test/up"])


def test_robots_and_sitemaps(spark):
    rows = [("https://t.test/", "https://t.test/robots.txt", 200, "User-agent: *\r\nDISALLOW: /x \nAllow: /\nallow:\nSitemap: https://o.test/s.xml\nDisallow: rel/../y\n# Allow: /c"),
            ("https://t.test/", "https://t.test/sitemap.xml", 200, "<loc>\n https://t.test/1 </loc><LOC>https://www.t.test/2</LOC><loc>https://o.test/3</loc><loc>/4</loc>")]
    d = spark.createDataFrame(rows, "target string, url string, status_code int, body string")
    assert {r.url for r in discovery.robots_paths(d).collect()} == {"https://t.test/x", "https://o.test/s.xml", "https://t.test/y"}
    assert {r.url for r in discovery.sitemap_locs(d).collect()} == {"https://t.test/1", "https://www.t.test/2"}


def test_candidates_forward_and_backward_agree(spark, tmp_path):
    (tmp_path / "w.txt").write_text("admin\n\n# no\n  api/v1 \nbackup.zip\n/lead\n.git/config\na..b\n")
    words = read_words(spark, str(tmp_path / "w.txt"))
    listed = [r.word for r in words.collect()]
    assert listed == ["admin", "api/v1", "backup.zip", "/lead", ".git/config", "a..b"]
    t = spark.createDataFrame([("https://t.test/",), ("https://u.test/sub",)], "target string")
    cand = discovery.candidate_urls(t, listed)
    urls = {r.url for r in cand.collect()}
    assert len(urls) == 2 * (4 * 20 + 2) and "https://u.test/sub/lead.tar.gz" in urls and "https://t.test/.git/config" in urls
    noise = [("https://t.test/", u) for u in ("https://t.test/zzz", "https://t.test/", "https://t.test/backup.zip/", "https://t.test/admin.exe")]
    caps = cand.unionByName(spark.createDataFrame(noise, "target string, url string"))
    assert {r.url for r in discovery.candidate_hits(caps, words).collect()} == urls


def test_common_seeds(spark):
    t = spark.createDataFrame([("https://t.test/base/",)], "target string")
    got = {r.url for r in discovery.common_seeds(t).collect()}
    assert {"https://t.test/base", "https://t.test/base/", "https://t.test/", "https://t.test/.env"} <= got
    assert len(got) == len(C.COMMON_PATHS) + 2


@pytest.mark.parametrize("budget", [3, 9, 10_000])
def test_crawl_by_brute_force(spark, budget):
    rnd = random.Random(budget)
    edges = {(t, f"p{rnd.randrange(25):02d}", f"p{rnd.randrange(25):02d}") for t in ("a", "b") for _ in range(60)}
    seeds = [("a", "p01", 0), ("a", "p07", 1), ("b", "p02", 0), ("b", "p09", 1), ("b", "p00", 1)]
    want = {}
    for t in ("a", "b"):
        level = [u for _, _, u in sorted((p, u, u) for x, u, p in seeds if x == t)][:budget]
        seen = {u: 0 for u in level}
        for depth in (1, 2, 3):
            found = sorted({d for x, s, d in edges if x == t and s in level} - set(seen))
            level = found[: budget - len(seen)]
            seen.update({u: depth for u in level})
        want.update({(t, u): d for u, d in seen.items()})
    got = discovery.crawl(spark.createDataFrame(seeds, "target string, url string, priority int"),
                          spark.createDataFrame(sorted(edges), "target string, src string, dst string"), 3, budget)
    assert {(r.target, r.url): r.depth for r in got.collect()} == want


# --- recon --------------------------------------------------------------------

def test_certificate_names(spark):
    ct = spark.createDataFrame([("e.test", "*.A.e.test\n e.test\nbade.test\nother.test\n*.*.b.e.test"), ("w.test", "x.w.test")], "domain string, name_value string")
    dns = spark.createDataFrame([("w.test", "zz.w.test", True, True), ("e.test", "zz.e.test", False, True)], "domain string, host string, resolves boolean, is_canary boolean")
    got = {r.evidence: r.value for r in recon.ct_subdomains(ct, dns).collect()}
    assert set(got) == {"a.e.test", "bade.test", "b.e.test", "x.w.test"}
    assert "wildcard" in got["x.w.test"] and "wildcard" not in got["a.e.test"]
    assert {r.evidence for r in recon.ct_subdomains(ct, strict=True).collect()} == {"a.e.test", "b.e.test", "x.w.test"}


def test_ports(spark):
    rows = [("h", 22, True, False, "\n SSH-2.0 x \nmore"), ("h", 80, True, False, "HTTP/1.0 200\r\nserver :no\r\nSERVER: n/1: 2 \r\n"), ("h", 9999, True, False, None),
            ("h", 3306, True, False, None), ("h", 21, False, False, None), ("h", 50000, False, True, None), ("bad", 22, True, False, "x"), ("bad", 50001, True, True, None)]
    d = spark.createDataFrame(rows, "host string, port int, open boolean, is_canary boolean, banner_raw string")
    got = {r.value: (r.confidence, r.informational) for r in recon.open_ports(d).collect()}
    assert got == {"Open port 22 (SSH) - banner: SSH-2.0 x": ("low", False), "Open port 80 (HTTP) - banner: n/1: 2": ("low", True),
                   "Open port 3306 (MySQL)": ("medium", False), "Open port 9999 (unknown)": ("low", False)}
    assert "Open port 9999 (unknown)" in {r.value for r in recon.open_ports(d, only=[9999]).collect()}
    assert [r.url for r in recon.unreliable_hosts(d).collect()] == ["bad"]
    assert recon.parse_ports("80, 443,") == [80, 443] and recon.parse_ports("") is None
    with pytest.raises(ValueError):
        recon.parse_ports("80,x")


# --- recorded probes ----------------------------------------------------------

def probe(spark, *rows):
    base = dict(target="t", url="u", test_url="u1", param_index=0, param="page", original="", check="", attempt=0, payload="", a=13, b=17, status_code=200,
                body="", baseline_body="")
    from lumenaudit.schemas import PROBE_RESULT
    names = [c.split()[0] for c in PROBE_RESULT.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], PROBE_RESULT)


def test_probe_triage(spark):
    assert probes.reflections(probe(spark, dict(check="xss", payload="<m1>", body="a<m1>b"), dict(check="xss", payload="<m2>", body="&lt;m2&gt;"))).count() == 1
    e = probes.database_errors(probe(spark, dict(check="sqli", payload="1'", body="x ORA-00933 and SQLSTATE[HY000]"),
                                     dict(check="sqli", payload="1'", body="ORA-1234"), dict(check="sqli", body="ora-00001", baseline_body="ORA-99999"))).collect()
    assert [r.evidence for r in e] == ["Injected payload: \"1'\"\nMatched DB error signature: 'SQLSTATE[HY000]'"]
    f = probe(spark, dict(check="traversal", body="root:x:0:0:"), dict(check="traversal", param="q", body="root:x:0:0:"), dict(check="traversal", body="root::0"))
    assert probes.file_disclosures(f).count() == 1


@pytest.mark.parametrize("row,want", [
    (dict(body="= 221."), 1), (dict(body="1221"), 0), (dict(body="2210"), 0), (dict(body="x221y"), 1), (dict(body="1221 221"), 1),
    (dict(body="221", baseline_body="was 221"), 0), (dict(body="221", baseline_body="12210"), 1), (dict(body="221", original="a13"), 0),
    (dict(body="221", original="17"), 0), (dict(body="none"), 0),
])
def test_template_evaluation(spark, row, want):
    assert probes.template_evaluations(probe(spark, dict(check="ssti", **row))).count() == want


def test_first_template_attempt_wins(spark):
    d = probe(spark, dict(check="ssti", attempt=2, payload="c", body="221"), dict(check="ssti", attempt=1, payload="b", body="221"), dict(check="ssti", payload="a", body=""))
    assert [r.context for r in probes.template_evaluations(d).collect()] == ["Injected: b"]


# --- findings -----------------------------------------------------------------

def found(spark, *rows):
    base = dict(target="t", url="u", value="v", confidence="high", informational=False, stage_ord=0, detector_ord=0, match_ord=0)
    return spark.createDataFrame([tuple({**base, **r}.get(f.name) for f in FINDING) for r in rows], FINDING)


def test_enrichment_defaults_and_own_values(spark):
    d = found(spark, dict(category="api_keys"), dict(category="new"), dict(category="api_keys", cwe_id="CWE-1", remediation="mine"))
    got = [(r.cwe_id, r.remediation) for r in O.enrich(d).collect()]
    assert got[0][0] == "CWE-798" and got[0][1] and got[1] == ("CWE-200", "") and got[2] == ("CWE-1", "mine")


def test_first_finding_wins(spark):
    d = found(spark, dict(category="a", detector_ord=2, confidence="low"), dict(category="a", detector_ord=1, confidence="high"),
              dict(category="a", stage_ord=1, confidence="medium"), dict(category="a", url="u2"), dict(category="a", value="w" * 200 + "1"),
              dict(category="a", value="w" * 200 + "2"))
    got = O.deduplicate(d.repartition(5)).collect()
    assert sorted((r.url, r.value[0], r.confidence) for r in got) == [
        ("u", "v", "high"), ("u", "w", "high"), ("u", "w", "high"), ("u2", "v", "high")]
    assert [r.detector_ord for r in got if (r.url, r.value) == ("u", "v")] == [1]


@pytest.mark.parametrize("rows,want", [
    ([], "NONE"), ([dict(category="open_port", informational=True)], "NONE"), ([dict(category="security_headers", confidence="medium")], "LOW"),
    ([dict(category="emails", confidence="low")], "LOW"), ([dict(category="internal_ips", confidence="low")], "LOW"),
    ([dict(category="api_keys", confidence="low")], "MEDIUM"), ([dict(category="api_keys")] * 2, "HIGH"), ([dict(category="api_keys")] * 3, "CRITICAL"),
    ([dict(category="emails", confidence="low")] * 100, "LOW"), ([dict(category="emails")] * 3, "MEDIUM"),
    ([dict(category="open_port")] * 3, "HIGH"), ([dict(category="tokens", confidence="odd")], "MEDIUM"), ([dict(category="tokens", confidence=None)], "MEDIUM"),
    ([dict(category="unknown", confidence="high")] * 2, "LOW"),
])
def test_verdicts(spark, rows, want):
    targets = spark.createDataFrame([("t",), ("empty",)], "target string")
    d = found(spark, *[dict(r, value=str(i)) for i, r in enumerate(rows)]) if rows else spark.createDataFrame([], FINDING)
    got = {r.target: r.risk_assessment for r in O.overall_risk(d, targets).collect()}
    assert got == {"t": want, "empty": "NONE"}


def test_critical_list(spark):
    rows = [dict(category="tokens", value=f"t{i}") for i in range(4)] + [dict(category="api_keys", value=f"k{i}") for i in range(3)] + [dict(category="emails")]
    got = O.critical_list(found(spark, *rows)).orderBy("position").collect()
    assert [r.category for r in got] == ["api_keys"] * 3 + ["tokens"] * 2 and {r.more for r in got} == {2}


def test_results_do_not_depend_on_partitions(spark, sf):
    docs = view(spark, sf, "docs")
    a = scan_corpus(docs.coalesce(1)).drop("source_id")
    b = scan_corpus(docs.repartition(7, "text")).drop("source_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_full_scan_keeps_links_and_drops_soft404(spark):
    soft = "<html><title>Oops</title> token: \"" + "ab12cd34ef56ab78" + "\" number %d</html>"
    rows = [("https://t.test", "https://t.test/a", "page", 200, soft % 1), ("https://t.test", "https://t.test/.env", "page", 200, soft % 2),
            ("https://t.test", "https://t.test/zz", "baseline", 200, soft % 3),
            ("https://t.test", "https://t.test/b", "page", 200, "real token: \"" + "99aabbccddee1122" + "\""),
            ("https://t.test", "https://t.test", "root", 200, "<html>home</html>")]
    d = conform(spark.createDataFrame([(*r, "text/html") for r in rows], "target string, url string, probe string, status_code int, body string, content_type string"))
    got = scan_captures(d)
    assert [r.url for r in got.filter("category = 'tokens'").collect()] == ["https://t.test/b"]
    assert got.filter("category = 'security_headers'").count() == 6
    assert got.filter("category = 'security_txt_missing'").count() == 1


# --- reports ------------------------------------------------------------------

def awkward(spark):
    return O.enrich(found(spark, dict(category="api_keys", value='a "quoted", <b>\'x\'</b>', evidence="e1", context="c & d", informational=True, status_code=200),
                          dict(category="zzz", value="plain", context="only context")))


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    assert reports.write_report(awkward(spark).coalesce(1), path) == "csv"
    rows = [r for f in glob.glob(path + "/part-*") for r in csv.DictReader(open(f, encoding="utf-8"))]
    assert tuple(rows[0]) == C.CSV_COLUMNS
    by = {r["category"]: r for r in rows}
    assert by["api_keys"]["value"] == 'a "quoted", <b>\'x\'</b>' and by["api_keys"]["informational"] == "yes" and by["api_keys"]["risk"] == "HIGH"
    assert by["zzz"]["remediation"] == "only context" and by["zzz"]["cwe_id"] == "CWE-200"


def test_csv_without_findings_has_a_header(spark, tmp_path):
    path = str(tmp_path / "e.csv")
    reports.write_report(spark.createDataFrame([], FINDING), path)
    assert any(open(f).read().startswith("cwe_id,category") for f in glob.glob(path + "/part-*"))


def test_html_is_escaped(spark):
    targets = spark.createDataFrame([("t",), ("clean <t>",)], "target string")
    rows = [r.row for r in reports.html_rows(awkward(spark), targets).collect()]
    assert html.escape('a "quoted", <b>\'x\'</b>') in rows[0] and "<dd>informational</dd>" in rows[0] and "<b>" not in rows[0]
    assert "<dt>evidence</dt>" not in rows[1] and "<dt>remediation</dt><dd>only context</dd>" in rows[1]
    assert [r for r in rows if "No findings" in r and "clean &lt;t&gt;" in r] == rows[2:]


def test_json_and_header(spark, tmp_path):
    path = str(tmp_path / "r")
    d = awkward(spark)
    assert reports.write_report(d, path) == "json"
    assert spark.read.json(path).count() == 2
    t = spark.createDataFrame([("t",), ("clean",)], "target string")
    h = reports.report_header(d, t, run={"command": "scan -s SECRET x", "session": "SECRET", "depth": 2})
    docs = {r.target: json.loads(r.json) for r in reports.report_json(h).collect()}
    assert docs["t"]["summary"] == {"total_findings": 2, "informational_findings": 1, "actionable_findings": 1,
                                    "category_counts": {"api_keys": 1, "zzz": 1}, "risk_assessment": "LOW"}
    assert docs["clean"]["summary"]["risk_assessment"] == "NONE" and docs["clean"]["summary"]["category_counts"] == {}
    assert docs["t"]["scan_info"]["reproducibility"]["command"] == "scan -s <REDACTED> x" and "SECRET" not in json.dumps(docs)
    parts = reports.html_header_rows(h).filter("target = 't'").collect()
    assert {p.part for p in parts} == {"run", "reproducibility", "limitations"}
    assert sum("command" in p.row for p in parts) == 1


def test_output_choice():
    assert reports.output_paths("x.CSV", None, "y.csv") == {"json": [], "html": [], "csv": ["y.csv", "x.CSV"]}
    assert reports.output_paths("x.html", "x.html", None) == {"json": [], "html": ["x.html"], "csv": []}
    assert reports.output_paths("x", None, None) == {"json": ["x"], "html": [], "csv": []}
    assert len(reports.limitations(False, False)) == 4 and len(reports.limitations(True, True)) == 1


# --- captures and streams -----------------------------------------------------

def test_capture_round_trip_and_stream(spark, sf, tmp_path):
    c = conform(view(spark, sf, "captures"))
    for i in range(2):
        c.filter(f"pmod(xxhash64(url), 2) = {i}").write.mode("append").parquet(str(tmp_path / "land"))
    back = read_captures(spark, str(tmp_path / "land"))
    assert back.count() == c.count()
    from lumenaudit.operators.web import missing_headers
    s = stream_captures(spark, str(tmp_path / "land"), maxFilesPerTrigger=1)
    q = missing_headers(s).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.schema(FINDING).parquet(str(tmp_path / "out"))
    want = missing_headers(back)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_stream_equals_batch_over_several_batches(spark, sf, tmp_path):
    docs = view(spark, sf, "docs").withColumn("seen", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000))
    for i in range(3):   # the middle third lands twice: copies must not count twice
        part = docs.filter(f"doc_id % 3 = {i}").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "land"))
    docs.filter("doc_id % 3 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    raw = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "land"))
    counts = streams.running_counts(streams.deduplicated(streams.stream_findings(raw, time="seen")))
    q = streams.write_changes(counts, str(tmp_path / "rows"), str(tmp_path / "state"), {"availableNow": True})
    q.awaitTermination()
    assert len(glob.glob(str(tmp_path / "rows" / "batch=*"))) >= 4
    state = streams.latest_counts(spark, str(tmp_path / "rows"))
    batch = O.finalise(secrets.secret_findings(docs))
    want = {(r.target, r.category): r.n for r in O.category_counts(batch).collect()}
    got = {(r.target, r.category): r.n for r in state.groupBy("target", "category").agg(F.sum("n").alias("n")).collect()}
    assert got == want
    verdict = {r.target: r.risk_assessment for r in streams.verdicts(state).collect()}
    assert verdict == {r.target: r.risk_assessment for r in O.overall_risk(batch, docs).collect()}
