"""Landed lines, ordered names, and what reads them."""

import glob
import json
import random

from lumenaudit.functions.order import globally_numbered
from lumenaudit.operators import recon
from lumenaudit.sources.captures import read_landed


def test_quarantine(spark, tmp_path):
    good = [{"target": "t", "url": f"u{i}", "status_code": 200, "body": "é"} for i in range(5)]
    good += [{"target": "t", "url": "old"}, {"target": "t", "url": "new", "probe": "root", "extra": {"a": 1}, "fetched_at": "2025-01-01T00:00:00Z"}]
    bad = ['{"target": "t", "url"', "not json", '{"target": "t", "url": "u", "status_code": "none"}', '{"url": "u"}', '{"target": "t", "body": "x"}', "[1, 2]"]
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, good), *bad, ""]))
    (tmp_path / "b.json").write_text("")
    rows, refused = read_landed(spark, str(tmp_path))
    by = {r.url: r for r in rows.collect()}
    assert sorted(by) == ["new", "old", "u0", "u1", "u2", "u3", "u4"]
    assert (by["u0"].body_bytes, by["u0"].probe, by["u0"].final_url, by["new"].probe, by["old"].status_code) == (2, "page", "u0", "root", None)
    assert rows.select("target").count() == 7 and rows.filter("status_code = 200").count() == 5
    reasons = [r.reason for r in refused.collect()]
    assert sorted(reasons) == ["no target or url"] * 2 + ["unreadable"] * 4
    assert {r.line for r in refused.filter("reason = 'unreadable'").collect()} >= set(bad[:3])


def test_numbers_follow_the_order(spark):
    rng = random.Random(4)
    values = rng.sample(range(10 ** 6), 500)
    d = spark.createDataFrame([(v, str(v)) for v in values], "v int, s string").repartition(6)
    assert {r.v: r.position for r in globally_numbered(d, ["v"]).collect()} == {v: i for i, v in enumerate(sorted(values))}
    assert globally_numbered(d.filter("v < 0"), ["v"]).isEmpty()


def test_host_list(spark, tmp_path):
    ct = spark.createDataFrame([("b.test", "x.b.test\n*.a.b.test\nx.b.test"), ("a.test", "z.a.test")], "domain string, name_value string")
    hosts = recon.host_list(recon.ct_subdomains(ct), recon.ct_subdomains(ct))
    assert [(r.target, r.host) for r in hosts.orderBy("position").collect()] == [
        ("https://a.test", "z.a.test"), ("https://b.test", "a.b.test"), ("https://b.test", "x.b.test")]
    recon.write_hosts(hosts, str(tmp_path / "hosts"))
    lines = [x for f in sorted(glob.glob(str(tmp_path / "hosts" / "part-*"))) for x in open(f).read().split()]
    assert lines == ["z.a.test", "a.b.test", "x.b.test"]
