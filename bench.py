"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every query
runs in full (all rows, all columns) into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenaudit.registry.queries import QUERIES  # noqa: E402
from lumenaudit.session import local_session  # noqa: E402

HEADLINE = (
    "secret_scan", "corpus_findings", "secret_findings_valid", "secret_scan_conversations", "finding_dedup",
    "overall_risk", "critical_top5", "content_scan", "exposed_files", "security_headers", "tech_fingerprint",
    "waf_detection", "link_extraction", "crawl_frontier", "candidate_hits", "page_fingerprints", "soft404_exact",
    "soft404_similar", "open_ports", "probe_db_error", "report_csv_rows", "stream_scan",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
