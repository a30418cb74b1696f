"""The registered queries: one per operator or tight group of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions import urls as U
from lumenaudit.operators import discovery, endpoints, files, params, probes, recon, secrets, soft404, web
from lumenaudit.operators import findings as O
from lumenaudit.plans.scan import capture_records, content_findings, scan_captures, scan_corpus, scan_records
from lumenaudit.registry.planted import LABELS, WORDS, view, view_of
from lumenaudit.sources import reports
from lumenaudit.sources.captures import conform, eligible, read_landed, read_words
from lumenaudit.session import shared_folder, written
from lumenaudit.streaming import merged, streams

AS_OF = "2025-07-01 00:00:00"
_KEY = ("target", "url", "category", "value", "confidence")


def _words(spark: SparkSession, words=WORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def _captures(spark, sf):
    return conform(view(spark, sf, "captures"))


def _found(spark, sf, context=False):
    return secrets.secret_findings(view(spark, sf, "docs"), context=context)


def _report(spark, sf, context=False):
    """Enriched, de-duplicated findings of the planted documents."""
    return O.finalise(_found(spark, sf, context))


def _targets(spark, sf):
    return view(spark, sf, "docs").select("target").distinct()


# --- secrets -----------------------------------------------------------------

def secret_scan(spark, sf):
    m = secrets.secret_matches(view(spark, sf, "docs").select("url", "text"))
    return m.select("url", "category", "detector_ord", "match_ord", "value", "confidence")


def secret_scan_conversations(spark, sf):
    m = secrets.secret_matches(view(spark, sf, "turns").select("url", "text"))
    return m.select("url", "category", "detector_ord", "match_ord", "value", "confidence")


def secret_findings_valid(spark, sf):
    return _found(spark, sf).select(*_KEY, "detector_ord", "match_ord")


def secret_entropy(spark, sf):
    m = secrets.secret_matches(view(spark, sf, "docs").select("url", "text"))
    m = m.filter(F.col("category").isin(*C.ENTROPY_CATEGORIES))
    return m.select("url", "detector_ord", "match_ord", F.round(X.entropy(F.col("value")), 6).alias("entropy"))


def finding_context(spark, sf):
    """Context of all fixed-format detectors; none of them spans lines."""
    fixed = tuple(d for d in C.DETECTORS if d.group == 0)
    m = secrets.secret_matches(view(spark, sf, "context_docs").select("url", "text"), detectors=fixed, context=True)
    return m.select("url", "detector_ord", "match_ord", "value", "context")


def finding_context_all(spark, sf):
    m = secrets.secret_matches(view(spark, sf, "context_docs").select("url", "text"), context=True)
    return m.select("url", "category", "detector_ord", "match_ord", "value", "context")


def finding_dedup(spark, sf):
    return O.deduplicate(_found(spark, sf)).select(*_KEY, "detector_ord", "match_ord")


def findings_enriched(spark, sf):
    return O.enrich(_found(spark, sf)).select(
        *_KEY, O.risk_of(F.col("category")).alias("risk"), "cwe_id", "evidence", "informational", "remediation")


def corpus_findings(spark, sf):
    """The flagship: scan with context, validity, enrichment, de-duplication."""
    return scan_corpus(view(spark, sf, "docs")).select(*_KEY, "cwe_id", "context")


# --- aggregates --------------------------------------------------------------

def category_counts(spark, sf):
    return O.category_counts(_report(spark, sf))


def finding_totals(spark, sf):
    return O.totals(_report(spark, sf))


def overall_risk(spark, sf):
    return O.overall_risk(_report(spark, sf), _targets(spark, sf))


def critical_top5(spark, sf):
    return O.critical_list(_report(spark, sf))


def scan_stats(spark, sf):
    return O.scan_stats(_captures(spark, sf))


# --- files -------------------------------------------------------------------

def file_references(spark, sf):
    return files.file_references(_captures(spark, sf)).select("target", "url", "category", "value")


def exposed_files(spark, sf):
    return files.exposed_files(conform(view(spark, sf, "file_captures"))).select(*_KEY, "content_type", "status_code")


def content_confirmation(spark, sf):
    d = view(spark, sf, "file_captures")
    return d.select("url", "name", "content_type",
                    files.content_confirms(F.col("name"), F.col("content_type"), F.col("body")).alias("confirmed"))


def directory_listing(spark, sf):
    return files.directory_listings(_captures(spark, sf)).select(*_KEY, "content_type")


# --- posture -----------------------------------------------------------------

def mixed_content(spark, sf):
    return web.mixed_content(_captures(spark, sf)).select(*_KEY, "evidence")


def missing_sri(spark, sf):
    return web.missing_sri(_captures(spark, sf)).select(*_KEY, "evidence")


def security_headers(spark, sf):
    return web.missing_headers(_captures(spark, sf)).select(
        "target", "url", "value", "confidence", "cwe_id", "status_code", "evidence", "remediation")


def weak_nosniff(spark, sf):
    return web.weak_nosniff(_captures(spark, sf)).select(*_KEY, "evidence")


def version_banners(spark, sf):
    return web.version_banners(_captures(spark, sf)).select(*_KEY, "evidence", "informational")


def cookie_flags(spark, sf):
    return web.cookie_flags(_captures(spark, sf)).select(*_KEY, "match_ord")


def cookie_redaction(spark, sf):
    d = _captures(spark, sf).select("url", F.explode("headers").alias("h"))
    d = d.filter(F.lower("h.name") == "set-cookie")
    return d.select("url", web.redact_cookie(F.col("h.value")).alias("cookie"))


def cors_audit(spark, sf):
    return web.cors_issues(conform(view(spark, sf, "cors_probes"))).select(*_KEY, "evidence")


def risky_methods(spark, sf):
    return web.risky_methods(conform(view(spark, sf, "options_probes"))).select(*_KEY, "evidence")


def tls_health(spark, sf):
    return endpoints.tls_issues(view(spark, sf, "tls"), AS_OF).select(*_KEY, "evidence")


def security_txt_missing(spark, sf):
    return endpoints.security_txt_missing(view(spark, sf, "endpoint_probes")).select(*_KEY, "evidence")


def graphql_introspection(spark, sf):
    return endpoints.graphql_introspection(view(spark, sf, "endpoint_probes")).select(*_KEY, "evidence")


def tech_fingerprint(spark, sf):
    return web.tech_fingerprints(_captures(spark, sf)).select(*_KEY, "evidence", "informational")


def meta_generator(spark, sf):
    return web.meta_generators(_captures(spark, sf)).select(*_KEY, "evidence")


def waf_detection(spark, sf):
    return web.waf_detections(_captures(spark, sf)).select(*_KEY, "evidence")


# --- URLs --------------------------------------------------------------------

def open_redirect(spark, sf):
    return params.open_redirects(view(spark, sf, "redirects")).select(*_KEY, "context")


def ssrf_candidates(spark, sf):
    return params.ssrf_candidates(view(spark, sf, "redirects")).select(*_KEY, "evidence")


def query_params(spark, sf):
    return params.query_params(view(spark, sf, "redirects").select("page_id", "url"))


def text_eligibility(spark, sf):
    return eligible(_captures(spark, sf)).select("target", "url", "content_type", "body_bytes")


def link_extraction(spark, sf):
    return discovery.links(view(spark, sf, "link_pages"))


def in_scope_links(spark, sf):
    """Scope test over all pairs page/link the extraction of real pages yields, per host."""
    d = discovery.links(view(spark, sf, "link_pages"))
    return d.groupBy("target", U.authority(F.col("dst")).alias("host")).agg(F.count("*").alias("n"))


def _seeds(spark, sf):
    roots = view(spark, sf, "hosts").select("target", F.concat("target", F.lit("/p3")).alias("url"))
    pages = view(spark, sf, "link_pages").select("target", F.concat("target", F.lit("/p5")).alias("url"))
    return discovery.url_seeds((roots, 0), (pages, 1))


def _edges(spark, sf):
    """Links keyed by the planted page name, so that pages lead to each other."""
    d = view(spark, sf, "link_pages")
    d = d.withColumn("url", F.concat(F.col("target"), F.lit("/p"), (F.col("page_id") % 20).cast("string")))
    return discovery.links(d).distinct()


def url_seeds(spark, sf):
    return _seeds(spark, sf)


def crawl_frontier(spark, sf):
    return discovery.crawl(_seeds(spark, sf), _edges(spark, sf), depth=3)


def crawl_budget(spark, sf):
    return discovery.crawl(_seeds(spark, sf), _edges(spark, sf), depth=2, budget=4)


def url_budget(spark, sf):
    d = view(spark, sf, "link_pages").select("target", "url", (F.col("page_id") % 3).cast("int").alias("priority"))
    return discovery.within_budget(d, 2).select("target", "url", "priority")


def candidate_urls(spark, sf):
    return discovery.candidate_urls(view(spark, sf, "hosts"), WORDS)


def candidate_hits(spark, sf):
    return discovery.candidate_hits(view(spark, sf, "word_captures"), _words(spark))


def word_list_hits(spark, sf):
    """The same with a word list read from a file."""
    path = _run_folder(spark, "words")
    spark.createDataFrame([(w,) for w in WORDS], "value string").write.text(path)
    return discovery.candidate_hits(view(spark, sf, "word_captures"), read_words(spark, path))


def landed_captures(spark, sf):
    """Captures read from JSON lines, some of them broken, and what went to the quarantine."""
    path = _run_folder(spark, "landed")
    view(spark, sf, "landed").select(F.col("line").alias("value")).write.text(path)
    good, bad = read_landed(spark, path)
    counted = good.groupBy("target", "probe", "content_type").agg(F.count("*").alias("n"), F.sum("body_bytes").alias("body_bytes"))
    return counted.unionByName(bad.groupBy(F.col("reason").alias("target")).agg(F.count("*").alias("n")), allowMissingColumns=True)


def common_seeds(spark, sf):
    return discovery.common_seeds(view(spark, sf, "hosts"))


def robots_paths(spark, sf):
    return discovery.robots_paths(view(spark, sf, "robots"))


def sitemap_locs(spark, sf):
    return discovery.sitemap_locs(view(spark, sf, "sitemaps"))


# --- soft 404 ----------------------------------------------------------------

def page_fingerprints(spark, sf):
    d = view(spark, sf, "doc_pages")
    d = d.select("target", soft404.fingerprint(F.col("body")).alias("fp"))
    return d.groupBy("target", "fp").agg(F.count("*").alias("n"))


def soft404_exact(spark, sf):
    """How many documents of its language each document equals but for numbers and blanks; all are baselines, of any length."""
    pages = conform(view(spark, sf, "doc_pages")).select("target", "url", "status_code", "body_bytes", *soft404.signature(0))
    pages = written(pages, "signatures")  # bodies are read once
    return soft404.exact_matches(pages, soft404.baseline_signatures(pages.withColumn("probe", F.lit("baseline"))), counted=True)


def _soft(spark, sf):
    pages = conform(view(spark, sf, "soft_pages"))
    return pages, soft404.baseline_signatures(conform(view(spark, sf, "baselines")))


def soft404_similar(spark, sf):
    return soft404.similar_matches(*_soft(spark, sf))


def content_without_soft404(spark, sf):
    pages, base = _soft(spark, sf)
    found = secrets.secret_findings(eligible(pages), "body", context=False)
    return soft404.drop_soft404(found, soft404.exact_matches(pages, base)).select(*_KEY)


def content_scan(spark, sf):
    """All content checks over eligible captures."""
    return O.deduplicate(O.enrich(content_findings(_captures(spark, sf)))).select(*_KEY)


# --- recon -------------------------------------------------------------------

def ct_subdomains(spark, sf):
    return recon.ct_subdomains(view(spark, sf, "ct"), view(spark, sf, "dns")).select(*_KEY, "evidence")


def dns_subdomains(spark, sf):
    return recon.dns_subdomains(view(spark, sf, "dns"), _words(spark, LABELS)).select(*_KEY, "evidence")


def subdomain_list(spark, sf):
    """Names of both sources in order."""
    dns = view(spark, sf, "dns")
    return recon.host_list(recon.ct_subdomains(view(spark, sf, "ct"), dns), recon.dns_subdomains(dns, _words(spark, LABELS)))


def open_ports(spark, sf):
    return recon.open_ports(view(spark, sf, "ports")).select(*_KEY, "evidence", "informational")


def unreliable_hosts(spark, sf):
    return recon.unreliable_hosts(view(spark, sf, "ports")).select("url", "category", "confidence", "evidence")


def port_banners(spark, sf):
    d = view(spark, sf, "ports").filter("open")
    return d.select("host", "port", recon.port_banner(F.col("port"), F.col("banner_raw")).alias("banner"))


# --- recorded probes ---------------------------------------------------------

def probe_reflection(spark, sf):
    return probes.reflections(view(spark, sf, "probe_results")).select(*_KEY, "evidence")


def probe_db_error(spark, sf):
    return probes.database_errors(view(spark, sf, "probe_results")).select(*_KEY, "evidence", "status_code")


def probe_file_disclosure(spark, sf):
    return probes.file_disclosures(view(spark, sf, "probe_results")).select(*_KEY, "evidence")


def probe_template_eval(spark, sf):
    return probes.template_evaluations(view(spark, sf, "probe_results")).select(*_KEY, "evidence")


# --- reports -----------------------------------------------------------------

def report_csv_rows(spark, sf):
    return reports.csv_rows(_report(spark, sf, context=True))


def report_html_rows(spark, sf):
    extra = spark.createDataFrame([("https://clean.corpus.test",)], "target string")
    return reports.html_rows(_report(spark, sf, context=True), _targets(spark, sf).unionByName(extra))


def report_html_summary(spark, sf):
    return reports.html_summary_rows(O.category_counts(_report(spark, sf)))


def report_html_header(spark, sf):
    """Header entries of a run with a session, which is not shown, and what the run leaves open."""
    run = {"session": "k3y<&>", "command": "scan --session k3y<&> all", "timestamp": "2025-07-01T00:00:00", "depth": 2, "max_urls": 500}
    stats = O.scan_stats(_captures(spark, sf)).select(F.lit("https://wiki.corpus.test").alias("target"), "urls_scanned", "errors") \
        .groupBy("target").agg(F.sum("urls_scanned").alias("urls_scanned"), F.sum("errors").alias("errors"))
    return reports.html_header_rows(reports.report_header(_report(spark, sf), _targets(spark, sf), stats, run))


def report_summary(spark, sf):
    """The flat part of the report header, with the category counts as text."""
    h = reports.report_header(_report(spark, sf), _targets(spark, sf))
    return h.select("target", "summary.total_findings", "summary.actionable_findings", "summary.risk_assessment",
                    F.to_json("summary.category_counts").alias("category_counts"))


def report_json(spark, sf):
    """Fields read back from the headers written as JSON."""
    d = reports.report_json(reports.report_header(_report(spark, sf), _targets(spark, sf)))

    def field(path, name, kind="string"):
        return F.get_json_object("json", f"$.{path}").cast(kind).alias(name)

    return d.select(
        "target", field("scan_info.target", "scan_target"), field("scan_info.depth", "depth", "int"), field("scan_info.errors", "errors", "bigint"),
        field("scan_info.active", "active"), field("scan_info.reproducibility.command", "command"),
        field("summary.total_findings", "total_findings", "bigint"), field("summary.informational_findings", "informational_findings", "bigint"),
        field("summary.actionable_findings", "actionable_findings", "bigint"), field("summary.risk_assessment", "risk_assessment"),
        field("summary.category_counts", "category_counts"))


def _landed(spark, frame, name):
    """Writes a table to the shared folder, as acquisition would, and reads it back."""
    return written(frame, name)


def _responses(spark, sf):
    parts = ["captures", "file_captures", "catch_all_pages", "redirects", "cors_probes", "options_probes", "endpoint_probes", "baselines"]
    return O.union_findings(*[conform(view(spark, sf, p)) for p in parts])


def _observations(spark, sf):
    obs = {n: _landed(spark, view(spark, sf, n), n) for n in ("tls", "dns", "ct", "ports", "probe_results")}
    return {**obs, "words": _words(spark, LABELS), "as_of": AS_OF}


def full_scan(spark, sf):
    """The whole life cycle over all planted captures and observations."""
    found = scan_captures(_landed(spark, _responses(spark, sf), "captures"), **_observations(spark, sf))
    return found.select(*_KEY, "cwe_id", "informational")


def scan_verdicts(spark, sf):
    """Totals, score and verdict of every target of a whole scan, one without findings among them."""
    responses = _landed(spark, _responses(spark, sf), "captures")
    found = _landed(spark, scan_captures(responses, **_observations(spark, sf)), "findings")
    targets = found.select("target").unionByName(spark.createDataFrame([("https://clean.test",)], "target string"))
    return O.summaries(found, targets).drop("category_counts")


def scan_errors(spark, sf):
    """URLs and errors per target over all captures; some have no status."""
    return O.scan_stats(_responses(spark, sf))


# --- streaming ---------------------------------------------------------------

def _stream_table(spark, sf, table):
    """A table as a stream, whether it is one file or a folder of many; a stream takes a single file by a pattern only."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def _stream_texts(spark, sf):
    return view_of(spark, "docs", documents=_stream_table(spark, sf, "documents"))


def _run_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _run(spark, stream, name):
    """Runs a stream over what has landed and reads the written table back."""
    out = _run_folder(spark, name)
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state")
         .trigger(availableNow=True).start(f"{out}/rows"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_scan(spark, sf):
    s = streams.stream_findings(_stream_texts(spark, sf)).select(*_KEY, "detector_ord", "match_ord")
    return _run(spark, s, "scan")


def stream_content_scan(spark, sf):
    """All content checks over captures that arrive as a stream, de-duplicated once they have landed."""
    found = streams.stream_content(conform(view_of(spark, "captures", pages=_stream_table(spark, sf, "pages"))))
    return O.deduplicate(_run(spark, found, "content")).select(*_KEY)


def stream_dedup(spark, sf):
    s = streams.deduplicated(streams.stream_findings(_stream_texts(spark, sf)))
    return _run(spark, s.select("target", "url", "category", "value_key"), "dedup")


def stream_dedup_watermark(spark, sf):
    """Keys within a watermark; the event time follows the key."""
    texts = _stream_texts(spark, sf).withColumn("seen", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000))
    s = streams.deduplicated(streams.stream_findings(texts, time="seen"), "1 day")
    return _run(spark, s.select("target", "url", "category", "value_key"), "window")


def _counts(spark, sf):
    out = _run_folder(spark, "counts")
    s = streams.running_counts(streams.deduplicated(streams.stream_findings(_stream_texts(spark, sf))))
    q = streams.write_changes(s, f"{out}/rows", f"{out}/state", {"availableNow": True})
    q.awaitTermination()
    return streams.latest_counts(spark, f"{out}/rows")


def stream_counts(spark, sf):
    return _counts(spark, sf).groupBy("target", "category").agg(F.sum("n").alias("n"))


def stream_verdicts(spark, sf):
    return streams.verdicts(_counts(spark, sf))


def _arriving(spark, frame, name, batches=3):
    """The table as a stream that arrives in some micro-batches, each of a file per core at least."""
    path, files = _run_folder(spark, name), spark.sparkContext.defaultParallelism
    frame.repartition(batches * files).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(path)


def _merged(spark, sf):
    """Findings of documents that arrive in micro-batches, merged batch by batch."""
    found = streams.stream_findings(_arriving(spark, view(spark, sf, "docs"), "docs"))
    out = _run_folder(spark, "merged")
    tables = merged.FindingTables(spark, out, found.schema, every=2)
    tables.write(found, f"{out}/state", {"availableNow": True}).awaitTermination()
    return tables


def stream_first_wins(spark, sf):
    """First-wins de-duplication over a stream: by the findings' order, not by arrival."""
    return _merged(spark, sf).findings().select(*_KEY, "detector_ord", "match_ord")


def stream_merged_verdicts(spark, sf):
    return streams.verdicts(_merged(spark, sf).counts())


def stream_endpoints(spark, sf):
    """Checks across the captures of a target, which arrive in any order."""
    d = conform(view(spark, sf, "endpoint_probes"))
    out = _run_folder(spark, "endpoints")
    facts = merged.EndpointFacts(spark, out, d, every=2)
    facts.write(_arriving(spark, d, "probes"), f"{out}/state", {"availableNow": True}).awaitTermination()
    return facts.findings().select(*_KEY, "evidence")


def stream_full_scan(spark, sf):
    """The whole life cycle with captures that arrive in micro-batches: each leaves its records, the scan is derived from all of them."""
    records = _run(spark, capture_records(_arriving(spark, _responses(spark, sf), "captures")), "records")
    return scan_records(records, **_observations(spark, sf)).select(*_KEY, "cwe_id", "informational")


QUERIES = {f.__name__: f for f in (
    secret_scan, secret_scan_conversations, secret_findings_valid, secret_entropy, finding_context,
    finding_context_all, finding_dedup, findings_enriched, corpus_findings,
    category_counts, finding_totals, overall_risk, critical_top5, scan_stats,
    file_references, exposed_files, content_confirmation, directory_listing,
    mixed_content, missing_sri, security_headers, weak_nosniff, version_banners,
    cookie_flags, cookie_redaction, cors_audit, risky_methods,
    tls_health, security_txt_missing, graphql_introspection,
    tech_fingerprint, meta_generator, waf_detection,
    open_redirect, ssrf_candidates, query_params, text_eligibility,
    link_extraction, in_scope_links, url_seeds, crawl_frontier, crawl_budget, url_budget,
    candidate_urls, candidate_hits, word_list_hits, landed_captures, common_seeds, robots_paths, sitemap_locs,
    page_fingerprints, soft404_exact, soft404_similar, content_without_soft404, content_scan,
    ct_subdomains, dns_subdomains, subdomain_list, open_ports, unreliable_hosts, port_banners,
    probe_reflection, probe_db_error, probe_file_disclosure, probe_template_eval,
    report_csv_rows, report_html_rows, report_html_summary, report_html_header, report_summary, report_json, full_scan, scan_verdicts, scan_errors,
    stream_scan, stream_content_scan, stream_dedup, stream_dedup_watermark, stream_counts, stream_verdicts,
    stream_first_wins, stream_merged_verdicts, stream_endpoints, stream_full_scan,
)}
