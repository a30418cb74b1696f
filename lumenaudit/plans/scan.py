"""Whole scans: captures or a corpus in, findings out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.operators import endpoints, files, params, probes, recon, secrets, soft404, web
from lumenaudit.operators.findings import finalise, union_findings
from lumenaudit.catalog import DETECTORS, STAGE_AUDIT, STAGE_CRAWL, Detector
from lumenaudit.schemas import FINDING_COLUMNS, as_detection, detect, gathered
from lumenaudit.session import small_splits, written
from lumenaudit.sources.captures import eligible, is_eligible

#: Matches once at the start of every text: stands for the capture itself among the detectors.
_CAPTURE = Detector("", r"\A", 0, "")


def scan_corpus(documents: DataFrame, text: str = "text", context: bool = True) -> DataFrame:
    """Secrets in plain texts: needs ``target, source_id, url`` and the text."""
    return finalise(secrets.secret_findings(documents, text, context=context))


def content_checks() -> Column:
    """What is read off the body of an eligible page, secrets aside."""
    return F.when(is_eligible(), F.concat(*[F.coalesce(c, F.array()) for c in (
        files.listing(), web.plain_resources(), web.unpinned_resources(), files.referenced_files())]))


def content_findings(pages: DataFrame) -> DataFrame:
    """All content checks and secrets of eligible pages."""
    return union_findings(detect(pages, content_checks()), secrets.secret_findings(eligible(pages), "body"))


def is_page() -> Column:
    return F.col("probe").isin("page", "root")


def capture_checks() -> list[Column]:
    """Every check that needs one capture only; the probe kind decides which apply."""
    root, page = F.col("probe") == "root", is_page()
    # on a root these two belong to the audit, which a catch-all answer does not silence
    resources = [web.plain_resources(stage=STAGE_AUDIT), web.unpinned_resources(stage=STAGE_AUDIT)]
    posture = [*resources, web.header_gaps(), web.nosniff_value(), web.banners(), web.weak_cookies(),
               web.technologies(), web.generators(), web.protections()]
    return [*[F.when(root, c) for c in posture], web.cors_policy(), web.advertised_methods(),
            F.when(page, content_checks()), F.when(page, files.exposed_file()),
            F.when(page, params.steered_redirect())]


def capture_records(responses: DataFrame) -> DataFrame:
    """What a scan needs to know of the captures, read off them in one pass without a shuffle.

    One row per capture, whose ``capture`` holds the narrow facts and the
    detections of all checks, and one per valid secret, whose ``secret`` is that
    detection.  Both come from one sweep of the detectors: among them is one that
    matches every text once and keeps the capture.
    """
    page = is_page()
    capture = F.struct(
        "probe", "status_code", "body_bytes", *[F.when(page | (F.col("probe") == "baseline"), c).alias(n) for c, n in zip(soft404.signature(), ("fp", "head"))],
        F.when(F.col("probe") == "securitytxt", F.coalesce(endpoints.has_text(), F.lit(False))).alias("filled"),
        F.when(F.col("probe") == "graphql", F.coalesce(endpoints.shows_schema(), F.lit(False))).alias("schema"),
        gathered(*capture_checks()).alias("detections"))
    d = responses.select("target", "url", "content_type", capture.alias("capture"),
                         F.when(page & is_eligible(), F.coalesce("body", F.lit(""))).otherwise("").alias("_text"))
    every = (*DETECTORS, _CAPTURE)
    m = secrets.secret_matches(d, "_text", every, context=True, last_only="capture")
    whole = F.col("detector_ord") == len(DETECTORS)
    m = m.filter(whole | secrets.is_valid(F.col("category"), F.col("value"), F.col("url")))
    secret = as_detection(url=F.col("url"), category=F.col("category"), value=secrets.sanitise(F.col("value")), confidence=F.col("confidence"),
                          pattern=F.col("pattern"), content_type=F.col("content_type"), context=F.col("context"),
                          stage_ord=STAGE_CRAWL, detector_ord=F.col("detector_ord"), match_ord=F.col("match_ord"))
    return m.select("target", "url", "capture", F.when(~whole, secret).alias("secret"))


def scan_records(records: DataFrame, tls: DataFrame | None = None, dns: DataFrame | None = None,
                 ct: DataFrame | None = None, ports: DataFrame | None = None,
                 words: DataFrame | None = None, probe_results: DataFrame | None = None,
                 as_of: datetime | str | None = None) -> DataFrame:
    """The findings of the full life cycle from a table of ``capture_records``; no body is read here.

    Catch-all pages are taken out of the findings, which are few, not out of the captures.
    """
    captures = records.filter(F.col("capture").isNotNull())
    facts = captures.select("target", "url", *[F.col(f"capture.{c}") for c in ("probe", "status_code", "body_bytes", "fp", "head", "filled", "schema")])
    pages = facts.filter(is_page())
    catch_all = soft404.soft404_pages(pages.filter(F.col("status_code") == 200), soft404.baseline_signatures(facts))
    found = F.when(F.col("secret").isNull(), F.col("capture.detections")).otherwise(F.array("secret"))
    captured = records.select("target", F.lit(None).cast("string").alias("source_id"), F.inline(found)).select(*FINDING_COLUMNS)
    content = (F.col("stage_ord") == STAGE_CRAWL) & (F.col("category") != "open_redirect")
    about = endpoints.endpoint_facts(facts.drop("fp", "head"), F.col("filled"), F.col("schema"))
    frames = [soft404.drop_soft404(captured, catch_all, content), endpoints.facts_findings(about)]
    if tls is not None:
        if as_of is None:
            raise ValueError("TLS findings need as_of")
        frames.append(endpoints.tls_issues(tls, as_of))
    if ct is not None:
        frames.append(recon.ct_subdomains(ct, dns))
    if dns is not None and words is not None:
        frames.append(recon.dns_subdomains(dns, words))
    if ports is not None:
        frames += [recon.open_ports(ports), recon.unreliable_hosts(ports)]
    if probe_results is not None:
        frames += [probes.reflections(probe_results), probes.database_errors(probe_results),
                   probes.file_disclosures(probe_results), probes.template_evaluations(probe_results),
                   params.ssrf_candidates(pages)]
    return finalise(*frames)


def scan_captures(responses: DataFrame, **observations) -> DataFrame:
    """The full life cycle over every target at once: ``scan_records`` of the captures' records.

    The captures are read once, when their records are written to the shared
    folder; all that crosses captures works on the records.  They are read in
    small splits: checks take long for a byte, and longer for some captures.
    """
    with small_splits(responses.sparkSession):
        records = written(capture_records(responses), "capture-records")
    return scan_records(records, **observations)
