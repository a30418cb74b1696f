"""Subdomains and ports from recorded observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import advice as A
from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions.order import globally_numbered
from lumenaudit.functions.skew import salted_join
from lumenaudit.schemas import finding

_WILDCARD_NOTE = " (wildcard DNS zone: likely resolves to the same catch-all host as every other name here)"


def wildcard_zones(dns: DataFrame) -> DataFrame:
    """Zones in which a made-up name resolved: ``domain``."""
    return dns.filter(F.col("is_canary") & F.col("resolves")).select("domain").distinct()


def _subdomain(d: DataFrame, source: str, suffix: Column, ord_: int) -> DataFrame:
    return finding(d, target=F.concat(F.lit("https://"), F.col("domain")),
                   url=F.concat(F.lit("https://"), F.col("host")), category="subdomain_found",
                   value=F.concat(F.lit(f"Subdomain discovered via {source}: "), F.col("host"), suffix),
                   confidence="low", pattern="recon", evidence=F.col("host"), informational=True,
                   context=A.SUBDOMAIN, stage_ord=C.STAGE_RECON, detector_ord=ord_)


def ct_subdomains(entries: DataFrame, dns: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Names in certificate logs below the domain; annotated, not dropped, in wildcard zones.

    The plain rule tests the end of the name only, so ``badexample.test``
    passes for ``example.test``; ``strict`` asks for a label boundary.
    """
    names = F.explode(F.split("name_value", "\n")).alias("_n")
    d = entries.select("domain", names)
    d = d.select("domain", F.ltrim(F.lower(X.strip(F.col("_n"))), F.lit("*.")).alias("host"))
    below = F.endswith("host", F.concat(F.lit("."), F.col("domain")) if strict else F.col("domain"))
    d = d.filter((F.col("host") != "") & below & (F.col("host") != F.col("domain"))).distinct()
    suffix = F.lit("")
    if dns is not None:
        zones = wildcard_zones(dns).withColumn("_wild", F.lit(True))
        d = salted_join(d, zones, ["domain"], "left", F.col("host"))
        suffix = F.when(F.col("_wild"), F.lit(_WILDCARD_NOTE)).otherwise(F.lit(""))
    return _subdomain(d, "certificate transparency", suffix, 40)


def host_list(*found: DataFrame) -> DataFrame:
    """Names found by any source, once each and in order: ``position, target, host``."""
    names = reduce(DataFrame.unionByName, [d.filter("category = 'subdomain_found'").select("target", F.col("evidence").alias("host")) for d in found])
    return globally_numbered(names.distinct(), ["target", "host"])


def write_hosts(hosts: DataFrame, path: str) -> None:
    """One name a line; the parts of the folder follow each other in order."""
    hosts.orderBy("position").select("host").write.mode("overwrite").text(path)


def dns_subdomains(dns: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Word-list names that resolve, outside wildcard zones.

    ``words`` has a column ``word``.  The label is read off the observed host
    and looked up among the words, so the product of words and domains is never
    formed.
    """
    d = dns.filter(F.col("resolves") & ~F.col("is_canary")).select("domain", "host").distinct()
    d = d.filter(F.endswith("host", F.concat(F.lit("."), F.col("domain"))))
    if words is not None:
        label = F.expr("left(host, length(host) - length(domain) - 1)")
        d = salted_join(d.withColumn("word", label), words.select("word").distinct(), ["word"], "left_semi", F.col("host"))
    d = salted_join(d, wildcard_zones(dns), ["domain"], "left_anti", F.col("host"))
    return _subdomain(d, "DNS brute-force", F.lit(""), 41)


def port_banner(port: Column, raw: Column) -> Column:
    """Server header of HTTP-like ports, else the first line that is not blank."""
    lines = F.split(raw, r"\R|[\x1c-\x1e]")
    served = F.get(F.filter(lines, lambda s: F.lower(s).startswith("server:")), F.lit(0))
    served = X.strip(F.regexp_replace(served, "^[^:]*:", ""))
    greeting = F.get(F.filter(F.transform(lines, X.strip), lambda s: s != ""), F.lit(0))
    return F.coalesce(F.when(port.isin(*C.HTTP_PORTS), served)
                      .otherwise(greeting), F.lit(""))


def _intercepted(ports: DataFrame) -> DataFrame:
    return ports.filter(F.col("is_canary") & F.col("open")).select("host").distinct()


def unreliable_hosts(ports: DataFrame) -> DataFrame:
    """Hosts on which a port that must be closed answered."""
    d = _intercepted(ports)
    return finding(d, target=F.col("host"), url=F.col("host"), category="port_scan_unreliable",
                   value="Port scan skipped: unassigned ports accepted a connection", confidence="low",
                   pattern="recon",
                   evidence=F.concat(F.lit("Random high ports on "), F.col("host"), F.lit(" all reported open")),
                   informational=True, context=A.CANARY, stage_ord=C.STAGE_RECON, detector_ord=50)


def open_ports(ports: DataFrame, only: list[int] | None = None) -> DataFrame:
    """Open ports with service and banner, without hosts whose canary ports answered.

    All ports count unless some are named; those without a known service are ``unknown``.
    """
    names = F.create_map(*[F.lit(x) for kv in C.PORT_SERVICES.items() for x in kv])
    d = ports.filter(F.col("open") & ~F.col("is_canary"))
    if only:
        d = d.filter(F.col("port").isin(*only))
    d = d.join(_intercepted(ports), "host", "left_anti")
    d = d.groupBy("host", "port").agg(F.max(port_banner(F.col("port"), F.col("banner_raw"))).alias("_b"))
    d = d.withColumn("_svc", F.coalesce(F.try_element_at(names, F.col("port")), F.lit("unknown")))
    has = F.col("_b") != ""

    def more(*parts):
        return F.when(has, F.concat(*parts)).otherwise(F.lit(""))

    return finding(
        d, target=F.col("host"), url=F.concat(F.col("host"), F.lit(":"), F.col("port")), category="open_port",
        value=F.concat(F.lit("Open port "), F.col("port"), F.lit(" ("), F.col("_svc"), F.lit(")"),
                       more(F.lit(" - banner: "), F.col("_b"))),
        confidence=F.when(F.col("port").isin(*C.SENSITIVE_PORTS), "medium").otherwise("low"), pattern="recon",
        evidence=F.concat(F.lit("TCP connect to "), F.col("host"), F.lit(":"), F.col("port"), F.lit(" succeeded"),
                          more(F.lit("\nBanner: "), F.col("_b"))),
        informational=F.col("port").isin(*C.WEB_PORTS),
        context=F.concat(F.lit(A.PORT), more(F.lit(f" {A.PORT_CVE} {C.CVE_SEARCH}"), X.percent_quote(F.col("_b")))),
        stage_ord=C.STAGE_RECON, detector_ord=51, match_ord=F.col("port"))


def parse_ports(raw: str | None) -> list[int] | None:
    """``"80, 443"`` as numbers; nothing given means the default list."""
    if not raw:
        return None
    return [int(p) for p in raw.split(",") if p.strip()]
