"""Posture checks on captured headers and HTML.

Each check is an array of detections over the columns of a capture, so any
number of them run in one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import advice as A
from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions import urls as U
from lumenaudit.schemas import detect, found


def header(headers: Column, name: str) -> Column:
    """Value of a header in any case, repeated ones joined; null when absent."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda h: h["value"]), ", "))


def page_url() -> Column:
    return F.coalesce(F.col("final_url"), F.col("url"))


def _lines(headers: Column, names) -> Column:
    shown = F.filter(headers, lambda h: F.lower(h["name"]).isin(*names))
    return F.array_join(F.transform(shown, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")


def _header_evidence(headers: Column) -> Column:
    return _lines(headers, [h[0] for h in C.REQUIRED_HEADERS] + [b[0] for b in C.BANNER_HEADERS])


def header_gaps() -> Column:
    """Required security headers that are absent."""
    h = F.col("headers")
    https = U.scheme(page_url()) == "https"

    def lack(i, spec, seen):
        name, label, cwe, fix = spec
        cond = ~F.array_contains(seen["names"], name)
        if name == "strict-transport-security":
            cond = cond & https
        if name == "x-frame-options":
            cond = cond & ~seen["framed"]
        return F.when(cond, found(
            url=page_url(), category="security_headers", value=f"Missing header: {label}", confidence="medium",
            pattern="security_audit", status_code=F.col("status_code"), evidence=seen["evidence"],
            context=A.HEADER_ADVICE[name], cwe_id=cwe, remediation=fix, stage_ord=C.STAGE_AUDIT, detector_ord=i))

    csp = F.lower(F.coalesce(header(h, "content-security-policy"), F.lit("")))
    seen = F.struct(F.transform(h, lambda x: F.lower(x["name"])).alias("names"),
                    csp.contains("frame-ancestors").alias("framed"), _header_evidence(h).alias("evidence"))
    return X.bind(seen, lambda s: F.array_compact(F.array(
        *[lack(i, spec, s) for i, spec in enumerate(C.REQUIRED_HEADERS)])))


def nosniff_value() -> Column:
    h = F.col("headers")
    return X.bind(F.lower(X.strip(header(h, "x-content-type-options"))), lambda v: F.when(
        (v != "") & (v != "nosniff"), F.array(found(
            url=page_url(), category="security_headers",
            value=F.concat(F.lit("Weak X-Content-Type-Options value: "), X.python_repr(v)), confidence="low",
            pattern="security_audit", status_code=F.col("status_code"), evidence=_header_evidence(h),
            context=A.NOSNIFF, remediation=A.NOSNIFF, stage_ord=C.STAGE_AUDIT, detector_ord=10))))


def banners() -> Column:
    def shown(i, name, label):
        return X.bind(header(F.col("headers"), name), lambda v: F.when(v != "", found(
            url=page_url(), category="tech_fingerprint", value=F.concat(F.lit(f"{label}: "), v), confidence="low",
            pattern="security_audit", status_code=F.col("status_code"), evidence=F.concat(F.lit(f"{name}: "), v),
            informational=True, context=A.BANNER, remediation=A.BANNER,
            stage_ord=C.STAGE_AUDIT, detector_ord=11 + i)))

    return F.array_compact(F.array(*[shown(i, n, l) for i, (n, l) in enumerate(C.BANNER_HEADERS)]))


def redact_cookie(raw: Column) -> Column:
    """Name and attributes stay, the value goes."""
    return F.regexp_replace(raw, "^([^=]*)=[^;]*", "$1=<REDACTED>")


def weak_cookies() -> Column:
    """Missing flags per Set-Cookie header.

    A flag counts as present when its name occurs anywhere in the header.
    """
    cookies = F.transform(F.filter(F.col("headers"), lambda h: F.lower(h["name"]) == "set-cookie"),
                          lambda h: h["value"])
    https = U.scheme(page_url()) == "https"

    def judged(raw, i):
        low = F.lower(raw)
        missing = F.array_compact(F.array(
            F.when(https & ~low.contains("secure"), F.lit("Secure")),
            F.when(~low.contains("httponly"), F.lit("HttpOnly")),
            F.when(~low.contains("samesite"), F.lit("SameSite"))))
        name = X.strip(X.before_first(raw, "="))
        return X.bind(missing, lambda m: F.when(F.size(m) > 0, found(
            url=page_url(), category="cookie_security",
            value=F.concat(F.lit("Cookie '"), name, F.lit("' missing flag(s): "), F.array_join(m, ", ")),
            confidence=F.when(F.array_contains(m, "Secure") | F.array_contains(m, "HttpOnly"), "medium")
            .otherwise("low"),
            pattern="security_audit", status_code=F.col("status_code"), evidence=redact_cookie(raw),
            context=A.COOKIE, remediation=A.COOKIE, stage_ord=C.STAGE_AUDIT, detector_ord=20, match_ord=i)))

    return F.array_compact(F.transform(cookies, judged))


def cors_policy() -> Column:
    """Judges a capture of probe kind ``cors`` against the origin that was sent."""
    h = F.col("headers")
    origin, creds = "access-control-allow-origin", "access-control-allow-credentials"
    seen = F.struct(F.coalesce(header(h, origin), F.lit("")).alias("o"),
                    F.coalesce(header(h, creds), F.lit("")).alias("c"))

    def judged(s):
        trusted = F.lower(X.strip(s["c"])) == "true"
        wildcard = (s["o"] == "*") & trusted
        return F.when(wildcard | (s["o"] == F.col("request_origin")), F.array(found(
            url=F.col("target"), category="cors_misconfiguration",
            value=F.when(wildcard, F.lit("CORS: Access-Control-Allow-Origin=* combined with "
                                         "Access-Control-Allow-Credentials=true"))
            .otherwise(F.concat(F.lit("CORS: server reflects arbitrary Origin header back ("),
                                F.col("request_origin"), F.lit(")"))),
            confidence=F.when(trusted, "high").otherwise("medium"), pattern="security_audit",
            status_code=F.col("status_code"),
            evidence=F.concat(F.lit("Access-Control-Allow-Origin: "), s["o"],
                              F.lit("\nAccess-Control-Allow-Credentials: "), s["c"]),
            context=F.when(wildcard, A.CORS_WILDCARD).otherwise(A.CORS_REFLECTED),
            remediation=F.when(wildcard, A.CORS_WILDCARD).otherwise(A.CORS_REFLECTED),
            stage_ord=C.STAGE_AUDIT, detector_ord=30)))

    return F.when(F.col("probe") == "cors", X.bind(seen, judged))


def advertised_methods() -> Column:
    """Risky methods advertised in a capture of probe kind ``options``."""
    h = F.col("headers")
    allow = F.coalesce(F.nullif(header(h, "allow"), F.lit("")),
                       header(h, "access-control-allow-methods"), F.lit(""))

    def judged(a):
        named = F.transform(F.split(a, ","), lambda m: F.upper(X.strip(m)))
        risky = F.array_sort(F.array_intersect(named, F.array(*[F.lit(m) for m in C.RISKY_METHODS])))
        note = F.concat(F.lit("Advertised via Allow: "), a)
        return X.bind(risky, lambda r: F.when(F.size(r) > 0, F.array(found(
            url=F.col("target"), category="http_methods",
            value=F.concat(F.lit("Potentially risky HTTP methods enabled: "), F.array_join(r, ", ")),
            confidence="medium", pattern="security_audit", status_code=F.col("status_code"),
            evidence=F.concat(F.lit("Allow: "), a), context=note, remediation=note,
            stage_ord=C.STAGE_AUDIT, detector_ord=40))))

    return F.when(F.col("probe") == "options", X.bind(allow, judged))


def _resources(body: Column) -> Column:
    """Script and link tags with an absolute address, in page order.

    The page is matched once; the parts are then read from the short tags.
    """
    p = X.java_pattern(C.RESOURCE_TAG)
    tags = F.when(body.contains("://"), F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    return F.transform(tags, lambda m: F.struct(
        F.lower(F.regexp_extract(m, p, 1)).alias("tag"),
        F.regexp_extract(m, p, 3).alias("res"),
        F.lower(F.concat(F.regexp_extract(m, p, 2), F.regexp_extract(m, p, 4))).alias("rest")))


def _first_of_each(resources: Column) -> Column:
    """One tag per address, the first; sorted by address and position, so the work is n log n."""
    placed = F.array_sort(F.transform(resources, lambda r, i: F.struct(r["res"].alias("res"), i.alias("at"), r.alias("r"))))
    firsts = X.bind(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["res"] != x["res"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"], x["r"].alias("r")))), lambda x: x["r"])


def _html() -> Column:
    return F.lower(F.col("content_type")).contains("text/html")


def _judged_resources(wanted, category, confidence, prefix, middle, text, window, ord_, stage) -> Column:
    body = F.left(F.col("body"), F.lit(window)) if window else F.col("body")
    some = F.filter(_resources(body), wanted)
    return F.when(_html(), X.bind(some, lambda rs: F.transform(_first_of_each(rs), lambda r, i: found(
        url=page_url(), category=category, confidence=confidence, pattern="security_audit",
        value=F.concat(F.lit(prefix), r["tag"], F.lit(middle), r["res"]), evidence=r["res"],
        context=text, remediation=text, stage_ord=stage, detector_ord=ord_, match_ord=i))))


def plain_resources(window: int | None = None, stage: int = C.STAGE_CRAWL) -> Column:
    """Plain-HTTP scripts and links on HTTPS pages."""
    return F.when(U.scheme(page_url()) == "https", _judged_resources(
        lambda r: F.lower(r["res"]).startswith("http://"), "mixed_content", "medium",
        "Insecure <", "> resource loaded over HTTP on an HTTPS page: ", A.MIXED, window, -2, stage))


def unpinned_resources(window: int | None = None, stage: int = C.STAGE_CRAWL) -> Column:
    """Cross-host scripts and links without an integrity attribute."""
    def wanted(r):
        h = U.authority(r["res"])
        return (h != "") & (h != U.authority(page_url())) & ~r["rest"].contains("integrity=")

    return _judged_resources(wanted, "sri_missing", "low", "Cross-origin <",
                             "> without Subresource Integrity: ", A.SRI, window, -1, stage)


def technologies(window: int | None = None) -> Column:
    """Products named by headers or page content, with their version where shown."""
    body = F.coalesce(F.col("body"), F.lit(""))
    body = F.left(body, F.lit(window)) if window else body
    names = ("server", "x-powered-by", "set-cookie")
    seen = F.struct(*[F.coalesce(header(F.col("headers"), n), F.lit("")).alias(n.replace("-", "_")) for n in names])

    def one(i, spec, s):
        product, where, pattern, versioned = spec
        p = X.java_pattern(pattern)
        hay = s[where.replace("-", "_")] if where else body
        label = F.lit(product)
        if versioned:
            label = F.rtrim(F.concat(label, F.lit(" "), F.regexp_extract(hay, p, 1)))
        evidence = F.concat(F.lit(f"{where}: "), X.strip(hay)) if where else F.regexp_extract(hay, p, 0)
        return F.when(hay.rlike(p), X.bind(label, lambda l: found(
            url=page_url(), category="tech_fingerprint", value=F.concat(F.lit("Detected: "), l), confidence="low",
            pattern="recon", evidence=evidence, informational=True,
            context=F.concat(F.lit(f"{A.TECH} "), l, F.lit(f": {C.CVE_SEARCH}"), X.percent_quote(l)),
            stage_ord=C.STAGE_RECON, detector_ord=i)))

    return X.bind(seen, lambda s: F.array_compact(F.array(
        *[one(i, spec, s) for i, spec in enumerate(C.TECH_SIGNATURES)])))


def generators(window: int | None = None) -> Column:
    body = F.left(F.col("body"), F.lit(window)) if window else F.col("body")
    p = X.java_pattern(C.META_GENERATOR)
    return X.bind(F.regexp_extract(body, p, 0), lambda tag: F.when(tag != "", F.array(found(
        url=page_url(), category="tech_fingerprint",
        value=F.concat(F.lit("Detected via meta generator tag: "), F.regexp_extract(tag, p, 1)),
        confidence="low", pattern="recon", evidence=tag, informational=True, context=A.GENERATOR,
        stage_ord=C.STAGE_RECON, detector_ord=len(C.TECH_SIGNATURES)))))


def protections() -> Column:
    """Protection layers named by headers or cookies; cookie values are never shown.

    The short cookie mark of the last signature is a bare substring and noisy.
    """
    h = F.col("headers")
    names = sorted({n for _, hs, _ in C.WAF_SIGNATURES for n, _ in hs} | {"set-cookie"})
    seen = F.struct(*[F.lower(header(h, n)).alias(n.replace("-", "_")) for n in names])

    def one(i, spec, s):
        name, wanted, cookies = spec
        by_header = X.any_of([
            s[n.replace("-", "_")].isNotNull() if part is None
            else F.coalesce(s[n.replace("-", "_")].contains(part), F.lit(False)) for n, part in wanted])
        jar = F.coalesce(s["set_cookie"], F.lit(""))
        marks = F.array_compact(F.array(*[F.when(jar.contains(c), F.lit(c)) for c in cookies])) \
            if cookies else F.array().cast("array<string>")

        def shown(m):
            lines = F.filter(F.array(
                _lines(h, [n for n, _ in wanted]),
                F.when(F.size(m) > 0, F.concat(F.lit("Set-Cookie contains: "), F.array_join(m, ", ")))
                .otherwise(F.lit(""))), lambda l: l != "")
            return F.when(by_header | (F.size(m) > 0), found(
                url=page_url(), category="waf_detected", value=f"WAF/CDN detected: {name}", confidence="low",
                pattern="recon", evidence=F.array_join(lines, "\n"), informational=True, context=A.WAF,
                stage_ord=C.STAGE_RECON, detector_ord=20 + i))

        return X.bind(marks, shown)

    return X.bind(seen, lambda s: F.array_compact(F.array(
        *[one(i, spec, s) for i, spec in enumerate(C.WAF_SIGNATURES)])))


# Each check as a job of its own; a whole scan runs them together in one pass.

def missing_headers(responses: DataFrame) -> DataFrame:
    return detect(responses, header_gaps())


def weak_nosniff(responses: DataFrame) -> DataFrame:
    return detect(responses, nosniff_value())


def version_banners(responses: DataFrame) -> DataFrame:
    return detect(responses, banners())


def cookie_flags(responses: DataFrame) -> DataFrame:
    return detect(responses, weak_cookies())


def cors_issues(responses: DataFrame) -> DataFrame:
    return detect(responses.filter(F.col("probe") == "cors"), cors_policy())


def risky_methods(responses: DataFrame) -> DataFrame:
    return detect(responses.filter(F.col("probe") == "options"), advertised_methods())


def mixed_content(responses: DataFrame, window: int | None = None) -> DataFrame:
    return detect(responses, plain_resources(window))


def missing_sri(responses: DataFrame, window: int | None = None) -> DataFrame:
    return detect(responses, unpinned_resources(window))


def tech_fingerprints(responses: DataFrame, window: int | None = None) -> DataFrame:
    return detect(responses, technologies(window))


def meta_generators(responses: DataFrame, window: int | None = None) -> DataFrame:
    return detect(responses, generators(window))


def waf_detections(responses: DataFrame) -> DataFrame:
    return detect(responses, protections())
