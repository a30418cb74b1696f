"""Checks on single endpoints of a target: TLS, security.txt, GraphQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import advice as A
from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.schemas import finding


def tls_issues(observations: DataFrame, as_of: datetime | str) -> DataFrame:
    """Certificate and protocol problems in TLS observations, dated ``as_of`` (UTC)."""
    o = observations
    expiry = F.try_to_timestamp(F.regexp_replace("not_after", " +", " "), F.lit("MMM d HH:mm:ss yyyy z"))
    now = F.lit(str(as_of)).cast("timestamp")
    days = F.floor((F.unix_timestamp(expiry) - F.unix_timestamp(now)) / 86400).cast("int")
    d = o.withColumn("_days", days)
    shown = F.concat(F.lit("TLS protocol: "), F.coalesce("protocol", F.lit("None")), F.lit("\nnotAfter: "),
                     F.coalesce("not_after", F.lit("unknown")))
    dated = F.concat(F.lit("notAfter: "), F.col("not_after"))

    def issue(cond, ord_, value, confidence, context, evidence=shown):
        return F.when(cond, F.struct(
            F.lit(ord_).alias("ord"), value.alias("value"), F.lit(confidence).alias("confidence"),
            context.alias("context"), evidence.alias("evidence")))

    failed = F.col("verify_error").isNotNull()
    issues = F.array_compact(F.array(
        issue(failed, 50, F.concat(F.lit("TLS certificate validation failed: "), F.col("verify_error")), "high",
              F.col("verify_error"),
              F.concat(F.lit("Host: "), F.col("host"), F.lit(":"), F.col("port"),
                       F.lit("\nverify: enabled\n"), F.col("verify_error"))),
        issue(~failed & F.col("protocol").isin(*C.WEAK_TLS), 51,
              F.concat(F.lit("Weak TLS protocol negotiated: "), F.col("protocol")), "high", F.lit(A.TLS_PROTOCOL)),
        issue(~failed & (F.col("_days") < 0), 52,
              F.concat(F.lit("TLS certificate expired "), -F.col("_days"), F.lit(" day(s) ago")), "high", dated),
        issue(~failed & F.col("_days").between(0, C.TLS_WARN_DAYS), 53,
              F.concat(F.lit("TLS certificate expires in "), F.col("_days"), F.lit(" day(s)")), "medium", dated)))
    d = d.select("target", F.inline(issues))
    return finding(d, url=F.col("target"), category="tls_issues", value=F.col("value"),
                   confidence=F.col("confidence"), pattern="security_audit", evidence=F.col("evidence"),
                   context=F.col("context"), remediation=F.col("context"),
                   stage_ord=C.STAGE_AUDIT, detector_ord=F.col("ord"))


def has_text() -> Column:
    """Whether a capture's body holds more than blanks."""
    return F.col("body").rlike(r"(?U)[^\s\x1c-\x1f]")


def shows_schema() -> Column:
    """Whether a capture's body answers an introspection query with a schema."""
    schema = F.coalesce(
        F.to_json(F.expr("try_variant_get(try_parse_json(body), '$.data.__schema', 'variant')")),
        F.get_json_object("body", "$.data.__schema"))
    return X.bind(schema, lambda s: s.isNotNull() & ~s.isin("null", "false", "0", "0.0", '""', "", "{}", "[]"))


def _security_txt(filled: Column) -> list[Column]:
    """What is known of a target's security.txt, as aggregates that can be merged."""
    base = F.regexp_replace("target", "/+$", "")
    tried = F.col("probe") == "securitytxt"
    line = F.concat(F.col("status_code"), F.lit(" "), F.col("url"))
    return [F.bool_or(tried & (F.col("status_code") == 200) & filled).alias("answered"),
            *[F.min(F.when(tried & (F.col("url") == F.concat(base, F.lit(p))), line)).alias(f"tried_{i}") for i, p in enumerate(C.SECURITY_TXT_PATHS)]]


def _graphql(shown: Column) -> Column:
    """The first endpoint of a target, in path order, that shows its schema; can be merged by the minimum."""
    base = F.regexp_replace("target", "/+$", "")
    order = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(C.GRAPHQL_PATHS))):
        order = F.when(F.col("url") == F.concat(base, F.lit(p)), F.lit(i)).otherwise(order)
    hit = (F.col("probe") == "graphql") & (F.col("status_code") == 200) & order.isNotNull() & shown
    return F.min(F.when(hit, F.struct(order.alias("ord"), "url", "status_code"))).alias("endpoint")


def endpoint_facts(responses: DataFrame, filled: Column | None = None, shown: Column | None = None) -> DataFrame:
    """One narrow row per target: ``answered``, ``tried_0`` …, ``endpoint``.

    Rows of parts of the captures merge by ``merged_facts``.  Without columns that already say whether a body is
    ``filled`` and whether a schema is ``shown`` the bodies are read.
    """
    return responses.groupBy("target").agg(*_security_txt(has_text() if filled is None else filled), _graphql(shows_schema() if shown is None else shown))


def merged_facts() -> list[Column]:
    """Aggregates that merge rows of ``endpoint_facts``."""
    return [F.bool_or("answered").alias("answered"), *[F.min(f"tried_{i}").alias(f"tried_{i}") for i in range(len(C.SECURITY_TXT_PATHS))],
            F.min("endpoint").alias("endpoint")]


def facts_findings(facts: DataFrame) -> DataFrame:
    """Missing security.txt and open introspection from the facts of all targets."""
    return _missing(facts).unionByName(_introspection(facts))


def security_txt_missing(responses: DataFrame) -> DataFrame:
    """Targets without a usable security.txt, from captures of probe kind ``securitytxt``.

    The list of targets reads no other column, and bodies are read of that
    probe kind only; both sides are aggregated before they meet.
    """
    seen = responses.filter(F.col("probe") == "securitytxt").groupBy("target").agg(*_security_txt(has_text()))
    return _missing(responses.select("target").distinct().join(seen, "target", "left"))


def _missing(facts: DataFrame) -> DataFrame:
    d = facts.filter(~F.coalesce("answered", F.lit(False)))
    evidence = F.array_join(F.array(*[F.col(f"tried_{i}") for i in range(len(C.SECURITY_TXT_PATHS))]), "\n")
    return finding(d, url=F.col("target"), category="security_txt_missing",
                   value="No security.txt found at /.well-known/security.txt or /security.txt",
                   confidence="low", pattern="security_audit", evidence=evidence,
                   context=A.SECURITY_TXT, remediation=A.SECURITY_TXT,
                   stage_ord=C.STAGE_AUDIT, detector_ord=60)


def graphql_introspection(responses: DataFrame) -> DataFrame:
    """First endpoint per target, in path order, that answers an introspection query."""
    d = responses.filter((F.col("probe") == "graphql") & (F.col("status_code") == 200))
    return _introspection(d.groupBy("target").agg(_graphql(shows_schema())))


def _introspection(facts: DataFrame) -> DataFrame:
    d = facts.filter(F.col("endpoint").isNotNull())
    return finding(d, url=F.col("endpoint.url"), category="graphql_introspection",
                   value="GraphQL introspection is enabled, exposing the full API schema",
                   confidence="high", pattern="security_audit",
                   evidence=F.concat(F.lit("POST "), F.col("endpoint.url"), F.lit("\nstatus: "),
                                     F.col("endpoint.status_code")),
                   context=A.GRAPHQL, remediation=A.GRAPHQL, stage_ord=C.STAGE_AUDIT, detector_ord=70)
