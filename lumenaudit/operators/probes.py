"""Triage of results recorded by an authorised test.

These jobs read recorded responses; nothing here builds or sends a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.schemas import finding


def _kind(probes: DataFrame, check: str) -> DataFrame:
    return probes.filter((F.col("check") == check) & F.col("body").isNotNull())


def _url() -> Column:
    return F.coalesce(F.col("test_url"), F.col("url"))


def _injected() -> Column:
    return F.concat(F.lit("Injected: "), F.col("payload"))


def reflections(probes: DataFrame) -> DataFrame:
    """The recorded payload occurs unescaped in the recorded body."""
    d = _kind(probes, "xss").filter(F.contains(F.col("body"), F.col("payload")))
    return finding(d, url=_url(), category="xss_reflected",
                   value=F.concat(F.lit("Reflected XSS: parameter '"), F.col("param"),
                                  F.lit("' echoes an unescaped HTML payload")),
                   confidence="high", pattern="active_scan", status_code=F.col("status_code"),
                   evidence=_injected(), context=_injected(),
                   stage_ord=C.STAGE_ACTIVE, detector_ord=0, match_ord=F.col("param_index"))


def database_errors(probes: DataFrame) -> DataFrame:
    """A database error that the unmodified page did not show."""
    def first_error(c: Column) -> Column:
        """What the first signature matches; tried only where the text holds what it takes, which is far cheaper to see."""
        def within(low):
            gated = zip(C.DB_ERROR_SIGNATURES, C.DB_ERROR_NEEDLES, strict=True)
            return F.coalesce(*[F.when(X.any_of([F.contains(low, F.lit(n)) for n in needles]),
                                       F.nullif(F.regexp_extract(c, X.java_pattern(p), 0), F.lit(""))) for p, needles in gated])
        return X.bind(X.folded(c), within)

    d = _kind(probes, "sqli").filter(first_error(F.col("body")).isNotNull() & first_error(F.coalesce("baseline_body", F.lit(""))).isNull())
    d = d.withColumn("_err", first_error(F.col("body")))
    return finding(d, url=_url(), category="sqli_error",
                   value=F.concat(F.lit("Possible SQL injection: parameter '"), F.col("param"),
                                  F.lit("' triggers a DB error signature when a single quote is appended")),
                   confidence="high", pattern="active_scan", status_code=F.col("status_code"),
                   evidence=F.concat(F.lit("Injected payload: "), X.python_repr(F.col("payload")),
                                     F.lit("\nMatched DB error signature: "), X.python_repr(F.col("_err"))),
                   context="Injected payload appended: '",
                   stage_ord=C.STAGE_ACTIVE, detector_ord=1, match_ord=F.col("param_index"))


def file_disclosures(probes: DataFrame) -> DataFrame:
    d = _kind(probes, "traversal").filter(
        X.matches(F.col("param"), C.FILE_PARAM_HINT) & X.matches(F.col("body"), C.PASSWD_LINE))
    return finding(d, url=_url(), category="path_traversal",
                   value=F.concat(F.lit("Path traversal / LFI: parameter '"), F.col("param"),
                                  F.lit("' returns /etc/passwd contents")),
                   confidence="high", pattern="active_scan", status_code=F.col("status_code"),
                   evidence=_injected(), context=_injected(),
                   stage_ord=C.STAGE_ACTIVE, detector_ord=2, match_ord=F.col("param_index"))


def _shows_number(body: Column, number: Column) -> Column:
    """The number occurs as a whole run of digits; the run list is built only on a plain hit."""
    runs = F.regexp_extract_all(body, F.lit(X.java_pattern(r"\d+")), F.lit(0))
    return F.when(F.contains(body, number), F.array_contains(runs, number)).otherwise(F.lit(False))


def template_evaluations(probes: DataFrame) -> DataFrame:
    """The product of the recorded operands appears and was not there before.

    The first attempt that shows it is reported per parameter.
    """
    product = (F.col("a") * F.col("b")).cast("string")
    original = F.coalesce("original", F.lit(""))
    d = _kind(probes, "ssti").withColumn("_n", product)
    d = d.filter(_shows_number(F.col("body"), F.col("_n"))
                 & ~_shows_number(F.coalesce("baseline_body", F.lit("")), F.col("_n"))
                 & ~F.contains(original, F.col("a").cast("string"))
                 & ~F.contains(original, F.col("b").cast("string")))
    d = d.groupBy("target", "url", "param_index").agg(F.min(F.struct(
        "attempt", _url().alias("u"), "param", "payload", "_n", "status_code")).alias("f"))
    injected = F.concat(F.lit("Injected: "), F.col("f.payload"))
    return finding(d, url=F.col("f.u"), category="ssti",
                   value=F.concat(F.lit("Possible Server-Side Template Injection: parameter '"), F.col("f.param"),
                                  F.lit("' evaluates '"), F.col("f.payload"), F.lit("' to "), F.col("f._n")),
                   confidence="high", pattern="active_scan", status_code=F.col("f.status_code"),
                   evidence=F.concat(injected, F.lit("\nEvaluated to: "), F.col("f._n")), context=injected,
                   stage_ord=C.STAGE_ACTIVE, detector_ord=3, match_ord=F.col("param_index"))
