"""Findings: enrichment, de-duplication, counts and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.advice import REMEDIATION
from lumenaudit.functions.skew import SALTS
from lumenaudit.schemas import FINDING_COLUMNS


def _lookup(table: dict, key: Column) -> Column:
    """A fixed table of a few dozen entries as a constant map, so no join is needed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def risk_of(category: Column) -> Column:
    return F.coalesce(_lookup(C.RISK, category), F.lit(C.DEFAULT_RISK))


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def enrich(findings: DataFrame) -> DataFrame:
    """Fills weakness class and advice where a finding has none of its own."""
    cat = F.col("category")
    return findings.withColumns({
        "cwe_id": F.coalesce("cwe_id", _lookup(C.CWE, cat), F.lit(C.DEFAULT_CWE)),
        "remediation": F.coalesce("remediation", _lookup(REMEDIATION, cat), F.lit("")),
        "evidence": F.coalesce("evidence", F.lit("")),
        "informational": F.coalesce("informational", F.lit(False)),
    })


def deduplicate(findings: DataFrame) -> DataFrame:
    """First finding per target, URL, category and whole value.

    A minimum over an ordered struct: it combines on the map side, so a value
    repeated in a third of all rows arrives once per task.
    """
    order = ["stage_ord", "detector_ord", "match_ord"]
    rest = [c for c in findings.columns if c not in order]
    key = ["target", "url", "category", "value"]
    d = findings.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in key])).alias("_f"))
    return d.select(*[F.col(c) if c in key else F.col(f"_f.{c}") for c in findings.columns])


def finalise(*frames: DataFrame) -> DataFrame:
    """Union, enrichment and de-duplication in one go."""
    return deduplicate(enrich(union_findings(*frames))).select(*FINDING_COLUMNS)


def category_counts(findings: DataFrame) -> DataFrame:
    """``target, category, risk, n``."""
    d = findings.groupBy("target", "category").agg(F.count("*").alias("n"))
    return d.select("target", "category", risk_of(F.col("category")).alias("risk"), "n")


def totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("target").agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.col("informational")).alias("informational_findings"),
        F.count_if(~F.col("informational")).alias("actionable_findings"))


def summaries(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Totals, category counts, score and verdict per target, from one pass over the findings.

    The first grouping leaves at most one row per target and category, so what
    the second one gathers is bounded by the number of categories.  The score
    is kept in tenths: exact and independent of order.  Targets without
    findings get the verdict NONE.
    """
    tenths = F.coalesce(_lookup(C.CONFIDENCE_TENTHS, F.col("confidence")), F.lit(4))
    todo = ~F.col("informational")
    per = findings.groupBy("target", "category").agg(
        F.count("*").alias("n"), F.count_if(todo).alias("_todo"), F.max(F.when(todo, tenths)).alias("_conf"))
    risk = risk_of(F.col("category"))
    weight = F.coalesce(_lookup(C.RISK_WEIGHT, risk), F.lit(0))
    some = F.col("_todo") > 0
    per = per.groupBy("target").agg(
        F.sum("n").alias("total_findings"), F.sum(F.col("n") - F.col("_todo")).alias("informational_findings"),
        F.sum("_todo").alias("actionable_findings"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"),
        F.sum(F.when(some, weight * F.least("_todo", F.lit(C.SCORE_VOLUME_CAP)) * F.col("_conf"))).alias("_score"),
        F.bool_or(some & (risk == "HIGH")).alias("_high"),
        F.bool_or(some & (risk == "HIGH") & (F.col("_conf") >= 7)).alias("_severe"))
    d = targets.select("target").distinct().join(per, "target", "left")
    score = F.coalesce("_score", F.lit(0)).cast("long")
    high, severe = F.coalesce("_high", F.lit(False)), F.coalesce("_severe", F.lit(False))
    verdict = (F.when(severe & (score >= 80), "CRITICAL")
               .when(severe, "HIGH")
               .when(score >= 50, "HIGH")
               .when(high, "MEDIUM")
               .when(score >= 25, "MEDIUM")
               .when(score > 0, "LOW")
               .otherwise("NONE"))
    zero = F.lit(0).cast("long")
    return d.select(
        "target", *[F.coalesce(c, zero).alias(c) for c in
                    ("total_findings", "informational_findings", "actionable_findings")],
        F.coalesce("category_counts", F.from_json(F.lit("{}"), "map<string,bigint>")).alias("category_counts"),
        score.alias("score_tenths"), verdict.alias("risk_assessment"))


def overall_risk(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Verdict per target."""
    return summaries(findings, targets).select("target", "score_tenths", "risk_assessment")


def critical_list(findings: DataFrame, size: int = C.CRITICAL_LIST_SIZE, salts: int = SALTS) -> DataFrame:
    """First critical findings per target, with how many more there are.

    Ranked and counted in slices of a target, so that one pass is enough and no
    task sees a large target whole.
    """
    order = _lookup({c: i for i, c in enumerate(C.CRITICAL_CATEGORIES)}, F.col("category"))
    d = findings.filter(F.col("category").isin(*C.CRITICAL_CATEGORIES)) \
        .select("target", "url", "category", "value", "stage_ord", "detector_ord", "match_ord",
                order.alias("_ord"), F.pmod(F.xxhash64("url"), F.lit(salts)).alias("_salt"))
    by = [F.col(c) for c in ("_ord", "stage_ord", "url", "detector_ord", "match_ord", "value")]
    one_slice, whole = Window.partitionBy("target", "_salt"), Window.partitionBy("target")
    d = d.withColumns({"_rank": F.row_number().over(one_slice.orderBy(*by)),
                       "_size": F.count("*").over(one_slice)}).filter(F.col("_rank") <= size)
    d = d.withColumns({"position": F.row_number().over(whole.orderBy(*by)),
                       "_n": F.sum(F.when(F.col("_rank") == 1, F.col("_size"))).over(whole)})
    return d.filter(F.col("position") <= size).select(
        "target", "position", "url", "category", "value", F.greatest(F.col("_n") - size, F.lit(0)).alias("more"))


def scan_stats(responses: DataFrame) -> DataFrame:
    """``target, urls_scanned, errors``; a capture without a status is an error."""
    return responses.groupBy("target").agg(
        F.count_distinct("url").alias("urls_scanned"),
        F.count_if(F.col("status_code").isNull()).alias("errors"))
