"""Recognition of catch-all pages that answer every path with 200."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions.similarity import close_lengths, may_be_similar, nearly_same
from lumenaudit.functions.skew import hot_join, salted_join


def fingerprint(body: Column) -> Column:
    return X.page_fingerprint(body)


def signature(chars: int | None = C.SIMILARITY_CHARS) -> list[Column]:
    """Fingerprint ``fp`` and ``head`` of a capture's body; with ``chars=None`` the head is the whole body."""
    head = F.col("body") if chars is None else F.left("body", F.lit(chars))
    return [fingerprint(F.col("body")).alias("fp"), head.alias("head")]


def _signed(captures: DataFrame, chars: int | None = C.SIMILARITY_CHARS) -> DataFrame:
    """Captures with their signatures, which may be columns of theirs already; bodies are read if not."""
    if "fp" in captures.columns:
        return captures
    return captures.select("target", "url", "status_code", "body_bytes", *signature(chars))


def baseline_signatures(responses: DataFrame, chars: int | None = C.SIMILARITY_CHARS) -> DataFrame:
    """Status, length, fingerprint and head of the captured random-path answers."""
    return _signed(responses.filter(F.col("probe") == "baseline"), chars).select("target", "status_code", "body_bytes", "fp", "head")


def exact_matches(pages: DataFrame, baseline: DataFrame, counted: bool = False) -> DataFrame:
    """Pages whose fingerprint equals a baseline's: ``target, url``.

    A catch-all page may be most of a target, so the equal keys are salted.  With ``counted`` there may be as many
    baselines as pages, and ``n_baselines`` says how many a page equals; of an URL captured more than once the most.
    """
    key = ["target", "status_code", "fp"]
    known = baseline.filter(F.col("fp").isNotNull()).select(*key)
    seen = _signed(pages).select("target", "url", "status_code", "fp").filter(F.col("fp").isNotNull())
    if counted:
        hit = hot_join(seen, known.groupBy(*key).agg(F.count("*").alias("n_baselines")), key, "inner", F.col("url"))
        return hit.groupBy("target", "url").agg(F.max("n_baselines").alias("n_baselines"))
    hit = salted_join(seen, known.distinct(), key, "left_semi", F.col("url"))
    return hit.select("target", "url").distinct()


def _bucket(length: Column) -> Column:
    """Length class: 32 bytes wide up to 256, then 15 % each."""
    return F.when(length < 256, F.floor(length / 32)).otherwise(
        8 + F.floor(F.log(F.greatest(length, F.lit(256)) / 256.0) / F.log(F.lit(1.15)))).cast("int")


def head_pairs(pages: DataFrame, baseline: DataFrame) -> DataFrame:
    """Pages with the heads of baselines they may be similar to: ``target, url, _head, _bhead``.

    Lengths are put in classes, a baseline in all classes its window touches, so
    the join is an equi-join that meets only pages of about that length; the
    exact window is checked on top.  Pairs whose characters, order aside, overlap
    too little are gone.
    """
    blen = F.col("_blen")
    slack = F.greatest(F.lit(32), F.floor(blen * 0.15)).cast("long")
    base = baseline.filter((F.col("body_bytes") > 0) & (F.length("head") > 0)) \
        .select("target", "status_code", F.col("body_bytes").alias("_blen"), F.col("head").alias("_bhead")).distinct()
    base = base.withColumn("_cls", F.explode(F.sequence(
        _bucket(F.greatest(blen - slack, F.lit(0))), _bucket(blen + slack))))
    cand = pages.select("target", "url", "status_code", "body_bytes", F.col("head").alias("_head"),
                        _bucket(F.col("body_bytes")).alias("_cls"))
    pairs = salted_join(cand, base, ["target", "status_code", "_cls"], "inner", F.col("url"))
    pairs = pairs.filter((F.abs(F.col("body_bytes") - blen) <= slack) & close_lengths("_head", "_bhead"))
    may_be = (F.col("_head") == F.col("_bhead")) | may_be_similar("_head", "_bhead")
    return pairs.filter(may_be).select("target", "url", "_head", "_bhead")


def similar_matches(pages: DataFrame, baseline: DataFrame, chars: int | None = C.SIMILARITY_CHARS) -> DataFrame:
    """Pages nearly the same as a baseline of close length: ``target, url``.

    The character comparison runs in Arrow batches on the pairs that
    ``head_pairs`` leaves; equal heads are not sent there.  ``chars`` has to be
    that of the baseline's signatures; with None whole bodies are compared, so
    that a page with a baseline's head and another tail is not a match.
    """
    pairs = head_pairs(_signed(pages, chars), baseline)
    unlike = F.when(F.col("_head") != F.col("_bhead"), F.col("_head"))
    return pairs.filter(nearly_same(unlike, F.col("_bhead"))).select("target", "url").distinct()


def soft404_pages(pages: DataFrame, baseline: DataFrame, chars: int | None = C.SIMILARITY_CHARS) -> DataFrame:
    """All pages recognised as catch-all, by either rule: ``target, url``."""
    exact = exact_matches(pages, baseline)
    return exact.unionByName(similar_matches(pages, baseline, chars)).distinct()


def drop_soft404(findings: DataFrame, soft404: DataFrame, affected: Column | None = None) -> DataFrame:
    """Findings without those on catch-all pages (``target, url``).

    ``affected`` limits the removal to some findings.  Meant for findings, which
    are few: applying it to them instead of to the captures keeps page bodies
    out of the shuffle.
    """
    pages = soft404.select("target", "url").withColumn("_soft", F.lit(True))
    gone = F.coalesce("_soft", F.lit(False))
    if affected is not None:
        gone = gone & affected
    return findings.join(pages, ["target", "url"], "left").filter(~gone).select(*findings.columns)
