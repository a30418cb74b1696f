"""Findings from URLs and their query parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import advice as A
from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions import urls as U
from lumenaudit.schemas import detect, found


def query_params(df: DataFrame, url: str = "url", keep_blank: bool = True) -> DataFrame:
    """One row per query parameter: the input's columns, ``param_index``, ``key``, ``value``."""
    d = df.filter(F.col(url).contains("?"))
    d = d.select(*df.columns, F.posexplode(U.query_pairs(F.col(url), keep_blank)).alias("param_index", "_p"))
    return d.select(*df.columns, "param_index", "_p.key", "_p.value")


def steered_redirect(strict: bool = False) -> Column:
    """A redirect that leaves the scope and was steered by a query parameter.

    The first such parameter is reported.  A value of slashes only counts as
    contained in any address unless ``strict``.
    """
    final, host = F.col("final_url"), U.authority(F.col("final_url"))

    def steers(p):
        bare = F.regexp_replace(p["value"], "/+$", "")
        inside = final.contains(bare)
        if strict:
            inside = inside & (bare != "")
        return F.lower(p["value"]).contains(host) | inside

    left = F.col("redirected") & (U.query(F.col("url")) != "") & ~U.in_scope(final, F.col("target")) & (host != "")
    hit = F.get(F.filter(U.query_pairs(F.col("url"), keep_blank=False), steers), F.lit(0))
    return F.when(left, X.bind(hit, lambda p: F.when(p.isNotNull(), F.array(found(
        url=F.col("url"), category="open_redirect",
        value=F.concat(F.lit("Parameter '"), p["key"], F.lit("' steers redirect to external host: "), host),
        confidence="medium", pattern="redirect_chain", context=F.concat(F.col("url"), F.lit(" -> "), final),
        stage_ord=C.STAGE_CRAWL, detector_ord=120)))))


def open_redirects(responses: DataFrame, strict: bool = False) -> DataFrame:
    return detect(responses.filter("redirected"), steered_redirect(strict))


def fetching_params() -> Column:
    """Parameters whose name suggests that the server fetches their value."""
    pairs = F.transform(U.query_pairs(F.col("url")), lambda p, i: F.struct(p["key"].alias("key"), i.alias("i")))
    named = F.filter(pairs, lambda p: X.matches(X.strip(p["key"]), C.URL_PARAM_NAME))
    return F.when(F.col("url").contains("?"), F.transform(named, lambda p: found(
        url=F.col("url"), category="ssrf_candidate",
        value=F.concat(F.lit("Parameter '"), p["key"],
                       F.lit("' accepts what looks like a URL - possible SSRF sink")),
        confidence="low", pattern="active_scan", evidence=F.concat(F.lit("Parameter name: "), p["key"]),
        informational=True, context=A.SSRF, stage_ord=C.STAGE_ACTIVE, detector_ord=4, match_ord=p["i"])))


def ssrf_candidates(pages: DataFrame) -> DataFrame:
    return detect(pages, fetching_params())
