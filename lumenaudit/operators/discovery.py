"""URL discovery over captures: links, seeds, candidates, crawl order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions import urls as U
from lumenaudit.functions.skew import first_per_key, salted_join
from lumenaudit.session import co_located, cut_lineage

_LINKING = (("a|link", "href"), ("script|img|iframe", "src"), ("form", "action"))
# One tag with its attributes; a bracket inside quotes does not end it.  Every loop is possessive and the end is
# optional, so a tag that was begun is always a match and no character is read twice, closed or not.
_TAG = rf"""(?i)<(?:{"|".join(t for t, _ in _LINKING)})(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


def _attribute(tags: str, name: str) -> str:
    """From the start of a tag over its other attributes up to the first one of that name."""
    other = rf"""[\s/=]*+(?!{name}\s*+=)[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+"""
    return rf"(?:{tags})(?=[\s/])(?:{other})*+[\s/=]*+{name}\s*+=\s*+"


# The value is quoted or bare.
_VALUE = rf"""(?i)^<(?:{"|".join(_attribute(*x) for x in _LINKING)})["']?+((?<=")[^"]*+|(?<=')[^']*+|(?<!["'])[^\s"'>]++)"""
_SKIPPED = ("#", "mailto:", "tel:", "javascript:", "data:")
# A relative path that needs no resolution: no dot segments, no doubled slashes, no special characters.
_PLAIN_VARIANT = re.compile(r"(?:(?!\.{1,2}(?:/|$))[^\s/?#;&:%\\]+/)*(?!\.{1,2}$)[^\s/?#;&:%\\]*$")


def links(pages: DataFrame, body: str = "body") -> DataFrame:
    """In-scope links of every page: ``target, src, dst``, once per page.

    Works within the row, so there is no shuffle.  Tags are cut out first and
    looked at one by one, in time linear in the page, well-formed or not.
    """
    tags = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(X.java_pattern(_TAG)), F.lit(0)))
    raw = F.transform(tags, lambda t: F.regexp_extract(t, X.java_pattern(_VALUE), 1))
    hrefs = F.filter(F.array_distinct(F.transform(raw, X.strip)),
                     lambda h: (h != "") & ~X.starts_with_any(h, _SKIPPED))
    d = pages.select("target", F.col("url").alias("src"), hrefs.alias("_hrefs"))
    full = U.resolve_all(F.col("src"), F.col("_hrefs"))
    kept = F.filter(F.array_distinct(full),
                    lambda u: (u.startswith("http://") | u.startswith("https://")) & U.in_scope(u, F.col("target")))
    return d.select("target", "src", F.explode(kept).alias("dst"))


def robots_paths(responses: DataFrame) -> DataFrame:
    """Paths named in robots.txt captures, resolved: ``target, url``."""
    d = responses.filter((F.col("status_code") == 200)
                         & (U.path(F.col("url")) == "/robots.txt"))
    d = d.select("target", F.explode(F.split("body", "\n")).alias("_l"))
    d = d.withColumn("_l", X.strip(F.col("_l")))
    d = d.filter(X.starts_with_any(F.lower(F.col("_l")), ("allow:", "disallow:", "sitemap:")))
    d = d.withColumn("_v", X.strip(X.after_first(F.col("_l"), ":")))
    d = d.filter((F.col("_v") != "") & (F.col("_v") != "/"))
    return d.select("target", U.resolve(F.col("target"), F.col("_v"), keep_fragment=True).alias("url")) \
        .filter(F.col("url").isNotNull()).distinct()


def sitemap_locs(responses: DataFrame) -> DataFrame:
    """In-scope locations in sitemap captures: ``target, url``."""
    d = responses.filter((F.col("status_code") == 200)
                         & U.path(F.col("url")).isin("/sitemap.xml", "/sitemap_index.xml"))
    found = F.regexp_extract_all("body", F.lit(X.java_pattern(r"(?i)<loc>\s*(.*?)\s*</loc>")), F.lit(1))
    d = d.select("target", F.explode(found).alias("url")).withColumn("url", X.strip(F.col("url")))
    return d.filter((F.col("url").startswith("http://") | F.col("url").startswith("https://"))
                    & U.in_scope(F.col("url"), F.col("target"))).distinct()


def _base(target: Column) -> Column:
    return F.regexp_replace(target, "/+$", "")


def common_seeds(targets: DataFrame) -> DataFrame:
    """The target itself, with a slash, and the usual paths: ``target, url``.

    A fixed list of under a hundred paths is exploded per target.
    """
    base = _base(F.col("target"))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    urls = F.array_distinct(F.array(
        base, F.concat(base, F.lit("/")), *[F.concat(origin, F.lit(p)) for p in C.COMMON_PATHS]))
    return targets.select("target", F.explode(urls).alias("url"))


def _clean_words(words) -> list[str]:
    out = []
    for w in words:
        w = w.strip().lstrip("/")
        if w and not w.startswith("#"):
            out.append(w)
    return out


def word_variants(words, extensions=None) -> list[str]:
    """Relative candidates of a word list, once each."""
    exts = [e.strip().lstrip(".") for e in (extensions or C.CANDIDATE_EXTENSIONS) if e and e.strip()]
    seen = {}
    for w in _clean_words(words):
        seen[w] = None
        if "." not in w.rsplit("/", 1)[-1]:
            seen[w + "/"] = None
            for e in exts:
                seen[f"{w}.{e}"] = None
    return list(seen)


def candidate_urls(targets: DataFrame, words, extensions=None) -> DataFrame:
    """Candidate URLs of a short word list: ``target, url``.

    The list becomes a constant array; to find which candidates of a long list
    exist use ``candidate_hits``, which never
    writes the product out.
    """
    variants = word_variants(words, extensions)
    plain = all(_PLAIN_VARIANT.match(v) for v in variants)
    every = F.explode(F.expr(f"array({', '.join(map(X.sql_text, variants))})")).alias("_v")
    d = targets.select("target").distinct() \
        .select("target", F.concat(_base(F.col("target")), F.lit("/")).alias("_b"), every)
    if plain:
        return d.select("target", F.concat("_b", "_v").alias("url"))
    href = F.concat(F.lit("./"), F.col("_v"))
    return d.select("target", U.resolve(F.col("_b"), href, keep_fragment=True, relative=True).alias("url")).distinct()


def candidate_hits(captures: DataFrame, words: DataFrame, extensions=None) -> DataFrame:
    """Captured URLs that some word would have generated: ``target, url, word``.

    Runs the generation backwards: a captured path can stem from at most a
    handful of words (itself, without its slash, without a known extension),
    which are looked up in ``words`` (column ``word``) by an equi-join.
    """
    exts = [e.strip().lstrip(".") for e in (extensions or C.CANDIDATE_EXTENSIONS) if e and e.strip()]
    base = F.concat(_base(F.col("target")), F.lit("/"))
    d = captures.select("target", "url", base.alias("_b")).filter(F.startswith("url", F.col("_b"))).distinct()
    rel = F.col("_rel")
    d = d.select("target", "url", F.substring(F.col("url"), F.length("_b") + 1, F.length("url")).alias("_rel"))

    def bare(c):
        return F.when((c != "") & ~F.substring_index(c, "/", -1).contains("."), c)

    def without(suffix):
        return F.when(rel.endswith(suffix), bare(F.expr(f"left(_rel, length(_rel) - {len(suffix)})")))

    origins = F.array_compact(F.array(
        F.when(rel != "", rel), without("/"), *[without("." + e) for e in exts]))
    d = d.select("target", "url", F.explode(F.array_distinct(origins)).alias("word"))
    w = words.select(F.regexp_replace(X.strip(F.col("word")), "^/+", "").alias("word"))
    w = w.filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()
    return salted_join(d, w, ["word"], "left_semi", F.col("url")).select("target", "url", "word")


def url_seeds(*sources: tuple[DataFrame, int]) -> DataFrame:
    """Union of URL sources, each with its priority: ``target, url, priority``, lowest wins."""
    out = None
    for df, priority in sources:
        d = df.select("target", "url", F.lit(priority).alias("priority"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("target", "url").agg(F.min("priority").alias("priority"))


def within_budget(seeds: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` URLs per target, by priority, then by URL."""
    return first_per_key(seeds, ["target"], [F.col("priority"), F.col("url")], budget, F.col("url"))


#: A page with more links than this is a hub; its links are spread over tasks.
HUB_LINKS = 10_000


def _linked(edges: DataFrame, hub_links: int):
    """What a level of the crawl links to, as a function of the level: ``target, url``, rows repeated.

    Links are hashed by their page once, the way levels are, and no level moves
    them again.  Those of hubs are cut in slices that stand apart, and only the
    hubs of a level are sent to their slices.
    """
    edges = cut_lineage(edges.select("target", "src", "dst"))
    page = ["target", "src"]
    hubs = edges.groupBy(*page).agg(F.count("*").alias("_n")).filter(F.col("_n") > hub_links)
    hubs = co_located(hubs.select(*page, F.ceil(F.col("_n") / hub_links).cast("int").alias("_slices")).repartition(*page))
    if hubs.isEmpty():
        plain, sliced = co_located(edges.repartition(*page)), None
    else:
        known = salted_join(edges, hubs, page, "left", F.col("dst"))
        sliced = known.filter(F.col("_slices").isNotNull()).withColumn("_slice", F.pmod(F.xxhash64("dst"), "_slices").cast("int"))
        sliced = co_located(sliced.drop("_slices").repartition(*page, "_slice"))
        plain = co_located(known.filter(F.col("_slices").isNull()).drop("_slices").repartition(*page))

    def of(level: DataFrame) -> DataFrame:
        front = level.select("target", F.col("url").alias("src"))
        found = plain.join(front, page, "left_semi")
        if sliced is not None:
            spread = front.join(hubs, page).select(*page, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
            found = found.unionByName(sliced.join(spread, [*page, "_slice"], "left_semi").drop("_slice"))
        return found.select("target", F.col("dst").alias("url"))

    return of


def crawl(seeds: DataFrame, edges: DataFrame, depth: int, budget: int | None = None, hub_links: int = HUB_LINKS) -> DataFrame:
    """Breadth-first order over captured links: ``target, url, depth``.

    ``seeds`` has ``target, url, priority``; ``edges`` is what ``links`` returns.
    Every level is checkpointed, so the plan does not grow with the depth and a
    lost executor does not restart the crawl.  Levels stay hashed by target and
    URL: what a level links to is shuffled once, to be told apart and held
    against all earlier levels; links and earlier levels stay where they are.
    With a ``budget`` each level takes at most what is left of it for the target.
    """
    level = seeds if budget is None else within_budget(seeds, budget)
    level = level.select("target", "url", F.lit(0).alias("depth"))
    if depth <= 0:
        return level
    level = co_located(level.repartition("target", "url"))
    if depth > 1:
        linked = _linked(edges, hub_links)
    else:  # read once: extracted and looked up in one pass
        def linked(front):
            front = front.select("target", F.col("url").alias("src"))
            return edges.join(front, ["target", "src"], "left_semi").select("target", F.col("dst").alias("url"))
    levels = [level]
    for d in range(1, depth + 1):
        found = linked(level).distinct()
        for earlier in levels:
            found = found.join(earlier.select("target", "url"), ["target", "url"], "left_anti")
        if budget is not None:
            used = reduce(DataFrame.unionByName, levels).groupBy("target").agg((F.lit(budget) - F.count("*")).alias("_left"))
            found = salted_join(found, used, ["target"], "inner", F.col("url")).filter(F.col("_left") > 0)
            found = first_per_key(found, ["target"], [F.col("url")], F.col("_left"), F.col("url"))
            found = found.repartition("target", "url")
        level = found.select("target", "url", F.lit(d).alias("depth"))
        if d < depth:
            level = co_located(level)
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
