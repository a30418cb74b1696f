"""Crawl levels stay where they are: links are shuffled once, hubs in slices."""

import random

import pytest

from pyspark.sql import functions as F

from lumenaudit.operators import discovery

EDGES, SEEDS = "target string, src string, dst string", "target string, url string, priority int"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def walk(seeds, edges, depth):
    seen = {s[:2]: 0 for s in seeds}
    for d in range(1, depth + 1):
        seen.update({(t, y): d for t, x, y in edges if seen.get((t, x), d) == d - 1 and (t, y) not in seen})
    return seen


@pytest.mark.parametrize("hub_links", [1, 4, 10_000])
def test_hubs_change_nothing(spark, no_broadcast, hub_links):
    rnd = random.Random(hub_links)
    edges = [(t, f"p{rnd.randrange(12)}", f"p{rnd.randrange(90)}") for t in ("a", "b") for _ in range(120)]
    edges += edges[:30] + [("a", None, "p1"), ("a", "p1", None), (None, "p1", "p2")]  # repeated and empty links
    seeds = [("a", "p1", 0), ("b", "p3", 0), ("b", "p4", 2), ("c", "p1", 0)]
    whole = [e for e in edges if None not in e]
    got = discovery.crawl(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(edges, EDGES).filter("dst IS NOT NULL"), 4, hub_links=hub_links)
    rows = [((r.target, r.url), r.depth) for r in got.collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == walk(seeds, whole, 4)


def test_a_level_shuffles_what_it_finds_only(spark, no_broadcast):
    edges = spark.range(2000).selectExpr("'t' AS target", "cast(id % 400 AS string) AS src", "cast(id % 977 AS string) AS dst")
    last = discovery.crawl(spark.createDataFrame([("t", "1", 0)], SEEDS), edges, 3)
    plan = plan_of(last)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 4, plan
    assert last.count() == last.select("url").distinct().count()


def test_a_hub_of_a_million_links(spark, no_broadcast):
    n = 1_000_000
    edges = spark.range(n).selectExpr("'t' AS target", "CASE WHEN id = 0 THEN 'home' ELSE 'hub' END AS src",
                                      "CASE WHEN id = 0 THEN 'hub' ELSE concat('p', id) END AS dst")
    got = discovery.crawl(spark.createDataFrame([("t", "home", 0)], SEEDS), edges, 2)
    assert {r.depth: r["count"] for r in got.groupBy("depth").count().collect()} == {0: 1, 1: 1, 2: n - 1}
    # the hub's links stand in slices, not in one task
    hubs = got.withColumn("part", F.spark_partition_id()).filter("depth = 2").groupBy("part").count()
    assert hubs.count() > 1


def test_empty_links_and_seeds(spark):
    none = spark.createDataFrame([], EDGES)
    seeds = spark.createDataFrame([("t", "u", 0)], SEEDS)
    assert [tuple(r) for r in discovery.crawl(seeds, none, 2).collect()] == [("t", "u", 0)]
    assert discovery.crawl(spark.createDataFrame([], SEEDS), none, 2).count() == 0


def test_adaptive_planning_is_on_again(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    discovery.crawl(spark.createDataFrame([("t", "u", 0)], SEEDS), spark.createDataFrame([("t", "u", "v")], EDGES), 2).collect()
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
