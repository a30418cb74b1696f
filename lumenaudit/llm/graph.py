"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and none is the smaller end of another: nothing changes any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns ``node`` and ``root``.

    Large-star and small-star steps alternate until stars are left; each step
    is a minimum per node, which combines on the map side, and a join.  Edges
    are written to the shared folder after every round.  Null ends are ignored.
    """
    both = edges.select(F.col("u"), F.col("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current = stored(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(current):
        # large star: every larger neighbour, and only those, goes to the smallest one
        mirrored = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _smallest(mirrored).select("u", F.least("u", "m").alias("m"))
        large = mirrored.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")
        # small star: every smaller neighbour, and the node itself, goes to the smallest one
        low = _smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        current = stored(small.distinct(), "edges")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
