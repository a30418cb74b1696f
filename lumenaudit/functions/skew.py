"""Joins and rankings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
HOT_ROWS = 100_000     # rows of one key that a task may well take


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
                spread: Column, salts: int = SALTS, extra: Column | None = None) -> DataFrame:
    """Equi-join of a large ``left`` with a ``right`` that has few rows per key.

    Rows of one hot key on the left are spread over ``salts`` tasks by the hash
    of ``spread``; the right side is repeated once per salt.  ``extra`` is a
    further condition over both sides (columns must be named apart).
    """
    l = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = on + ["_salt"]
    if extra is None:
        return l.join(r, keys, how).drop("_salt")
    r = r.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in r.columns])
    cond = extra
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    out = l.join(r, cond, how)
    return out.drop("_salt", *[f"_r_{k}" for k in keys])


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
             spread: Column, hot: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``salted_join`` for a right side of as many keys as the left: only keys with more than ``hot`` rows are salted.

    The left is read twice; there is at most one such key for every ``hot`` rows, so they can be broadcast.
    """
    many = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(*on, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")
    l = left.join(F.broadcast(many), on, "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(0)
    r = right.join(F.broadcast(many), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return l.join(r, on + ["_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, key: list[str], order: list, limit, spread: Column,
                  salts: int = SALTS) -> DataFrame:
    """The first ``limit`` rows of every key in ``order``, exactly.

    Each key is ranked in ``salts`` slices first, and only the slices' own first
    rows meet in one task, so a hot key never arrives there whole.  ``limit`` is
    a number or a column of ``df``.
    """
    n = limit if isinstance(limit, Column) else F.lit(limit)
    sliced = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*key, "_salt").orderBy(*order)
    outer = Window.partitionBy(*key).orderBy(*order)
    return (sliced.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= n)
            .withColumn("_rank", F.row_number().over(outer)).filter(F.col("_rank") <= n)
            .drop("_salt", "_rank"))
