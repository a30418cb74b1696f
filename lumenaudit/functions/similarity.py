"""Page similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenaudit.catalog import SIMILARITY_MIN
from lumenaudit.functions.text import bind


def character_counts(text: Column) -> Column:
    """How often each character stands in a text: a map, as wide as the alphabet."""
    return F.map_from_entries(F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: F.struct(
        c, F.length(text) - F.length(F.replace(text, c, F.lit(""))))))


def close_lengths(a: str, b: str) -> Column:
    """Whether two texts, neither empty, may be similar by their lengths."""
    la, lb = F.length(a), F.length(b)
    return (la > 0) & (lb > 0) & ((F.lit(2.0) * F.least(la, lb)) / (la + lb) >= SIMILARITY_MIN)


def may_be_similar(a: str, b: str) -> Column:
    """Whether two texts reach the similarity bound if the order of their characters is left aside.

    Exact upper bounds of the ratio, the cheap one by lengths first.
    """
    total = F.length(a) + F.length(b)
    common = bind(character_counts(F.col(b)), lambda others: F.aggregate(
        F.map_entries(character_counts(F.col(a))), F.lit(0),
        lambda n, e: n + F.least(e["value"], F.coalesce(F.element_at(others, e["key"]), F.lit(0)))))
    return F.when(close_lengths(a, b), (F.lit(2.0) * common) / total >= SIMILARITY_MIN).otherwise(False)


@F.pandas_udf(T.BooleanType())
def nearly_same(candidate: pd.Series, base: pd.Series) -> pd.Series:
    """Whether two texts reach the similarity bound in order; for pairs that may.

    A null candidate stands for the base itself.  A pair that repeats in a batch is compared once.
    """
    known: dict[tuple[str | None, str], bool] = {}

    def one(pair):
        if pair not in known:
            known[pair] = pair[0] is None or difflib.SequenceMatcher(None, *pair).ratio() >= SIMILARITY_MIN
        return known[pair]

    return pd.Series([one(pair) for pair in zip(candidate, base)], dtype=bool)
