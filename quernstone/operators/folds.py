"""Keyed folds with functions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a key are folded in before the parts are combined.
PARTS = 64
Step = Callable[[Column, Column], Column]


def aggregate_by_key(df: DataFrame, key: str, value: str, zero: Column, seq: Step, comb: Step, into: str = "out", parts: int = PARTS) -> DataFrame:
    """``(key, into)``: ``seq`` folds a key's values into ``zero``, ``comb`` folds what that gives.

    The values of a key are dealt into ``parts`` by chance and each part is folded by itself, so that a hot
    key is spread; so ``seq`` and ``comb`` must not depend on an order, and ``zero`` must add nothing. Sums,
    counts and extremes have aggregates of their own, which combine before the shuffle.
    """
    part = (F.rand(7) * parts).cast("int")
    partial = df.select(F.col(key).alias("key"), F.col(value).alias("value"), part.alias("part")).groupBy("key", "part").agg(F.collect_list("value").alias("values"))
    folded = partial.select("key", F.aggregate("values", zero, seq).alias("folded")).groupBy("key").agg(F.collect_list("folded").alias("folded"))
    return folded.select(F.col("key").alias(key), F.aggregate("folded", zero, comb).alias(into))


def fold_by_key(df: DataFrame, key: str, value: str, zero: Column, merge: Step, into: str = "out", parts: int = PARTS) -> DataFrame:
    """``(key, into)``: a key's values folded by one function, which combines the parts too."""
    return aggregate_by_key(df, key, value, zero, merge, merge, into, parts)
