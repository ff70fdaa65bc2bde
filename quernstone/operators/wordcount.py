"""Occurrences of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import words


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, cnt)`` over the whitespace-separated words of a column."""
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
