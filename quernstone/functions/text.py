"""Expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, carriage return, form feed.
SEPARATORS = r"[ \t\n\r\f]+"


def words(text: Column | str) -> Column:
    """The non-empty words of a text."""
    return F.array_remove(F.split(text, SEPARATORS), "")
