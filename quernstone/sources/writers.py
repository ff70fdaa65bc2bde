"""Sinks: separated pairs, plain lines, one-row answers and plan listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(df: DataFrame, path: str, sep: str = ",", overwrite: bool = True) -> None:
    """Each row as one line, its columns separated by ``sep``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("sep", sep).csv(path)


def write_lines(df: DataFrame, path: str, sep: str = ",", overwrite: bool = True) -> None:
    """Each row as one line of text without a key."""
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")
    df.select(line).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_scalar(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A one-row answer as one file; an aggregate without keys is one partition already."""
    write_lines(df, path, overwrite=overwrite)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan, as ``explain`` prints it."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def fixed_point(column: str, digits: int = 12):
    """A double as text with ``digits`` decimals."""
    return F.format_string(f"%.{digits}f", F.col(column))
