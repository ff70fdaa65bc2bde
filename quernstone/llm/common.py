"""Helpers of the operators here."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import checkpointed, ensure_checkpoint_dir

__all__ = ["bounded", "checkpointed", "drop_folder", "ensure_checkpoint_dir", "fresh", "importable", "let", "running", "sliced", "stratified", "table"]


#: Values that running() sums at once; the sums of such runs are summed after that.
RUN = 128


#: Bytes of rows that a Python worker is sent at once, and the setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where lambdas use it again and again."""
    return F.get(F.transform(F.array(value), then), 0)


def running(values: Column) -> Column:
    """For each of an array's ints the sum of those before it, as longs.

    Runs of RUN values are summed apart and then set off against each other, so that long arrays take
    little more than linear time.
    """
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def laid(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda r: F.slice(v, r * RUN + 1, RUN))
        return let(runs, lambda a: let(F.transform(a, total), lambda totals: placed(a, totals)))

    def placed(a: Column, totals: Column) -> Column:
        bases = F.transform(a, lambda _, r: total(F.slice(totals, F.lit(1), r)))
        inner = lambda base, u: F.transform(u, lambda _, j: base + total(F.slice(u, F.lit(1), j)))
        return F.flatten(F.zip_with(bases, a, inner))

    return let(values, lambda v: F.when(F.size(v) > 0, laid(v)).otherwise(F.array().cast("array<bigint>")))


def stratified(df: DataFrame, column: str, id: str, rows: int, least: int, salt: str) -> tuple[DataFrame, dict]:
    """About ``rows`` of the rows by a hash of the id, about ``least`` of each value of the column if they are fewer; and each value's count.

    All rows of a value that has fewer; all of them if the table has no more than ``rows``. Values of the
    column are classes, few enough for the driver.
    """
    counts = {r[0]: r[1] for r in df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column).collect()}
    total = sum(counts.values())
    if total <= rows:
        return df, counts
    most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(1_000_000 * min(1.0, max(rows / total, least / n))) + 1)])
    return df.filter(F.pmod(F.xxhash64(id, F.lit(salt)), F.lit(1_000_000)) < most[F.col(column)]), counts


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver did; a cluster has it installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def bounded(spark: SparkSession) -> None:
    """Python workers get rows in batches of BATCH_BYTES or one row, in place of Spark's 64 MB; a bound that the session was given stays.

    So what a task holds on either side of the pipe does not grow with the length of texts. The session keeps
    the setting, as frames run after they are made; it changes no result.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of them stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, only the columns named."""
    importable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
