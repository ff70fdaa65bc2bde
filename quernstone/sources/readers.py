"""Sources: edge lists, transactions, generated graphs and the star-schema views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src long, dst long"


def read_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One edge a line. The CSV reader strips a byte-order mark and CR line ends."""
    return spark.read.schema(EDGE_SCHEMA).option("sep", sep).csv(path)


def read_edge_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Several ``src,dst`` tokens a line, separated by whitespace."""
    token = F.explode(F.split(F.trim("value"), r"\s+")).alias("token")
    ends = F.split("token", ",")
    return (
        spark.read.text(path)
        .select(token)
        .filter("token != ''")
        .select(ends[0].cast("long").alias("src"), ends[1].cast("long").alias("dst"))
    )


def edges_from(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Two columns of any table as a bag of edges; rows with a missing end are no edges."""
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).dropna()


def cap(edges: DataFrame, max_id: int | None) -> DataFrame:
    """Edges with both ends strictly below ``max_id``; pushed to the scan of each use."""
    if max_id is None:
        return edges
    return edges.filter((F.col("src") < max_id) & (F.col("dst") < max_id))


def min_partitions(df: DataFrame, n: int) -> DataFrame:
    """At least ``n`` partitions, as asked of a scan that would give fewer."""
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def lines_per_split(df: DataFrame, n: int) -> DataFrame:
    """As many partitions as it takes for about ``n`` rows in each, dealt out evenly."""
    return df.repartition(max(1, -(-df.count() // n)))


def empty_edges(spark: SparkSession) -> DataFrame:
    """No edges."""
    return spark.createDataFrame([], EDGE_SCHEMA)


def baskets_from_lines(lines: DataFrame, sep: str = " ", comment: str = "#") -> DataFrame:
    """``(tid, item)`` from lines of items; blank and comment lines are dropped.

    ``lines`` has the columns ``tid`` and ``value``. A basket is a set of items.
    """
    value = F.trim(F.regexp_replace("value", "\r$", ""))
    kept = lines.select("tid", value.alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith(comment))
    pattern = f"[{sep}]+" if sep != " " else " +"
    items = kept.select("tid", F.explode(F.array_distinct(F.split("value", pattern))).alias("item"))
    return items.select("tid", F.trim("item").alias("item")).filter("item != ''").distinct()


def read_baskets(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Transactions of a text file, one a line, numbered within the read."""
    return baskets_from_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("tid"), "value"), sep)


def baskets_from_text(spark: SparkSession, text: str, sep: str = ",", times: int = 1) -> DataFrame:
    """Transactions of an inline text, the whole list repeated ``times`` times."""
    rows = [(n, line) for n, line in enumerate(text.split("\n") * times)]
    return baskets_from_lines(spark.createDataFrame(rows, "tid long, value string"), sep)


def chain_graph(spark: SparkSession, k: int) -> DataFrame:
    """k chains of k vertices, 1..k*k; the last of each chain has no edge out."""
    return spark.range(1, k * k + 1).filter(F.col("id") % k != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to part, ids below the number of parts: sparse."""
    n = table(spark, sf_dir, "part").count()
    return cap(edges_from(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"), n)


def edges_ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier, ids up to the largest supplier: a dense multigraph."""
    items = table(spark, sf_dir, "lineitem")
    n = items.agg(F.max("l_suppkey")).first()[0] or 0
    return cap(edges_from(items, "l_partkey", "l_suppkey"), n + 1)


def baskets_of(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """Distinct ``(tid, item)``: the values of a part column in each order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(item).alias("item"))
    joined = items.join(part, items.l_partkey == part.p_partkey)
    return joined.select(F.col("l_orderkey").alias("tid"), "item").dropna().distinct()
