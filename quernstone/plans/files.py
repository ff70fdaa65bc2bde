"""Queries by way of files: each sink writes to a folder beside the checkpoints, and its source reads that back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import graph as g
from quernstone.operators import itemsets as fi
from quernstone.session import ensure_checkpoint_dir
from quernstone.sources import readers, writers

INLINE = "# a comment\nmilk,bread\n\nmilk,eggs,bread\neggs\n bread , milk"


def folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def edges(spark, sf_dir) -> DataFrame:
    return readers.edges_from(readers.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def pairs_file(spark, sf_dir) -> DataFrame:
    """Pairs by commas; a second write replaces the first."""
    path, counts = folder(spark), g.follower_count(edges(spark, sf_dir))
    writers.write_pairs(counts.limit(1), path)
    writers.write_pairs(counts, path)
    return spark.read.schema("dst long, cnt long").csv(path)


def tabs_file(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    writers.write_pairs(g.follower_count(edges(spark, sf_dir)), path, sep="\t")
    return readers.read_edges(spark, path, sep="\t").toDF("dst", "cnt")


def lines_file(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    writers.write_lines(readers.table(spark, sf_dir, "part").select("p_brand"), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


def scalar_file(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    writers.write_scalar(g.path2_count(edges(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").cast("long").alias("paths"))


def fixed_point_file(spark, sf_dir) -> DataFrame:
    """Doubles as text with twelve decimals."""
    path = folder(spark)
    parts = readers.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") / 64).alias("x"))
    writers.write_lines(parts.select("s_suppkey", writers.fixed_point("x").alias("x")), path, sep="\t")
    cells = F.split("value", "\t")
    return spark.read.text(path).select(cells[0].cast("long").alias("s_suppkey"), cells[1].alias("x"))


def tokens_file(spark, sf_dir) -> DataFrame:
    """Several edges to a line, at least five partitions of them."""
    path, e = folder(spark), edges(spark, sf_dir)
    lines = e.groupBy("src").agg(F.concat_ws(" ", F.collect_list(F.concat_ws(",", "src", "dst"))).alias("line"))
    writers.write_lines(lines.select("line"), path)
    return g.follower_count(readers.min_partitions(readers.read_edge_tokens(spark, path), 5))


def baskets_file(spark, sf_dir) -> DataFrame:
    """Baskets by line, with blank and comment lines among them, about 1000 lines to a partition."""
    path, b = folder(spark), readers.baskets_of(spark, sf_dir, "p_brand")
    lines = b.groupBy("tid").agg(F.concat_ws(",", F.collect_list("item")).alias("line")).select("line")
    odd = spark.createDataFrame([("",), ("# Brand#11,Brand#12",), ("   ",)], "line string")
    writers.write_lines(readers.lines_per_split(lines, 1000).unionByName(odd), path)
    return readers.read_baskets(spark, path, ",").groupBy("item").agg(F.count(F.lit(1)).alias("support"))


def inline_baskets(spark, sf_dir) -> DataFrame:
    """Baskets of a text in the code, taken three times."""
    return fi.frequent_items(readers.baskets_from_text(spark, INLINE, times=3), 1)


FOLLOWERS = "SELECT l_partkey AS dst, count(*) AS cnt FROM lineitem WHERE l_partkey % 100 = 0 GROUP BY l_partkey"
#: name: (query, SQL)
FILES = {
    "file_pairs": (pairs_file, FOLLOWERS),
    "file_tabs": (tabs_file, FOLLOWERS),
    "file_lines": (lines_file, "SELECT p_brand AS value, count(*) AS lines FROM part GROUP BY p_brand"),
    "file_scalar": (scalar_file, "SELECT CAST(sum(a.n * b.n) AS BIGINT) AS paths FROM (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) b USING (id)"),
    "file_fixed_point": (fixed_point_file, "SELECT s_suppkey, printf('%.12f', s_suppkey / 64.0::DOUBLE) AS x FROM supplier"),
    "file_edge_tokens": (tokens_file, FOLLOWERS),
    "file_baskets": (baskets_file, "SELECT item, count(*) AS support FROM (SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY item"),
    "inline_baskets": (inline_baskets, "SELECT item, 3 * n AS support FROM (VALUES ('milk', 3::BIGINT), ('bread', 3), ('eggs', 2)) AS t(item, n)"),
    "empty_relation": (lambda s, d: g.triangle_count(readers.empty_edges(s)), "SELECT 0::BIGINT AS rotations, 0::BIGINT AS triangles"),
}
