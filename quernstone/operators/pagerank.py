"""PageRank by power iteration, dangling mass spread over all vertices."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.graph import adjacency_lists
from quernstone.session import checkpointed
from quernstone.sources.readers import chain_graph


def pagerank(edges: DataFrame, n_iter: int, alpha: float = 0.85, vertices: DataFrame | None = None, cut_every: int = 4) -> DataFrame:
    """``(id, pr)`` after ``n_iter`` iterations.

    pr'(v) = (1 - alpha) / N + alpha * (sum over edges into v of pr / outdeg + d / N), with d
    the mass of vertices without an edge out. ``vertices`` (id) adds isolated ones. Edges stay
    partitioned by their source through all iterations; only ranks move. Ranks are held, and d is one
    number of them, so each iteration has the same plan; the lineage is cut by a reliable checkpoint
    every ``cut_every`` iterations and at the end, and nothing stays held.
    """
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    ids = (ids if vertices is None else ids.union(vertices.select("id"))).distinct()
    outdeg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdeg"))
    w = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(outdeg, "src")
    w = w.select("src", "dst", (F.col("m") / F.col("outdeg")).alias("share")).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    flagged = ids.join(outdeg.select(F.col("src").alias("id"), F.lit(True).alias("out")), "id", "left")
    flagged = flagged.select("id", F.col("out").isNull().alias("dangling")).persist(StorageLevel.MEMORY_AND_DISK)
    n = flagged.count()
    ranks, held = flagged.select("id", "dangling", F.lit(1.0 / max(n, 1)).alias("pr")), []
    for i in range(n_iter):
        d = ranks.filter("dangling").agg(F.coalesce(F.sum("pr"), F.lit(0.0))).first()[0]
        into = w.join(ranks.select(F.col("id").alias("src"), "pr"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("share")).alias("s"))
        pr = F.lit((1 - alpha) / max(n, 1) + alpha * d / max(n, 1)) + alpha * F.coalesce("s", F.lit(0.0))
        ranks = flagged.join(into, "id", "left").select("id", "dangling", pr.alias("pr"))
        if i + 1 == n_iter or (i + 1) % cut_every == 0:
            ranks = checkpointed(ranks)
            for x in held:
                x.unpersist()
            held = []
        else:
            ranks = ranks.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(ranks)
    if n_iter:
        for x in (w, flagged):
            x.unpersist()
    return ranks.select("id", "pr")


def pagerank_nodes(edges: DataFrame, n_iter: int) -> DataFrame:
    """``(id, adj, pr)``: each vertex with its successors, repeated ones as often as they occur, and its rank."""
    adj = adjacency_lists(edges).withColumnRenamed("src", "id")
    none = F.array().cast("array<bigint>")
    return pagerank(edges, n_iter).join(adj, "id", "left").select("id", F.coalesce("dsts", none).alias("adj"), "pr")


def pagerank_chain(spark: SparkSession, k: int, n_iter: int, max_id: int = 1000) -> DataFrame:
    """Ranks of the k by k chain graph up to ``max_id``, with the collecting vertex 0 at rank 0."""
    ids = spark.range(1, k * k + 1)
    ranks = pagerank(chain_graph(spark, k), n_iter, vertices=ids)
    zero = spark.range(1).select("id", F.lit(0.0).alias("pr"))
    return ranks.unionByName(zero).filter(F.col("id") <= max_id)
