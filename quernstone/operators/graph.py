"""Degree, two-hop path and directed triangle operators over bags of edges.

Multiplicities are summed before any join, so that a repeated edge costs one row
however often it occurs, and a count never lists the paths that it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each strategy asks of the planner; "auto" leaves the choice to it.
HINTS = {"auto": None, "merge": "merge", "shuffle_hash": "shuffle_hash", "broadcast": "broadcast"}
#: Largest number of edges that the broadcast strategy sends to every executor.
BROADCAST_EDGES = 5_000_000


def weighted(edges: DataFrame) -> DataFrame:
    """Distinct edges with their multiplicity ``m``."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.filter("src <> dst").distinct()


def follower_count(edges: DataFrame, every: int = 100) -> DataFrame:
    """``(dst, cnt)``: edges into each ``dst`` that ``every`` divides."""
    return edges.filter(F.col("dst") % every == 0).groupBy("dst").agg(F.count(F.lit(1)).alias("cnt"))


def follower_count_summed(edges: DataFrame, every: int = 100) -> DataFrame:
    """The same as a keyed sum of ones."""
    ones = edges.filter(F.col("dst") % every == 0).select("dst", F.lit(1).cast("long").alias("one"))
    return ones.groupBy("dst").agg(F.sum("one").alias("cnt"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, indeg, outdeg)`` of every vertex, from one pass of tagged incidences."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")))).alias("e"))
    into, out = F.sum(F.col("e.i")).alias("indeg"), F.sum(1 - F.col("e.i")).alias("outdeg")
    return ends.groupBy(F.col("e.id").alias("id")).agg(into, out)


def path2_count(edges: DataFrame) -> DataFrame:
    """``(paths)``: two-hop paths, those back to their start among them, as a sum of in times out."""
    return degrees(edges).agg(F.coalesce(F.sum(F.col("indeg") * F.col("outdeg")), F.lit(0)).cast("long").alias("paths"))


def path2_list(edges: DataFrame, no_return: bool = False) -> DataFrame:
    """``(x, y, z)`` of each two-hop path; ``no_return`` leaves out z = x."""
    a = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    b = edges.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    paths = a.join(b, "y").select("x", "y", "z")
    return paths.filter("x <> z") if no_return else paths


def path2_no_return(edges: DataFrame) -> DataFrame:
    """``(paths)``: two-hop paths with z other than x, without listing them.

    Those back to their start are counted on the edges and their reverses.
    """
    w = weighted(edges)
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("m").alias("n"))
    returns = w.join(back, ["src", "dst"]).agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("r"))
    return path2_count(edges).crossJoin(returns).select((F.col("paths") - F.col("r")).cast("long").alias("paths"))


def hinted(df: DataFrame, strategy: str) -> DataFrame:
    if strategy not in HINTS:
        raise ValueError(f"strategy is one of {sorted(HINTS)}")
    return df.hint(HINTS[strategy]) if HINTS[strategy] else df


def closed_paths(edges: DataFrame, strategy: str = "auto", distinct_ends: bool = True) -> DataFrame:
    """``(x, y, z, m1, m2, m3)``: rotations of directed triangles with multiplicities.

    The side that is joined is the edge list, so a broadcast never grows with paths;
    beyond BROADCAST_EDGES the broadcast strategy leaves the choice to the planner.
    """
    w = weighted(edges)
    if strategy == "broadcast" and w.count() > BROADCAST_EDGES:
        strategy = "auto"
    a = w.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("m").alias("m1"))
    b = w.select(F.col("src").alias("y"), F.col("dst").alias("z"), F.col("m").alias("m2"))
    c = w.select(F.col("src").alias("z"), F.col("dst").alias("x"), F.col("m").alias("m3"))
    paths = a.join(hinted(b, strategy), "y")
    if distinct_ends:
        paths = paths.filter("x <> z")
    return paths.join(hinted(c, strategy), ["z", "x"])


def triangle_rotations(edges: DataFrame, mode: str = "bag", strategy: str = "auto") -> DataFrame:
    """``(rotations, triangles)`` under one of three readings of repeated edges.

    bag: each edge counts as often as it occurs. semi: the closing edge only has to
    exist, and x = z is allowed. rep: the second and the closing edge only have to exist.
    """
    tally = {"bag": "m1 * m2 * m3", "semi": "m1 * m2", "rep": "m1"}
    if mode not in tally:
        raise ValueError(f"mode is one of {sorted(tally)}")
    n = closed_paths(edges, strategy, distinct_ends=mode != "semi").agg(F.coalesce(F.sum(F.expr(tally[mode])), F.lit(0)).cast("long").alias("rotations"))
    return n.select("rotations", F.expr("rotations div 3").alias("triangles"))


def triangle_count(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """``(rotations, triangles)`` over distinct edges without loops.

    Each triangle is met once, at its smallest vertex, which thins the paths to a third.
    """
    e = simple(edges)
    if strategy == "broadcast" and e.count() > BROADCAST_EDGES:
        strategy = "auto"
    a = e.filter("src < dst").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    b = e.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    c = e.filter("dst < src").select(F.col("src").alias("z"), F.col("dst").alias("x"))
    paths = a.join(hinted(b, strategy), "y").filter("z > x")
    n = paths.join(hinted(c, strategy), ["z", "x"]).agg(F.count(F.lit(1)).alias("triangles"))
    return n.select((F.col("triangles") * 3).alias("rotations"), "triangles")


def triangles_per_vertex(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """``(id, triangles)``: directed triangles through each vertex that has any."""
    rotations = closed_paths(simple(edges), strategy)
    return rotations.groupBy(F.col("x").alias("id")).agg(F.count(F.lit(1)).alias("triangles"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, dsts)``: the set of each vertex's successors."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """``(src, dsts)``: each vertex's successors in order, repeated ones as often as they occur."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("dsts"))


def dangling_vertices(edges: DataFrame) -> DataFrame:
    """``(id)``: vertices without an edge out."""
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")
