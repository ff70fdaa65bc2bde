"""Exact top-k search by inner product, with MaxScore.

A dimension is a pair of terms, one for positive and one for negative values; a query's weight
meets one of them with a positive contribution, bounded by the largest value in a block of
vectors, and takes the other off exactly. Terms are split by those bounds: the non-essential
ones are those whose bounds together cannot lift a vector past the k-th best score so far.
Essential postings are traversed; only vectors whose partial score can still compete are probed
in the others, largest bounds first. Shards are searched apart and their best are merged. Vectors
stay in their shard; queries are sent to each. One shard is searched first: the k-th best score
that a query has there is where it starts in the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, sliced

#: Components to a shard, queries read at once, vectors to a block of bounds, terms probed at once.
SHARD_CELLS, QUERY_ROWS, BLOCK_ROWS, PROBED = 1 << 21, 1024, 2048, 8
FOUND = "query_id long, vec_id long, score long"


def integers(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component x, taken as a double, as a long.

    Vectors that are null, or hold null or non-finite components, leave, and so do rows without
    an id. Of several vectors with one id the smallest counts, so that repeated rows are one.
    """
    x = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = x.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return x.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as the columns of a matrix, short ones filled up with zeros."""
    a = pa.concat_arrays([c.cast(pa.list_(pa.int64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat, ends = np.asarray(a.flatten()), np.cumsum(np.asarray(a.value_lengths()))
    out = np.zeros((width, len(a)), np.int64)
    row = np.repeat(np.arange(len(a)), np.diff(ends, prepend=0))
    out[np.arange(len(flat)) - (ends[row] - np.diff(ends, prepend=0)[row]), row] = flat
    return out


def best(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int, bounds: list, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest (ids, scores) of the columns of ``x`` for one query, ties to smaller ids.

    ``bounds`` has the largest and the negated smallest value of each term for each block. What scores
    under ``floor`` may be missing: k better ones are known.
    """
    top_ids, top = np.empty(0, np.int64), np.empty(0, x.dtype)
    for lo, (high, low) in zip(range(0, len(ids), BLOCK_ROWS), bounds, strict=True):
        block, own = x[:, lo : lo + BLOCK_ROWS], ids[lo : lo + BLOCK_ROWS]
        bound = np.where(q > 0, q * high, -q * low)
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        bar = floor if len(top) < k else top[-1] if floor is None else max(floor, top[-1])
        full = bar is not None
        # non-essential: all of them together stay under the k-th best
        cut = int(np.searchsorted(below, bar, side="left")) if full else 0
        rest = below[cut - 1] if cut else 0
        essential = order[cut:]
        score = q[essential] @ block[essential] if len(essential) else np.zeros(block.shape[1], x.dtype)
        alive = np.flatnonzero((own != query_id) & (score + rest >= bar)) if full else np.flatnonzero(own != query_id)
        score = score[alive]
        while cut and len(alive):
            probed = order[max(0, cut - PROBED) : cut]
            cut -= len(probed)
            score = score + q[probed] @ block[np.ix_(probed, alive)]
            rest = below[cut - 1] if cut else 0
            if full:
                keep = score + rest >= bar
                alive, score = alive[keep], score[keep]
        top_ids, top = np.concatenate([top_ids, own[alive]]), np.concatenate([top, score])
        if len(top) > k:
            first = np.lexsort((top_ids, -top))[:k]
            top_ids, top = top_ids[first], top[first]
        elif len(top) == k:
            first = np.lexsort((top_ids, -top))
            top_ids, top = top_ids[first], top[first]
    return top_ids, top


def joined(batches: list[pa.RecordBatch], column: str) -> pa.ChunkedArray:
    return pa.chunked_array([b.column(column) for b in batches])


class Shard:
    """Vectors of one shard, as postings by term in blocks."""

    def __init__(self, batches: list[pa.RecordBatch], width: int):
        self.ids = np.concatenate([np.asarray(b.column("vec_id")) for b in batches])
        self.x = matrix(joined(batches, "v"), width)
        self.width, self.largest = width, int(np.abs(self.x).max(initial=0))
        self.made: dict[type, tuple] = {}

    def of(self, kind: type) -> tuple[np.ndarray, list]:
        if kind not in self.made:
            x, zero = self.x.astype(kind), 0 if kind is object else kind(0)
            starts = range(0, len(self.ids), BLOCK_ROWS)
            bounds = [(np.maximum(x[:, lo : lo + BLOCK_ROWS].max(1), zero), np.maximum(-x[:, lo : lo + BLOCK_ROWS].min(1), zero)) for lo in starts]
            self.made = {kind: (x, bounds)}
        return self.made[kind]

    def search(self, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """(query_id, vec_id, score) of a block of queries."""
        out = {"query_id": [], "vec_id": [], "score": []}
        qs = matrix(joined([b], "v"), self.width)
        # doubles add up integers exactly to 2^53; beyond that Python's own integers do
        kind = np.float64 if max(1, self.largest) * max(1, int(np.abs(qs).max(initial=0))) * max(1, self.width) < 2**53 else object
        x, bounds = self.of(kind)
        qs = qs.astype(kind)
        for i, (query_id, floor) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("floor").to_pylist(), strict=True)):
            found, scores = best(self.ids, x, query_id, qs[:, i], k, bounds, floor)
            out["query_id"] += [query_id] * len(found)
            out["vec_id"] += found.tolist()
            out["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        return pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))


def searched(vectors: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best of each of the ``queries (shard, vec_id, v, floor)`` in the shard of ``vectors (shard, vec_id, v)``.

    A task has the rows of a shard together, vectors first: it holds those, and reads queries in blocks.
    """
    none = F.lit(None).cast("long").alias("floor")
    both = vectors.select("shard", F.lit(0).alias("kind"), "vec_id", "v", none).unionByName(queries.select("shard", F.lit(1).alias("kind"), "vec_id", "v", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, shard = [], None, None
        for b in sliced(batches, QUERY_ROWS):
            key = np.asarray(b.column("shard")) * 2 + np.asarray(b.column("kind"))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if key[lo] // 2 != at:
                    held, at, shard = [], key[lo] // 2, None
                part = b.slice(lo, hi - lo)
                if key[lo] % 2 == 0:
                    held.append(part)
                elif held:
                    shard = shard or Shard(held, width)
                    yield shard.search(part, k)

    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each query, itself left out.

    Both are ``(vec_id, v)`` as integers() gives them, ids unique. Ties go to the smaller vec_id;
    fewer candidates give fewer rows. Of vectors of different lengths the shorter one counts as
    filled up with zeros. Scores beyond 64 bits stop there. Empty inputs give no rows.

    A vector is sent once, to its shard of about SHARD_CELLS components; a query to each shard.
    """
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    shards = max(1, -(-n * max(1, width) // SHARD_CELLS))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("long").alias("shard"), "vec_id", "v")
    none = F.lit(None).cast("long").alias("floor")
    found = searched(dealt.filter("shard = 0"), queries.select(F.lit(0).cast("long").alias("shard"), "vec_id", "v", none), k, width)
    if shards > 1:
        found = checkpointed(found)
        floors = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floors = floors.select(F.col("query_id").alias("vec_id"), F.when((F.col("n") >= k) & (F.col("least") > -(2**63)), F.col("least")).alias("floor"))
        every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
        others = queries.join(floors, "vec_id", "left").select(every, "vec_id", "v", "floor")
        found = found.unionByName(searched(dealt.filter("shard > 0"), others, k, width))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
