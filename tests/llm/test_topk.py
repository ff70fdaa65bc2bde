import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    v = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        x = [int(np.floor(float(np.float32(c)) * 1024)) for c in e]
        v[i] = min(v.get(i, x), x)
    out = []
    for q in (i for i in v if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 20, 512])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(topk, "SHARD_CELLS", cells)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) ** 3 for _ in range(8)]) for i in range(900)]
    rows += [(i, rows[i % 7][1]) for i in range(900, 1000)] + rows[:30]  # ties and repeated rows
    rows += [(2000, None), (2100, []), (2200, [None, 1.0]), (2300, [float("nan")]), (2400, [float("inf"), 1.0]), (2500, [0.5]), (None, [1.0] * 8), (300, [-9.0] * 8)]
    df = spark.createDataFrame([(i, e, i) for i, e in rows], SCHEMA + ", score long")
    v = topk.integers(df)
    got = topk.top_k(v, v.filter(F.col("vec_id") % 100 == 0), 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_blocks_prune_without_loss():
    r = np.random.default_rng(1)
    x = np.floor(r.standard_normal((16, 9000)) * 100).astype(float)
    ids, q = np.arange(9000), np.floor(r.standard_normal(16) * 100)
    bounds = [(np.maximum(x[:, lo : lo + topk.BLOCK_ROWS].max(1), 0), np.maximum(-x[:, lo : lo + topk.BLOCK_ROWS].min(1), 0)) for lo in range(0, 9000, topk.BLOCK_ROWS)]
    got, scores = topk.best(ids, x, 7, q, 10, bounds)
    s = q @ x
    s[7] = -np.inf
    want = np.lexsort((ids, -s))[:10]
    assert got.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def test_large_values_few_and_none(spark):
    v = topk.integers(spark.createDataFrame([(0, [1e12, -1e12]), (1, [1e3, 1.0])], SCHEMA))
    assert [r.vec_id for r in topk.top_k(v, v.filter("vec_id = 0")).collect()] == [1]
    none = topk.integers(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(none, none).collect() == []
