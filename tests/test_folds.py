from pyspark.sql import functions as F

from quernstone.operators import folds, graph
from quernstone.operators import itemsets as fi
from quernstone.operators.pagerank import pagerank, pagerank_nodes



def test_fold_and_aggregate(spark):
    zero = F.lit(0).cast("long")
    rows = [(1, i) for i in range(1000)] + [(2, 5), (2, 5), (None, 3)]
    df = spark.createDataFrame(rows, "key long, value long")
    got = folds.fold_by_key(df, "key", "value", zero, lambda a, b: a + b, "sum")
    assert got.columns == ["key", "sum"] and sorted(map(tuple, got.collect()), key=repr) == [(1, 499500), (2, 10), (None, 3)]
    most = folds.fold_by_key(df, "key", "value", zero, lambda a, b: F.greatest(a, b), parts=3)
    assert dict(map(tuple, most.collect())) == {1: 999, 2: 5, None: 3}
    n = folds.aggregate_by_key(df, "key", "value", zero, lambda a, _: a + 1, lambda a, b: a + b)
    assert dict(map(tuple, n.collect())) == {1: 1000, 2: 2, None: 1}
    assert folds.fold_by_key(df.limit(0), "key", "value", zero, lambda a, b: a + b).collect() == []


def test_lists_and_nodes(spark):
    e = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (3, 1)], "src long, dst long")
    assert sorted(map(tuple, graph.adjacency_lists(e).collect())) == [(1, [2, 2, 3]), (3, [1])]
    nodes = {r.id: r for r in pagerank_nodes(e, 3).collect()}
    assert {i: r.adj for i, r in nodes.items()} == {1: [2, 2, 3], 2: [], 3: [1]}
    assert abs(sum(r.pr for r in nodes.values()) - 1) < 1e-9


def test_plan_does_not_grow_with_iterations(spark):
    e = spark.createDataFrame([(1, 3), (1, 2), (3, 1)], "src long, dst long")
    plans = [pagerank(e, n, cut_every=100)._jdf.queryExecution().optimizedPlan().toString() for n in (1, 3)]
    assert plans[0].count("Join") == plans[1].count("Join") == 0


def test_bloom_filter_keeps_what_it_holds(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(300)], "item string")
    words = fi.bloom_words(items)
    every = spark.createDataFrame([(f"i{k}",) for k in range(3000)], "item string")
    kept = {r.item for r in every.filter(fi.maybe_in("item", words)).collect()}
    assert {f"i{k}" for k in range(300)} <= kept and len(kept) < 330
