import itertools
import random

from quernstone.operators import itemsets as fi
from quernstone.sources.readers import baskets_from_text

BASKETS = ["a b c", "a b", "a c", "b c", "a b c d"]


def test_small(spark):
    got = fi.frequent_itemsets(baskets_from_text(spark, "\n".join(BASKETS), " "), 0.35)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 4), (1, "b", 4), (1, "c", 4), (2, "a|b", 3), (2, "a|c", 3), (2, "b|c", 3), (3, "a|b|c", 2)]
    assert sorted(map(tuple, fi.itemset_histogram(got).collect())) == [(1, 3), (2, 3), (3, 1)]


def test_contained(spark):
    triples = [(i, x) for i, t in enumerate([(1, 2, 4), (1, 2, 5), (1, 3, 6), (3, 5, 6), (4, 5, 8)]) for x in t]
    sets = spark.createDataFrame(triples, "set_id long, item long")
    baskets = spark.createDataFrame([(0, x) for x in (1, 2, 3, 5, 6)], "tid long, item long")
    assert sorted(r.set_id for r in fi.contained(sets, baskets).collect()) == [1, 2, 3]


def test_random(spark):
    r = random.Random(3)
    baskets = [{x for x in "abcdef" if r.random() < 0.6} or {"a"} for _ in range(30)]
    rows = [(i, x) for i, b in enumerate(baskets) for x in b]
    got = fi.frequent_itemsets(spark.createDataFrame(rows, "tid long, item string"), 0.3)
    least = fi.min_count(30, 0.3)
    want = {"|".join(c): n for k in range(1, 7) for c in itertools.combinations("abcdef", k) if (n := sum(set(c) <= b for b in baskets)) >= least}
    assert {x.items_: x.support for x in got.withColumnRenamed("items", "items_").collect()} == want
    direct = fi.frequent_itemsets(spark.createDataFrame(rows, "tid long, item string"), 0.3, first_pairs="direct")
    assert {x.items_: x.support for x in direct.withColumnRenamed("items", "items_").collect()} == want
