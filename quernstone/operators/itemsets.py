"""Level-wise frequent itemsets over ``(tid, item)`` sets.

A candidate of k items joins two frequent sets of k - 1 items with the same first k - 2 (an
equi join), is dropped unless all its subsets are frequent (semi joins), and is counted
where a basket holds both its parents, so that no basket is unfolded into all its subsets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import checkpointed

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 100_000


def min_count(n: int, min_support: float) -> int:
    """The least count of a relative support: rounded, halves up."""
    return math.floor(n * min_support + 0.5)


def support_threshold(baskets: DataFrame, min_support: float) -> DataFrame:
    """``(n, min_count)`` of a set of baskets."""
    n = baskets.agg(F.count_distinct("tid").alias("n"))
    return n.select("n", F.floor(F.col("n") * F.lit(min_support) + 0.5).cast("long").alias("min_count"))


def frequent_items(baskets: DataFrame, least: int) -> DataFrame:
    return baskets.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)


def frequent_pairs(baskets: DataFrame, least: int) -> DataFrame:
    """``(a, b, support)`` with a < b; infrequent items leave before the self join."""
    b = baskets.distinct().join(frequent_items(baskets, least).select("item"), "item", "left_semi")
    pairs = b.alias("l").join(b.alias("r"), (F.col("l.tid") == F.col("r.tid")) & (F.col("l.item") < F.col("r.item")))
    counts = pairs.groupBy(F.col("l.item").alias("a"), F.col("r.item").alias("b")).agg(F.count(F.lit(1)).alias("support"))
    return counts.filter(F.col("support") >= least)


def candidates(level: DataFrame, k: int) -> DataFrame:
    """``(items, p1, p2)``: sets of ``k`` items all of whose subsets of k - 1 are in ``level (items)``."""
    prefix = F.slice("items", 1, k - 2)
    left = level.select(prefix.alias("prefix"), F.col("items").alias("p1"))
    right = level.select(prefix.alias("prefix"), F.col("items").alias("p2"))
    made = left.join(right, "prefix").filter(F.element_at("p1", -1) < F.element_at("p2", -1))
    made = made.select(F.concat("p1", F.array(F.element_at("p2", -1))).alias("items"), "p1", "p2")
    for i in range(k - 2):  # without the last or the one before it: the parents
        subset = F.expr(f"filter(items, (x, j) -> j <> {i})")
        made = made.join(level.select(F.col("items").alias("subset")), subset == F.col("subset"), "left_semi")
    return made


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if it was counted to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def itemset_levels(baskets: DataFrame, least: int, max_len: int | None = None, first_pairs: str = "direct") -> list[DataFrame]:
    """``(items, support)`` of each level until one is empty.

    Pairs are counted as they occur in baskets of frequent items; with ``first_pairs="candidates"`` they are
    candidates like longer sets, which joins all frequent items with each other.
    """
    if first_pairs not in ("candidates", "direct"):
        raise ValueError("first_pairs is candidates or direct")
    one = frequent_items(baskets, least).select(F.array("item").alias("items"), "support")
    level = checkpointed(one)
    held = baskets.distinct().select("tid", F.array("item").alias("items")).join(small(level.select("items")), "items", "left_semi")
    held = checkpointed(held)
    levels, k = [level], 2
    while (max_len is None or k <= max_len) and not level.isEmpty():
        if k == 2 and first_pairs == "direct":
            a, b = (held.select("tid", F.col("items")[0].alias(c)) for c in "ab")
            both = a.join(b, "tid").filter("a < b").select("tid", F.array("a", "b").alias("items"))
        else:
            made = checkpointed(candidates(level.select("items"), k))
            if made.isEmpty():
                break
            first = held.select("tid", F.col("items").alias("p1")).join(small(made), "p1")
            both = first.join(held.select("tid", F.col("items").alias("p2")), ["tid", "p2"]).select("tid", "items")
        level = checkpointed(both.groupBy("items").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least))
        held = checkpointed(both.join(small(level.select("items")), "items", "left_semi").select("tid", "items"))
        levels.append(level)
        k += 1
    return levels


def frequent_itemsets(baskets: DataFrame, min_support: float, max_len: int | None = None, first_pairs: str = "direct") -> DataFrame:
    """``(size, items, support)``; items sorted and joined by ``|``."""
    n = baskets.agg(F.count_distinct("tid")).first()[0]
    levels = itemset_levels(baskets, max(1, min_count(n, min_support)), max_len, first_pairs)
    every = reduce(DataFrame.unionByName, levels)
    return every.select(F.size("items").alias("size"), F.concat_ws("|", "items").alias("items"), "support")


def bloom_words(items: DataFrame, bits: int = 1 << 16, hashes: int = 3) -> list[int]:
    """The words of a Bloom filter of ``items (item)``: ``bits`` / 64 longs, however many items there are."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64("item", F.lit(k)), F.lit(bits)) for k in range(hashes)]))
    words = items.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    out = [0] * (bits // 64)
    for r in words.collect():
        out[r.word] = r.mask
    return out


def maybe_in(item: str, words: list[int], hashes: int = 3):
    """Whether a Bloom filter may hold the item; false only where it does not."""
    held, bits = F.array(*[F.lit(w).cast("long") for w in words]), len(words) * 64
    at = [F.pmod(F.xxhash64(item, F.lit(k)), F.lit(bits)) for k in range(hashes)]
    bit = lambda a: F.get(held, F.floor(a / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (a % 64).cast("int"))) != 0
    return reduce(lambda x, y: x & y, [bit(a) for a in at])


def frequent_pairs_bloom(baskets: DataFrame, least: int) -> DataFrame:
    """frequent_pairs(), a Bloom filter of the frequent items keeping most others out of the self join; counts are exact."""
    kept = baskets.distinct().filter(maybe_in("item", bloom_words(frequent_items(baskets, least).select("item"))))
    pairs = kept.alias("l").join(kept.alias("r"), (F.col("l.tid") == F.col("r.tid")) & (F.col("l.item") < F.col("r.item")))
    counts = pairs.groupBy(F.col("l.item").alias("a"), F.col("r.item").alias("b")).agg(F.count(F.lit(1)).alias("support"))
    return counts.filter(F.col("support") >= least)


def itemset_histogram(itemsets: DataFrame) -> DataFrame:
    """``(size, itemsets)``: how many frequent sets there are of each size."""
    return itemsets.groupBy("size").agg(F.count(F.lit(1)).alias("itemsets"))


def contained(sets: DataFrame, baskets: DataFrame) -> DataFrame:
    """``(set_id, tid)``: which of ``sets (set_id, item)`` lie within which baskets."""
    s, b = sets.distinct(), baskets.distinct()
    sizes = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    shared = s.join(b, "item").groupBy("set_id", "tid").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "set_id").filter("shared = size").select("set_id", "tid")
