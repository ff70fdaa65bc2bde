"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

Fixed masks over word positions ignore some of them, so that a hash of the others meets its like
though words between were replaced. Hashes of documents and of benchmark items are joined; each
hit names an alignment (item, shift), and the words of both are compared along it, in the documents
that have any. A document
leaks an item if, somewhere along an alignment, WINDOW words in a row (the whole item if it is
shorter) are equal in a share of SIMILARITY or more.

The first mask alone meets every window of 13 words with up to two replaced, wherever they are.
Items of 5 to 12 words have masks of four words by their length, so that whatever may be replaced
leaves a seed; shorter ones may differ in no word and are one seed. Only masks that the lengths of
the items ask for are laid over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, fresh, let

#: Word positions that count, from the first.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
#: The masks, as places in MASKS, of an item of so many words; longer ones have the first, shorter ones one of all their words.
SHORT = {5: (1, 2, 3, 4), 6: (1, 2), 7: (2,), 8: (1,), 9: (1,), 10: (1, 3), 11: (3,), 12: (1,)}
WINDOW, SIMILARITY = 13, 0.8
#: Bytes up to which a counted side is broadcast; a shuffle joins larger ones.
BROADCAST_BYTES = 48 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    runs = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(runs, " "), lambda w: w != "")


def hashed(text: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(h: Column, mask: tuple[int, ...]) -> Column:
    """The mask's hash at each position of the words ``h`` where it fits."""
    last = F.size(h) - mask[-1] - 1
    at = lambda i: F.xxhash64(F.lit(str(mask)), *[F.get(h, i + k) for k in mask])
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at))


def masks_of(n: int) -> list[tuple[int, ...]]:
    """The masks of an item of ``n`` words: any words replaced that SIMILARITY permits leave a seed."""
    if n < min(SHORT):
        return [tuple(range(n))]
    return [MASKS[k] for k in SHORT.get(n, (0,))]


def placed(df: DataFrame, id: str, masks: dict[tuple[int, ...], list[int]], own: bool) -> DataFrame:
    """``(id, seed, at)`` of every seed of ``(id, h)``; of items, ``own``, by the masks for their lengths."""
    none = F.array().cast("array<struct<seed:bigint,at:int>>")
    if not masks:
        return df.select(id, F.explode(none).alias("s")).select(id, "s.seed", "s.at")
    length = F.least(F.size("h"), F.lit(WINDOW))
    laid = lambda h, m: F.transform(seeds(h, m), lambda x, i: F.struct(x.alias("seed"), i.alias("at")))
    each = lambda h, m: F.when(length.isin(masks[m]), laid(h, m)).otherwise(none) if own else laid(h, m)
    flat = df.select(id, F.explode(let(F.col("h"), lambda h: F.concat(*[each(h, m) for m in masks]))).alias("s"))
    return flat.select(id, "s.seed", "s.at")


def items_of(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, n_items, ih)``: items of the same words as one, the smallest id standing for them."""
    held = benchmark.select(F.col(id).cast("long").alias("item"), hashed(F.col(text)).alias("ih"))
    return held.filter(F.size("ih") > 0).groupBy("ih").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_items")).select("item", "n_items", "ih")


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for a broadcast if its counted rows, of so many bytes in a hash table, stay under BROADCAST_BYTES."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(id, key, item, n, shift)``: the alignments of ``docs (id, key, text)`` and ``items (item, ih)`` that share a seed; n: the item's words.

    Only seeds and places meet here. A seed that many rows hold is split by the planner where sides are
    not broadcast: the join is an inner one of two shuffled sides.
    """
    masks: dict[tuple[int, ...], list[int]] = {}
    for r in items.select(F.least(F.size("ih"), F.lit(WINDOW)).alias("n")).distinct().orderBy("n").collect():
        for m in masks_of(r.n):
            masks.setdefault(m, []).append(r.n)
    own = placed(items.select(F.struct("item", F.size("ih").alias("n")).alias("i"), F.col("ih").alias("h")), "i", masks, True)
    own = checkpointed(own.select("seed", "i.item", "i.n", F.col("at").alias("item_at")).distinct())
    theirs = placed(docs.select(F.struct("id", "key").alias("d"), hashed(F.col("text")).alias("h")), "d", masks, False)
    met = theirs.join(bounded(own, 64), "seed")
    return met.select("d.id", "d.key", "item", "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def overlap(part: Column, ih: Column, before: Column) -> Column:
    """The largest share of equal words in a window of an item, next to the words ``part`` of which ``before`` are missing at its start."""
    n = F.size(ih)
    width = F.least(n, F.lit(WINDOW))
    equal = F.transform(ih, lambda w, j: F.coalesce((F.get(part, j - before) == w).cast("int"), F.lit(0)))
    count = lambda e, s: F.aggregate(F.slice(e, s + 1, width), F.lit(0), lambda a, x: a + x)
    return let(equal, lambda e: F.array_max(F.transform(F.sequence(F.lit(0), n - width), lambda s: count(e, s)))) / width


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(id, key, leaked)`` of the ``docs (id, key, text)`` that leak an item."""
    items = checkpointed(items_of(benchmark))
    longest = items.agg(F.max(F.size("ih"))).first()[0] or 0
    aligned = alignments(docs, items.select("item", "ih"))
    hits = checkpointed(aligned.groupBy("id", "key").agg(F.collect_list(F.struct("item", "n", "shift")).alias("hits")))
    # of the documents that have any, the words along each alignment are compared with the item's
    few = bounded(hits.select("id", "key"), 64)
    hit = docs.join(few, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).join(hits, ["id", "key"])
    hit = hit.select("id", "key", "hits", hashed(F.col("text")).alias("h"))
    along = let(F.col("h"), lambda h: F.transform("hits", lambda x: F.struct(x["item"].alias("item"), F.greatest(-x["shift"], F.lit(0)).alias("before"), F.slice(h, F.greatest(x["shift"], F.lit(0)) + 1, x["n"]).alias("part"))))
    each = hit.select("id", "key", F.explode(along).alias("x")).select("id", "key", "x.item", "x.before", "x.part")
    judged = each.join(bounded(items, 128 + 8 * longest), "item")
    judged = judged.select("id", "key", F.struct(F.col("item").alias("item_id"), "n_items", overlap(F.col("part"), F.col("ih"), F.col("before")).alias("overlap")).alias("x"))
    best = judged.filter(F.col("x.overlap") >= SIMILARITY).groupBy("id", "key", "x.item_id", "x.n_items").agg(F.max("x.overlap").alias("overlap"))
    return best.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("item_id", "n_items", "overlap"))).alias("leaked"))


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", into: str = "leaked") -> DataFrame:
    """``docs`` with ``into``: an array of (item_id, n_items, overlap), sorted, empty if clean.

    Items of the same words count as one, under the smallest id, with their number. Null and empty
    texts are clean and leak nothing; an item of fewer than five words leaks if all of them are there
    in a row. Of repeated ids each row is judged by its own text; rows with a null id are clean. Empty
    tables give no rows, an empty benchmark no leaks. A column named ``into`` is replaced; other
    columns come back as they were, whatever their names.
    """
    docs = docs.drop(into)
    key = lambda c: F.xxhash64(c, F.lit("text"))
    own = docs.filter(docs[id].isNotNull()).select(docs[id].alias("id"), key(docs[text]).alias("key"), docs[text].alias("text"))
    of_id, of_key, found_in = fresh([*docs.columns, into], "id", "key", "found")
    found = checkpointed(leaks(own, benchmark)).toDF(of_id, of_key, found_in)
    joined = docs.join(bounded(found, 512), (docs[id] == F.col(of_id)) & (key(docs[text]) == F.col(of_key)), "left")
    none = F.array().cast("array<struct<item_id:bigint,n_items:bigint,overlap:double>>")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(found_in, none).alias(into))


def report(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """``(doc_id, contaminated, n_items, item_ids, overlap)`` of contamination()'s rows."""
    return found.select(
        F.col(id).alias("doc_id"),
        (F.size("leaked") > 0).alias("contaminated"),
        F.aggregate("leaked", F.lit(0).cast("long"), lambda s, x: s + x["n_items"]).alias("n_items"),
        F.array_join(F.transform("leaked", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaked", lambda x: x["overlap"])), F.lit(0.0)).alias("overlap"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, as they were; see contamination()."""
    into = fresh(docs.columns, "leaked")[0]
    return contamination(docs, benchmark, id, text, into).filter(F.size(into) == 0).drop(into)
