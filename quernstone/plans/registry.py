"""Each query by name, and the same question in SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import graph as g
from quernstone.operators import itemsets as fi
from quernstone.operators.folds import aggregate_by_key, fold_by_key
from quernstone.operators.pagerank import pagerank, pagerank_chain, pagerank_nodes
from quernstone.operators.wordcount import word_count
from quernstone.plans.files import FILES
from quernstone.sources.readers import baskets_of, edges_from, edges_op, edges_ps, table

EDGES_OP = "edges AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem, (SELECT count(*) AS n FROM part) WHERE l_orderkey < n AND l_partkey < n)"
EDGES_ALL = "edges AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)"
EDGES_PS = "edges AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem, (SELECT max(l_suppkey) + 1 AS n FROM lineitem) WHERE l_partkey < n AND l_suppkey < n)"
SIMPLE = "simple AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)"
SUPPORT_TYPE, SUPPORT_BRAND = 0.10, 0.02


def baskets_sql(item: str) -> str:
    return f"baskets AS (SELECT DISTINCT l_orderkey AS tid, {item} AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def least_sql(support: float) -> str:
    return f"least AS (SELECT CAST(floor(count(DISTINCT tid) * {support} + 0.5) AS BIGINT) AS c FROM baskets)"


def itemsets_sql(item: str, support: float, deepest: int = 4) -> str:
    levels = []
    for k in range(1, deepest + 1):
        names = [f"b{i}.item" for i in range(k)]
        joins = "".join(f" JOIN baskets b{i} ON b{i}.tid = b0.tid AND b{i}.item > b{i - 1}.item" for i in range(1, k))
        levels.append(f"SELECT {k} AS size, concat_ws('|', {', '.join(names)}) AS items, count(*) AS support FROM baskets b0{joins} GROUP BY {', '.join(names)} HAVING count(*) >= (SELECT c FROM least)")
    return f"WITH {baskets_sql(item)}, {least_sql(support)}, sets AS ({' UNION ALL '.join(levels)})"


def pagerank_sql(n: int) -> str:
    parts = [
        EDGES_OP,
        "v AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)",
        "nv AS MATERIALIZED (SELECT count(*) AS n FROM v)",
        "deg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM edges GROUP BY src)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS pr FROM v, nv)",
    ]
    for i in range(n):
        parts += [
            f"c{i} AS MATERIALIZED (SELECT e.dst AS id, sum(r.pr / d.d) AS s FROM edges e JOIN r{i} r ON r.id = e.src JOIN deg d ON d.id = e.src GROUP BY e.dst)",
            f"m{i} AS MATERIALIZED (SELECT coalesce(sum(pr), 0) AS m FROM r{i} WHERE id NOT IN (SELECT id FROM deg))",
            f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(s, 0) + m / n) AS pr FROM v LEFT JOIN c{i} USING (id), nv, m{i})",
        ]
    return f"WITH {', '.join(parts)} SELECT id, round(pr, 9) AS pr FROM r{n}"


def chain_sql(k: int, n: int) -> str:
    size = k * k
    parts = [f"r0 AS MATERIALIZED (SELECT range AS id, 1.0::DOUBLE / {size} AS pr FROM range(1, {size + 1}))"]
    for i in range(n):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / {size} + 0.85::DOUBLE * (coalesce(p.pr, 0) + (SELECT sum(pr) FROM r{i} WHERE id % {k} = 0) / {size}) AS pr"
            f" FROM r{i} v LEFT JOIN r{i} p ON p.id = v.id - 1 AND p.id % {k} <> 0)"
        )
    return f"WITH {', '.join(parts)} SELECT id, round(pr, 9) AS pr FROM r{n} WHERE id <= 1000 UNION ALL SELECT 0, 0.0"


def rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("pr", 9).alias("pr"))


def least_of(baskets: DataFrame, support: float) -> int:
    return fi.support_threshold(baskets, support).first()["min_count"]


def all_edges(spark, sf_dir) -> DataFrame:
    return edges_from(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def pairs_of_brands(spark, sf_dir) -> DataFrame:
    b = baskets_of(spark, sf_dir, "p_brand")
    return fi.frequent_pairs(b, least_of(b, SUPPORT_BRAND))


def items_of_types(spark, sf_dir) -> DataFrame:
    b = baskets_of(spark, sf_dir, "p_type")
    return fi.frequent_items(b, least_of(b, SUPPORT_TYPE))


def candidates_of_types(spark, sf_dir) -> DataFrame:
    b = baskets_of(spark, sf_dir, "p_type")
    pairs = fi.frequent_pairs(b, least_of(b, SUPPORT_TYPE)).select(F.array("a", "b").alias("items"))
    return fi.candidates(pairs, 3).select(F.concat_ws("|", "items").alias("items"))


def sets_of_types(spark, sf_dir) -> DataFrame:
    return fi.frequent_itemsets(baskets_of(spark, sf_dir, "p_type"), SUPPORT_TYPE)


def sets_of_types_direct(spark, sf_dir) -> DataFrame:
    return fi.frequent_itemsets(baskets_of(spark, sf_dir, "p_type"), SUPPORT_TYPE, first_pairs="direct")


def baskets_with_pairs(spark, sf_dir) -> DataFrame:
    """In how many baskets each frequent pair lies."""
    b = baskets_of(spark, sf_dir, "p_type")
    pairs = fi.frequent_pairs(b, least_of(b, SUPPORT_TYPE)).select(F.concat_ws("|", "a", "b").alias("set_id"), F.explode(F.array("a", "b")).alias("item"))
    return fi.contained(pairs, b).groupBy("set_id").agg(F.count(F.lit(1)).alias("baskets"))


def sets_of_brands(spark, sf_dir) -> DataFrame:
    return fi.frequent_itemsets(baskets_of(spark, sf_dir, "p_brand"), SUPPORT_BRAND)


CLOSED = "edges a JOIN edges b ON a.dst = b.src"
CANONICAL = f"WITH {EDGES_PS}, {SIMPLE} SELECT count(*) AS rotations, count(*) // 3 AS triangles FROM simple a JOIN simple b ON a.dst = b.src JOIN simple c ON c.src = b.dst AND c.dst = a.src"

#: name: (query, SQL)
REGISTRY = {
    "follower_count": (
        lambda s, d: g.follower_count(all_edges(s, d)),
        "SELECT l_partkey AS dst, count(*) AS cnt FROM lineitem WHERE l_partkey % 100 = 0 GROUP BY l_partkey",
    ),
    "follower_count_combine_variants": (
        lambda s, d: g.follower_count_summed(all_edges(s, d)),
        "SELECT l_partkey AS dst, CAST(sum(1) AS BIGINT) AS cnt FROM lineitem WHERE l_partkey % 100 = 0 GROUP BY l_partkey",
    ),
    "in_out_degree": (
        lambda s, d: g.degrees(edges_op(s, d)),
        f"WITH {EDGES_OP} SELECT id, CAST(sum(i) AS BIGINT) AS indeg, CAST(sum(1 - i) AS BIGINT) AS outdeg FROM (SELECT src AS id, 0 AS i FROM edges UNION ALL SELECT dst, 1 FROM edges) GROUP BY id",
    ),
    "adjacency": (
        lambda s, d: g.adjacency(edges_op(s, d)).select("src", F.concat_ws("|", F.col("dsts").cast("array<string>")).alias("dsts")),
        f"WITH {EDGES_OP} SELECT src, string_agg(dst::VARCHAR, '|' ORDER BY dst) AS dsts FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY src",
    ),
    "path2_count": (
        lambda s, d: g.path2_count(edges_op(s, d)),
        f"WITH {EDGES_OP} SELECT count(*) AS paths FROM {CLOSED}",
    ),
    "path2_list": (
        lambda s, d: g.path2_list(edges_op(s, d)),
        f"WITH {EDGES_OP} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM {CLOSED}",
    ),
    "path2_no_return": (
        lambda s, d: g.path2_no_return(edges_ps(s, d)),
        f"WITH {EDGES_PS} SELECT count(*) AS paths FROM {CLOSED} WHERE a.src <> b.dst",
    ),
    "triangle_rotations_bag": (
        lambda s, d: g.triangle_rotations(edges_ps(s, d), "bag"),
        f"WITH {EDGES_PS} SELECT count(*) AS rotations, count(*) // 3 AS triangles FROM {CLOSED} JOIN edges c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst",
    ),
    "triangle_rotations_semi": (
        lambda s, d: g.triangle_rotations(edges_ps(s, d), "semi"),
        f"WITH {EDGES_PS} SELECT count(*) AS rotations, count(*) // 3 AS triangles FROM {CLOSED} WHERE EXISTS (SELECT 1 FROM edges c WHERE c.src = b.dst AND c.dst = a.src)",
    ),
    "triangle_rotations_rep": (
        lambda s, d: g.triangle_rotations(edges_ps(s, d), "rep"),
        f"WITH {EDGES_PS}, once AS (SELECT DISTINCT src, dst FROM edges) SELECT count(*) AS rotations, count(*) // 3 AS triangles FROM edges a JOIN once b ON a.dst = b.src JOIN once c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst",
    ),
    "triangle_count": (lambda s, d: g.triangle_count(edges_ps(s, d)), CANONICAL),
    "triangle_merge": (lambda s, d: g.triangle_count(edges_ps(s, d), "merge"), CANONICAL),
    "triangle_shuffle_hash": (lambda s, d: g.triangle_count(edges_ps(s, d), "shuffle_hash"), CANONICAL),
    "triangle_broadcast": (lambda s, d: g.triangle_count(edges_ps(s, d), "broadcast"), CANONICAL),
    "triangles_per_vertex": (
        lambda s, d: g.triangles_per_vertex(edges_ps(s, d)),
        f"WITH {EDGES_PS}, {SIMPLE} SELECT a.src AS id, count(*) AS triangles FROM simple a JOIN simple b ON a.dst = b.src JOIN simple c ON c.src = b.dst AND c.dst = a.src GROUP BY a.src",
    ),
    "dangling_vertices": (
        lambda s, d: g.dangling_vertices(edges_op(s, d)),
        f"WITH {EDGES_OP} SELECT DISTINCT dst AS id FROM edges WHERE dst NOT IN (SELECT src FROM edges)",
    ),
    "pagerank_edges_op": (lambda s, d: rounded(pagerank(edges_op(s, d), 3)), pagerank_sql(3)),
    "pagerank_mass": (
        lambda s, d: pagerank(edges_op(s, d), 3).agg(F.round(F.sum("pr"), 9).alias("mass"), F.count(F.lit(1)).alias("vertices")),
        f"WITH {EDGES_OP} SELECT 1.0::DOUBLE AS mass, count(*) AS vertices FROM (SELECT src FROM edges UNION SELECT dst FROM edges)",
    ),
    "pagerank_chain_10": (lambda s, d: rounded(pagerank_chain(s, 10, 6)), chain_sql(10, 6)),
    "pagerank_chain_100": (lambda s, d: rounded(pagerank_chain(s, 100, 2)), chain_sql(100, 2)),
    "support_threshold": (
        lambda s, d: fi.support_threshold(baskets_of(s, d, "p_type"), SUPPORT_TYPE),
        f"WITH {baskets_sql('p_type')} SELECT count(DISTINCT tid) AS n, CAST(floor(count(DISTINCT tid) * {SUPPORT_TYPE} + 0.5) AS BIGINT) AS min_count FROM baskets",
    ),
    "frequent_items": (
        items_of_types,
        f"WITH {baskets_sql('p_type')}, {least_sql(SUPPORT_TYPE)} SELECT item, count(*) AS support FROM baskets GROUP BY item HAVING count(*) >= (SELECT c FROM least)",
    ),
    "frequent_pairs": (
        pairs_of_brands,
        f"WITH {baskets_sql('p_brand')}, {least_sql(SUPPORT_BRAND)} SELECT l.item AS a, r.item AS b, count(*) AS support FROM baskets l JOIN baskets r ON l.tid = r.tid AND l.item < r.item GROUP BY l.item, r.item HAVING count(*) >= (SELECT c FROM least)",
    ),
    "candidates_k3": (
        candidates_of_types,
        f"{itemsets_sql('p_type', SUPPORT_TYPE, 2)}, pairs AS (SELECT split_part(items, '|', 1) AS a, split_part(items, '|', 2) AS b FROM sets WHERE size = 2) SELECT concat_ws('|', p.a, p.b, q.b) AS items FROM pairs p JOIN pairs q ON p.a = q.a AND p.b < q.b JOIN pairs r ON r.a = p.b AND r.b = q.b",
    ),
    "frequent_itemsets": (sets_of_types, f"{itemsets_sql('p_type', SUPPORT_TYPE)} SELECT size, items, support FROM sets"),
    "frequent_itemsets_brand": (sets_of_brands, f"{itemsets_sql('p_brand', SUPPORT_BRAND)} SELECT size, items, support FROM sets"),
    "frequent_itemsets_direct": (sets_of_types_direct, f"{itemsets_sql('p_type', SUPPORT_TYPE)} SELECT size, items, support FROM sets"),
    "contained_pairs": (baskets_with_pairs, f"{itemsets_sql('p_type', SUPPORT_TYPE, 2)} SELECT items AS set_id, support AS baskets FROM sets WHERE size = 2"),
    "itemset_histogram": (
        lambda s, d: fi.itemset_histogram(sets_of_types(s, d)),
        f"{itemsets_sql('p_type', SUPPORT_TYPE)} SELECT size, count(*) AS itemsets FROM sets GROUP BY size",
    ),
    "word_count": (
        lambda s, d: word_count(table(s, d, "documents")),
        "SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word",
    ),
}



def ones(spark, sf_dir) -> DataFrame:
    return all_edges(spark, sf_dir).filter("dst % 100 = 0").select("dst", F.lit(1).cast("long").alias("one"))


def followers_folded(spark, sf_dir) -> DataFrame:
    return fold_by_key(ones(spark, sf_dir), "dst", "one", F.lit(0).cast("long"), lambda a, b: a + b, "cnt")


def followers_aggregated(spark, sf_dir) -> DataFrame:
    return aggregate_by_key(ones(spark, sf_dir), "dst", "one", F.lit(0).cast("long"), lambda a, _: a + 1, lambda a, b: a + b, "cnt")


def quantities_aggregated(spark, sf_dir) -> DataFrame:
    """Sum, number and largest of each supplier's quantities, by a struct that is folded."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")).dropna()
    made = lambda s, n, top: F.struct(s.alias("s"), n.alias("n"), top.alias("top"))
    zero = made(*[F.lit(0).cast("long")] * 3)
    seq = lambda a, q: made(a["s"] + q, a["n"] + 1, F.greatest(a["top"], q))
    comb = lambda a, b: made(a["s"] + b["s"], a["n"] + b["n"], F.greatest(a["top"], b["top"]))
    got = aggregate_by_key(items, "l_suppkey", "q", zero, seq, comb)
    return got.select("l_suppkey", F.col("out.s").alias("quantity"), F.col("out.n").alias("items"), F.col("out.top").alias("largest"))


def pairs_of_brands_bloom(spark, sf_dir) -> DataFrame:
    b = baskets_of(spark, sf_dir, "p_brand")
    return fi.frequent_pairs_bloom(b, least_of(b, SUPPORT_BRAND))


def sets_of_types_candidates(spark, sf_dir) -> DataFrame:
    return fi.frequent_itemsets(baskets_of(spark, sf_dir, "p_type"), SUPPORT_TYPE, first_pairs="candidates")


#: Triples that are looked for in one basket.
TRIPLES = "145 124 457 125 458 159 136 234 567 345 356 357 689 367 368".split()
BASKET = "12356"


def triples_contained(spark, sf_dir) -> DataFrame:
    sets = spark.createDataFrame([(t, x) for t in TRIPLES for x in t], "set_id string, item string")
    return fi.contained(sets, spark.createDataFrame([(0, x) for x in BASKET], "tid long, item string"))


def shown(lists: DataFrame, column: str) -> DataFrame:
    return lists.withColumn(column, F.concat_ws("|", F.col(column).cast("array<string>")))


FOLLOWERS = "SELECT l_partkey AS dst, count(*) AS cnt FROM lineitem WHERE l_partkey % 100 = 0 GROUP BY l_partkey"
REGISTRY |= {
    "follower_count_folded": (followers_folded, FOLLOWERS),
    "follower_count_aggregated": (followers_aggregated, FOLLOWERS),
    "quantities_aggregated": (
        quantities_aggregated,
        "SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(l_quantity) AS items, CAST(max(l_quantity) AS BIGINT) AS largest FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey",
    ),
    "adjacency_lists": (
        lambda s, d: shown(g.adjacency_lists(all_edges(s, d)), "dsts"),
        f"WITH {EDGES_ALL} SELECT src, string_agg(dst::VARCHAR, '|' ORDER BY dst) AS dsts FROM edges GROUP BY src",
    ),
    "pagerank_nodes": (
        lambda s, d: shown(pagerank_nodes(all_edges(s, d), 2), "adj").withColumn("pr", F.round("pr", 9)),
        f"WITH ranked AS ({pagerank_sql(2).replace(EDGES_OP, EDGES_ALL)}), {EDGES_ALL}, lists AS (SELECT src, string_agg(dst::VARCHAR, '|' ORDER BY dst) AS adj FROM edges GROUP BY src) SELECT id, coalesce(adj, '') AS adj, pr FROM ranked LEFT JOIN lists ON src = id",
    ),
    "frequent_pairs_bloom": (pairs_of_brands_bloom, REGISTRY["frequent_pairs"][1]),
    "frequent_itemsets_candidates": (sets_of_types_candidates, REGISTRY["frequent_itemsets"][1]),
    "contained_triples": (
        triples_contained,
        f"SELECT set_id, 0::BIGINT AS tid FROM (VALUES {', '.join(f"('{t}')" for t in TRIPLES)}) AS t(set_id) WHERE "
        + " AND ".join(f"contains('{BASKET}', set_id[{i}])" for i in (1, 2, 3)),
    ),
}
REGISTRY |= FILES

#: Degrees, adjacency and ranks have no cap on ids: they run over every edge, and so does their SQL.
WHOLE = {
    "in_out_degree": lambda s, d: g.degrees(all_edges(s, d)),
    "adjacency": lambda s, d: g.adjacency(all_edges(s, d)).select("src", F.concat_ws("|", F.col("dsts").cast("array<string>")).alias("dsts")),
    "dangling_vertices": lambda s, d: g.dangling_vertices(all_edges(s, d)),
    "pagerank_edges_op": lambda s, d: rounded(pagerank(all_edges(s, d), 3)),
    "pagerank_mass": lambda s, d: pagerank(all_edges(s, d), 3).agg(F.round(F.sum("pr"), 9).alias("mass"), F.count(F.lit(1)).alias("vertices")),
}
REGISTRY |= {name: (query, REGISTRY[name][1].replace(EDGES_OP, EDGES_ALL)) for name, query in WHOLE.items()}

QUERIES = {name: query for name, (query, _) in REGISTRY.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in REGISTRY.items()}
