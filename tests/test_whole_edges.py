from quernstone.plans import ORACLE_SQL, QUERIES


def test_no_edge_leaves(spark, tmp_path):
    """Ids beyond the number of parts count too."""
    spark.createDataFrame([(1,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 70), (900, 80), (900, 80), (70, 1)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert {r[0]: r[1:] for r in run("in_out_degree")} == {1: (1, 1), 70: (1, 1), 80: (2, 0), 900: (0, 2)}
    assert run("adjacency") == [(1, "70"), (70, "1"), (900, "80")]
    assert run("dangling_vertices") == [(80,)]
    assert run("pagerank_mass") == [(1.0, 4)]
    assert len(run("pagerank_edges_op")) == 4 and "FROM part" not in ORACLE_SQL["pagerank_edges_op"]
