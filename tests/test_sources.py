from quernstone.operators.graph import follower_count
from quernstone.operators.wordcount import word_count
from quernstone.sources import readers, writers

EDGES = [(50000, 3400), (2300, 50000), (3400, 2300), (50000, 2100), (2100, 3400), (3400, 800), (2100, 50000)]


def test_edge_file_with_mark_and_crlf(spark, tmp_path):
    p = tmp_path / "edges.csv"
    p.write_bytes(b"\xef\xbb\xbf" + "\r\n".join(f"{a},{b}" for a, b in EDGES).encode())
    assert sorted(map(tuple, readers.read_edges(spark, str(p)).collect())) == sorted(EDGES)


def test_edge_tokens(spark, tmp_path):
    p = tmp_path / "edges.txt"
    p.write_text("1,2 3,4\n\n 5,6\t7,8\n")
    assert sorted(map(tuple, readers.read_edge_tokens(spark, str(p)).collect())) == [(1, 2), (3, 4), (5, 6), (7, 8)]


def test_baskets_from_text(spark):
    got = readers.baskets_from_text(spark, "# note\na,b,b\n\n c , a ", times=2).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b"), (3, "a"), (3, "c"), (5, "a"), (5, "b"), (7, "a"), (7, "c")]


def test_chain_graph(spark):
    assert sorted(map(tuple, readers.chain_graph(spark, 2).collect())) == [(1, 2), (3, 4)]


def test_follower_counts_as_pairs(spark, tmp_path):
    e = spark.createDataFrame(EDGES, readers.EDGE_SCHEMA)
    writers.write_pairs(follower_count(e), str(tmp_path / "out"))
    lines = sorted(x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split())
    assert lines == ["2100,1", "2300,1", "3400,2", "50000,2", "800,1"]


def test_word_count(spark):
    df = spark.createDataFrame([("a b\ta\r\nb  c",), ("",), (None,)], "text string")
    assert sorted(map(tuple, word_count(df).collect())) == [("a", 2), ("b", 2), ("c", 1)]
    assert "HashAggregate" in writers.plan_text(word_count(df))
