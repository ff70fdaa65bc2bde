from quernstone.streaming import follower_count_stream, windowed_follower_count


def test_running_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("1,100\n2,100\n3,7\n")
    edges = spark.readStream.schema("src long, dst long").csv(str(tmp_path / "in"))
    q = follower_count_stream(edges).writeStream.outputMode("complete").format("memory").queryName("followers").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("followers").collect()] == [(100, 2)]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 01:10:00", 1)], "ts string, dst long")
    got = windowed_follower_count(df.selectExpr("cast(ts as timestamp) ts", "dst")).orderBy("start").collect()
    assert [r.cnt for r in got] == [2, 1]
