from pyspark.sql import functions as F

from lectern.streaming.keyed import append_first

SCHEMA = "instruction string, output string, n int, at timestamp"


def put(spark, path, rows):
    df = spark.createDataFrame(rows, "instruction string, output string, n int, at int")
    df.withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(path))


def go(spark, tmp_path, **how):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = append_first(stream, str(tmp_path / "out"), str(tmp_path / "state"), **how)
    q.awaitTermination()
    return q, sorted((r.instruction, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_repeats_are_dropped_over_restarts(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", "x", 1, 0), ("a", "x", 1, 0), ("b", "y", 3, 0)])
    assert go(spark, tmp_path)[1] == [("a", 1), ("b", 3)]
    put(spark, tmp_path / "in", [("b", "y", 5, 0), ("c", "z", 6, 0), ("a", " x ", 1, 0), ("a", "x ", 8, 0)])
    q, got = go(spark, tmp_path)
    assert [r for r in got if r[0] != "a"] == [("b", 3), ("c", 6)] and [r[1] for r in got if r[0] == "a"][0] == 1
    assert q.lastProgress["stateOperators"][0]["numRowsUpdated"] <= 2, "a batch touches its own keys"
    assert go(spark, tmp_path)[1] == got


def test_keys_expire_with_the_watermark(spark, tmp_path):
    how = {"time": "at", "keep": "10 seconds"}
    put(spark, tmp_path / "in", [("a", "x", 1, 100)])
    assert go(spark, tmp_path, **how)[1] == [("a", 1)]
    put(spark, tmp_path / "in", [("a", "x", 2, 105)])  # within the time: dropped
    assert go(spark, tmp_path, **how)[1] == [("a", 1)]
    put(spark, tmp_path / "in", [("b", "y", 3, 200)])  # moves the watermark on
    assert go(spark, tmp_path, **how)[1] == [("a", 1), ("b", 3)]
    put(spark, tmp_path / "in", [("a", "x", 4, 201), ("c", "z", 5, 50)])  # forgotten, so new; and too late
    assert go(spark, tmp_path, **how)[1] == [("a", 1), ("a", 4), ("b", 3)]
