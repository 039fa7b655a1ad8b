import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import ship
from lectern.sources import manifest_source as M


@pytest.fixture()
def source(spark):
    ship(spark).dataSource.register(M.ManifestSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda df, path, mode="overwrite", **o: df.write.format(M.NAME).options(path=str(path), **o).mode(mode).save()


def rows(spark, n, parts=3, first=0):
    return spark.range(first, first + n).repartitionByRange(parts, "id").sortWithinPartitions("id").select(T.json_row(F.concat(F.lit("text é "), F.col("id").cast("string"))).alias("value"))


def load(spark, path):
    return spark.read.format(M.NAME).option("path", str(path)).load()


def test_round_trip_and_manifest(spark, source, tmp_path):
    source(rows(spark, 200), tmp_path, shard_bytes=300, chunk=4, description="d")
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert sum(s["samples"] for s in m["shards"]) == 200 and all(0 < s["bytes"] <= 300 for s in m["shards"]) and m["description"] == "d"
    for s in m["shards"]:
        raw = (tmp_path / s["path"]).read_bytes()
        assert len(raw) == s["bytes"] and all(raw[:c].count(b"\n") == 4 * k for k, c in enumerate(s["chunks"]))
    got = load(spark, tmp_path).orderBy("shard", "line").collect()
    assert [json.loads(r.value)["text"] for r in got] == [f"text é {i}" for i in range(200)]
    one = load(spark, tmp_path).filter("shard = 3 AND line > 1")
    assert one.count() == m["shards"][3]["samples"] - 1
    few = load(spark, tmp_path).filter("shard IN (1, 2)")
    assert few.rdd.getNumPartitions() == 1 and {r.shard for r in few.collect()} == {1, 2}


def test_shards_that_are_not_asked_for_stay_closed(spark, source, tmp_path):
    source(rows(spark, 60), tmp_path, shard_bytes=300)
    m = M.load_manifest(str(tmp_path))
    reader = M.ManifestReader(str(tmp_path))
    assert list(reader.pushFilters([M.EqualTo(("shard",), 2), M.EqualTo(("line",), 1)])) == [M.EqualTo(("line",), 1)]
    assert [s[0] for p in reader.partitions() for s in p.shards] == [2]
    for k, s in enumerate(m["shards"]):
        if k != 2:
            (tmp_path / s["path"]).unlink()
    assert load(spark, tmp_path).filter("shard = 2").count() == m["shards"][2]["samples"]
    with pytest.raises(Exception, match="missing shards"):
        load(spark, tmp_path).count()


def test_append_and_no_rows(spark, source, tmp_path):
    source(rows(spark, 10), tmp_path)
    source(rows(spark, 5, first=10), tmp_path, mode="append")
    assert load(spark, tmp_path).count() == 15
    source(rows(spark, 0), tmp_path)
    assert M.load_manifest(str(tmp_path))["shards"] == []
    with pytest.raises(Exception, match="no shards"):
        load(spark, tmp_path).count()


def test_a_failed_job_leaves_the_manifest_as_it_was(spark, source, tmp_path):
    source(rows(spark, 30), tmp_path)
    before = (tmp_path / "manifest.json").read_bytes()
    bad = rows(spark, 30).withColumn("value", F.when(F.col("value").contains(" 29"), F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        source(bad, tmp_path)
    assert (tmp_path / "manifest.json").read_bytes() == before and load(spark, tmp_path).count() == 30
    assert len([d for d in os.listdir(tmp_path) if d.startswith("data-")]) == 1


def test_files_of_repeated_attempts_are_in_no_manifest(tmp_path):
    w = M.ManifestWriter(str(tmp_path), True, 100, 4, {})
    (tmp_path / f"data-{w.job}").mkdir()
    for name in ("part-00000-aaaa-00000.jsonl", "part-00000-bbbb-00000.jsonl"):
        (tmp_path / f"data-{w.job}" / name).write_text("x\n")
    good = f"data-{w.job}/part-00000-bbbb-00000.jsonl"
    w.commit([M.Written(0, f"data-{w.job}", [{"path": good, "bytes": 2, "samples": 1, "chunks": [0]}]), None])
    assert [s["path"] for s in M.load_manifest(str(tmp_path))["shards"]] == [good]
    assert os.listdir(tmp_path / f"data-{w.job}") == ["part-00000-bbbb-00000.jsonl"]


def test_epochs_stop_and_go_on(spark, source, tmp_path):
    source(rows(spark, 90, parts=4), tmp_path / "s", chunk=5)
    stream = spark.readStream.format(M.NAME).options(path=str(tmp_path / "s"), streaming="true", epochs=2, admit=7, seed=3).load()

    def go():
        q = M.read_chunks(stream, str(tmp_path / "s"), 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
        q.awaitTermination()
        return spark.read.schema("epoch int, place long, turn int, shard int, line long, value string").parquet(str(tmp_path / "o"))

    first = go().count()
    assert 0 < first < 90
    while go().count() < 180:
        pass
    assert go().count() == 180
    got = go().orderBy("epoch", "place", "turn").collect()
    said = [[json.loads(r.value)["text"] for r in got if r.epoch == e] for e in (0, 1)]
    assert sorted(said[0]) == sorted(said[1]) == sorted(f"text é {i}" for i in range(90)) and said[0] != said[1]
    shards = M.load_manifest(str(tmp_path / "s"))["shards"]
    order = list(dict.fromkeys(r.shard for r in got if r.epoch == 0))
    assert order == list(dict.fromkeys(s for s, _ in M.epoch_order(shards, 0, 3)))
