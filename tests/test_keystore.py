import random

import pytest

from lectern.functions import tokens as K
from lectern.operators.keystore import KeyStore, add_new
from lectern.streaming.ingest import append_to_store


def keys(spark, numbers):
    return spark.createDataFrame([(None if i is None else f"k{i}", i, "text") for i in numbers], "key string, i long, text string")


def test_only_new_keys_are_added(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), buckets=8)
    assert store.samples() is None and add_new(store, keys(spark, [1, 2, 2, None, None]), "i") == 3
    assert add_new(store, keys(spark, [2, 3, None, 3, 1]), "i") == 1
    assert add_new(store, keys(spark, []), "i") == 0
    assert sorted(str(r.key) for r in store.samples().collect()) == ["None", "k1", "k2", "k3"]


def test_no_stored_key_is_missed_and_few_others_are_looked_at(spark, tmp_path):
    rng = random.Random(1)
    store = KeyStore(spark, str(tmp_path / "s"), buckets=4)
    old = rng.sample(range(10**6), 1500)
    store.append(keys(spark, old[:700]))
    store.append(keys(spark, old[700:]))
    asked = keys(spark, old[::3] + [10**7 + k for k in range(1000)])
    maybe = {r.key for r in store.maybe(asked).collect()}
    assert {f"k{i}" for i in old[::3]} <= maybe and len(maybe) < 500 + 5
    assert sorted(r.i for r in store.new(asked).collect()) == [10**7 + k for k in range(1000)]


def test_a_stream_appends_what_the_store_lacks(spark, tmp_path):
    schema = "instruction string, output string"
    store = KeyStore(spark, str(tmp_path / "s"), buckets=4)
    for rows in ([("a", "x"), ("b", "y")], [("b", "y"), ("c", None)], [(" a", "x "), (None, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        append_to_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "state")).awaitTermination()
    assert sorted(str(r.instruction).strip() for r in store.samples().collect()) == ["None", "a", "b", "c"]
    append_to_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "again")).awaitTermination()
    assert store.samples().count() == 4


def test_buckets_that_cannot_hold_a_key_stay_unread(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), buckets=16)
    store.append(keys(spark, range(200)))
    asked = keys(spark, [7, 10**6])
    bucket = store._bucketed(asked.filter("i = 7")).first()["__bucket"]
    for r in [r for r in store.samples().select("__bucket").distinct().collect() if r[0] != bucket]:
        for f in (tmp_path / "s" / "samples" / f"__bucket={r[0]}").glob("*.parquet"):
            f.write_bytes(b"no Parquet")  # whoever reads it fails
    assert [r.i for r in store.new(asked).collect()] == [10**6]


@pytest.mark.parametrize("counters", [None, 40, 3])
def test_vocabulary_by_summaries_is_the_vocabulary(spark, counters):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=60))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(texts, "o long, t string").repartition(5)
    for size in (30, 40):
        want = {r.token: r.token_id for r in K.train_vocabulary(df, "t", "o", size).collect()}
        assert {r.token: r.token_id for r in K.train_vocabulary_by_summaries(df, "t", "o", size, counters).collect()} == want


def test_summaries_leave_few_candidates_or_say_that_they_cannot_tell(spark):
    few = spark.createDataFrame([(i, "often " * 50 + f"rare{i}") for i in range(300)], "o long, t string").repartition(3)
    got = K.heavy_tokens(few, "t", 2, 64)
    assert got is None or {"often", " "} <= {r.token for r in got.collect()}
    flat = spark.createDataFrame([(i, f"only{i}") for i in range(300)], "o long, t string").repartition(3)
    assert K.heavy_tokens(flat, "t", 100, 60) is None and K.heavy_tokens(flat, "t", 100, 130).count() == 300
    assert K.heavy_tokens(flat.limit(0), "t", 5).count() == 0
    assert K.train_vocabulary_by_summaries(flat, "t", "o", 50, 60).count() == 50
