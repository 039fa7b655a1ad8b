import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import nextfit, ordered

SPLIT = "k string, i long"


@pytest.mark.parametrize("most", [0, 30, 10**9])
def test_valid_split_keeps_all_rows_and_keys_together(spark, most):
    rows = [(None if i % 7 == 0 else f"k{i % 23}", i) for i in range(300)]
    got = ordered.valid_split(spark.createDataFrame(rows, SPLIT), "k", 0.5, most).collect()
    assert sorted(r.i for r in got) == list(range(300))
    sides = {}
    for r in got:
        sides.setdefault(r.k, set()).add(r.valid)
    assert all(len(s) == 1 and None not in s for s in sides.values())
    drawn = sum(r.valid for r in got)
    assert drawn <= most and (not most or drawn > 0)


def test_valid_split_without_rows_and_at_the_ends(spark):
    df = spark.createDataFrame([], SPLIT)
    assert ordered.valid_split(df, "k").columns == ["k", "i", "valid"] and ordered.valid_split(df, "k").count() == 0
    three = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], SPLIT)
    assert all(r.valid for r in ordered.valid_split(three, "k", 1.0, 10).collect())
    assert not any(r.valid for r in ordered.valid_split(three, "k", 0.0, 10).collect())


def walked(sizes, limit):
    out, shard, fill, rows = [], 0, 0, 0
    for n in sizes:
        if rows and fill + n > limit:
            shard, fill, rows = shard + 1, 0, 0
        fill, rows = fill + n, rows + 1
        out.append(shard)
    return out


def test_ranges_follow_each_other_as_one_walk():
    rng = random.Random(2)
    for _ in range(3000):
        limit, m = rng.choice([0, 1, 5, 10, 30]), rng.randrange(60)
        sizes = [rng.choice([0, 0, 1, 2, 3, 7, 12, 40]) for _ in range(m)]
        cuts = sorted(rng.randrange(m + 1) for _ in range(rng.randrange(6)))
        parts = [np.array(sizes[a:b], np.int64) for a, b in zip([0, *cuts], [*cuts, m], strict=True)]
        state, got, whole = nextfit.NOTHING, [], nextfit.steps_of(parts[0], limit)
        for p in parts[1:]:
            whole = whole.then(nextfit.steps_of(p, limit), limit)
        for p in parts:
            if len(p):
                ids = np.full(len(p), -1)
                for row, shard in nextfit.starts_of(p, limit, *state):
                    ids[row:] = shard
                got += ids.tolist()
            state = nextfit.unpack(*nextfit.pack(nextfit.steps_of(p, limit))).enter(limit, *state)
        assert got == walked(sizes, limit) and whole.enter(limit, *nextfit.NOTHING) == state


@pytest.mark.parametrize("parts", [1, 4, 80])
def test_shards_equal_the_walk(spark, parts):
    rng = random.Random(parts)
    rows = [(None if i % 10 == 0 else f"o{i // 3:05d}", i, rng.choice([0, 5, 20, 90, 300, None, -4])) for i in range(500)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = ordered.assign_shards(spark.createDataFrame(rows, "o string, i long, n long").coalesce(1), "n", 100, "o").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    inorder = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.i, r.shard_id) for r in sorted(got, key=lambda r: r.i)] == sorted(zip([r[1] for r in inorder], walked([max(r[2] or 0, 0) for r in inorder], 100), strict=True))


def test_shards_of_no_rows(spark):
    got = ordered.assign_shards(spark.createDataFrame([], "o long, n long"), "n", 10, "o")
    assert got.columns == ["o", "n", "shard_id"] and got.count() == 0


def test_first_of_each_with_null_keys(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), (None, 5, 3), (None, 4, 4), ("b", None, 5)], "k string, o long, v long")
    assert sorted(r.v for r in ordered.first_of_each(df, "k", "o").collect()) == [2, 4, 5]


def test_splits_and_samples_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i // 2, i) for i in range(101)], "k long, i long")
    split = ordered.ratio_split(df, "k").groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r.split: r.n for r in split} == {"train": 95, "val": 3, "test": 3}
    assert ordered.sample(df, "k", 10).count() == 10 and ordered.sample(df, "k", 1000).count() == 101 and ordered.sample(df, "k", 10**9).count() == 101
    assert sorted(r.i for r in ordered.batches(df.withColumn("o", F.col("i")), "o", 10).collect()) == list(range(101))
