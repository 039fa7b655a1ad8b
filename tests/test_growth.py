"""What steps ship and repeat as tables grow."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators import annotation, ordered, sequences
from lectern.session import materialise, ship
from lectern.sources import manifest_source, readers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _records(spark) -> int:
    """Rows shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture
def written(monkeypatch):
    """(what, frame) of each table that a step writes."""
    found = []

    def spy(df, what):
        found.append((what, df))
        return materialise(df, what)

    for module in (ordered, K, annotation):
        monkeypatch.setattr(module, "materialise", spy)
    return found


def test_windows_inside_a_list_are_not_shuffled(spark):
    rows = spark.range(8).select("id", F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: (i + F.col("id") * 2000).cast("int")).alias("ids"))
    before = _records(spark)
    got = ordered.dense_windows(rows, "id", "ids", 8).select("block_id", "x", "y").collect()
    assert _records(spark) - before < 1000
    assert sorted((r.block_id, r.x[0], r.y[-1], len(r.x)) for r in got) == [(i, i, i + 8, 8) for i in range(16_000 - 8)]


@pytest.mark.parametrize(("block", "stride"), [(2, 1), (9, 1), (9, 4), (7, 3), (40, 20)])
def test_overlapping_blocks(spark, block, stride):
    rng = random.Random(block)
    data = [(g, o, [rng.randrange(99) for _ in range(rng.choice((0, 1, 2, 5, 8, 9, 30, 77)))]) for g in (None, 1) for o in range(25)]
    got = {(r.g, r.block_id): r.input_ids for r in ordered.chunks(spark.createDataFrame(data, "g int, o long, ids array<int>").repartition(3), "o", "ids", block, stride, ["g"]).collect()}
    want = {}
    for g in (None, 1):
        flat = [x for of, _, ids in data if of == g for x in ids]
        want |= {(g, k // stride): flat[k : k + block] for k in range(0, len(flat) - block + 1, stride)}
    assert got == want


def test_vocabulary_is_counted_by_hash(spark, written):
    rng = random.Random(1)
    data = [(None if i % 40 == 3 else i, " ".join(rng.choice(("a", "b", "c", "d{}", "e;f", "gh")) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(12))) for i in range(150)]
    df = spark.createDataFrame(data, "o long, t string")
    count, first = {}, {}
    for o, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, w in enumerate(x.t for x in spark.createDataFrame([(t,)], "t string").select(F.explode(K.tokenise(F.col("t"))).alias("t")).collect()) if o is None or o < 12 else ():
            first.setdefault(w, (o is not None, o or 0, p))
    for r in df.select(F.explode(K.tokenise(F.col("t"))).alias("t")).collect():
        count[r.t] = count.get(r.t, 0) + 1
    seeds = list(dict.fromkeys(K.SPECIALS + K.SEEDS))
    late = (True, 99, 0)
    ranked = sorted((w for w in count if w not in seeds), key=lambda w: (-count[w], first.get(w, late)))
    for size in (27, 30, 33):
        got = {r.token: r.token_id for r in K.train_vocabulary(df, "t", "o", size).collect()}
        assert got == {w: i for i, w in enumerate(seeds + ranked[: size - len(seeds)])}
    plan = _plan(next(d for what, d in written if what == "counts"))
    assert "SortAggregate" not in plan and "size(regexp_extract_all" not in plan


def test_vocabulary_ties_go_by_place(spark):
    df = spark.createDataFrame([(7, "z y x w"), (3, "b a c b2"), (3, "q a p"), (9, "z b")], "o long, t string")
    got = [r.token for r in K.train_vocabulary(df, "t", "o", 32).orderBy("token_id").collect()][26:]
    assert got[:4] == [" ", "b", "a", "z"] and set(got[4:]) == {"q", "c"}


def test_counts_list_no_characters(spark):
    odd = ["", "a!b", "aé中😀 x", " 　\t", "ab1²☃\x85", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    made = df.select("t", T.script_count(F.col("t"), "\\p{L}").alias("n"), T.script_count(F.col("t")).alias("han"), T.symbol_density(F.col("t")).alias("d"))
    assert "regexp_extract_all" not in _plan(made)
    assert [(r.n, r.han, r.d) for r in made.collect()] == [(0, 0, 1.0), (2, 0, 1 / 3), (4, 1, 1 / 6), (0, 0, 0.0), (2, 0, 1 / 6), (None, None, None)]


def test_normalised_and_keyed(spark):
    for t in ("", " ", "a  b", "\ta　 b \n", "a b", " \x85x  ", "a \t"):
        r = spark.createDataFrame([(t,)], "t string").select(T.normalise(F.col("t")).alias("n"), T.dedup_key(F.col("t")).alias("k"), F.sha1(F.lit("".join(t.split()))).alias("w")).first()
        assert r.n == " ".join(t.split()) and r.k == r.w


def test_repeats_in_one_pass(spark):
    ship(spark)
    rng = random.Random(2)
    texts = ["".join(rng.choice(of) for _ in range(n)) for of in ("ab", "abc \n　", "a😀b中", "é☃\x85z") for n in (0, 15, 16, 17, 400, 5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = df.select("i", T.repeated_ngrams(F.col("t")).alias("x"))
    assert "regexp" not in _plan(made)
    for r in made.collect():
        s = "".join(texts[r.i][:4000].split())
        grams = [s[k : k + 4] for k in range(len(s) - 3)]
        assert r.x == pytest.approx(0.0 if len(s) < 16 else 1 - len(set(grams)) / len(grams))


def test_parts_after_the_end_are_not_made(spark):
    made = readers.synthetic(spark.range(3), "id", F.array(F.lit("word")))
    assert "transform(sequence(" not in _plan(made)


def test_chunks_are_read_by_all_cores(spark):
    chunks = spark.createDataFrame([(0, 0, 0, 0, "x", 0, 1)], "epoch int, place long, shard int, chunk int, path string, first long, bytes long").coalesce(1)
    assert manifest_source.read_chunks(chunks, "/nowhere").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_pieces_of_one_file_are_dealt(spark, written):
    annotation.annotate_texts(spark.range(0, 40, 1, 1).select("id", F.lit('{"a": [1]}\n').alias("text")), "id", chars=4)
    assert dict(written)["pieces"].rdd.getNumPartitions() > 1


def test_lists_are_written_once_for_blocks(spark, written):
    rows = spark.range(30).select("id", *[F.array(F.lit(1), F.lit(2)).alias(c) for c in sequences.SEQUENCES])
    assert sequences.blocks(rows, "id", 6, n_workers=2).count() == 10
    assert all("input_ids" not in df.columns for what, df in written if what == "ranges")
    assert sum("input_ids" in df.columns for _, df in written) == 1
