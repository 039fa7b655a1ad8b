import json
import math

import pytest
from pyspark.sql import functions as F

from lectern.functions.annotate import annotate
from lectern.functions import structure as S
from lectern.functions import subword
from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators import corpus, instructions, ordered, sequences
from lectern.sources import readers, writers

FIELDS = "o long, raw string, prompt string, answer string, instruction string, input string, output string, text string, content string"
ROWS = [(0, None, " p1 x", 'a {"k": [1]}', None, None, None, None, None), (1, "raw text here", None, None, None, None, None, None, None), (2, None, None, None, " i ", "in", "out", None, None), (3, None, None, None, None, None, None, "  ", None), (4, None, None, None, None, None, None, None, "cont"), (5, None, None, None, None, None, None, None, None)]


def vocabulary(spark):
    texts = [(0, "问题：p1 x\n回答：a {\"k\": [1]}\n"), (1, "raw text here"), (2, "i in out cont")]
    return K.train_vocabulary(spark.createDataFrame(texts, "o long, t string"), "t", "o", 200)


def test_six_sequences(spark):
    v = vocabulary(spark)
    ids = {r.token: r.token_id for r in v.collect()}
    got = {r.o: r for r in sequences.encode_rows(spark.createDataFrame(ROWS, FIELDS), v, "o").collect()}
    assert set(got) == {0, 1, 2, 4}  # blank texts go
    asked = K_tokens("问题：p1 x\n回答：")
    answered = K_tokens('a {"k": [1]}\n')
    depth, state = annotate(asked + answered)
    full = [2, *(ids.get(t, 1) for t in asked + answered), 3]
    r, mask = got[0], len(asked)
    assert r.input_ids == full[:-1] and r.labels == [-100] * mask + full[1 + mask :]
    assert r.depth_ids == [0, *depth] and r.state_ids == [0, *state]
    assert r.depth_targets == [-100] * mask + [*depth, 0][mask:] and r.state_targets == [-100] * mask + [*state, 0][mask:]
    assert got[1].labels == [*got[1].input_ids[1:], 3] and -100 not in got[1].depth_targets
    assert got[2].labels.count(-100) == len(K_tokens("问题：i\nin\n回答："))


def K_tokens(text):
    import re

    return [m[0] for m in re.finditer(K.PATTERN.replace(r"\p{Nd}", r"\d").replace(r"\x0B", "\v"), text)]


def test_blocks_of_sequences(spark):
    e = sequences.encode_rows(spark.createDataFrame(ROWS, FIELDS), vocabulary(spark), "o").cache()
    rows = e.orderBy("o").collect()
    for name in sequences.SEQUENCES:
        line = [x for r in rows for x in r[name]]
        got = {b.block_id: b[name] for b in sequences.blocks(e, "o", 6, 4).collect()}
        assert got == {k: line[4 * k : 4 * k + 6] for k in range((len(line) - 6) // 4 + 1)}
        dense = {b.block_id: b[name] for b in sequences.dense_blocks(e, "o", 5).collect()}
        assert dense == {k: line[k : k + 5] for k in range(len(line) - 4)}
    two = sequences.blocks(e, "o", 6, n_workers=2).collect()
    own = [[x for r in rows[w::2] for x in r.input_ids] for w in (0, 1)]
    assert {(b.worker, b.block_id): b.input_ids for b in two} == {(w, k): own[w][6 * k : 6 * k + 6] for w in (0, 1) for k in range(len(own[w]) // 6)}
    with pytest.raises(ValueError):
        sequences.dense_blocks(e.filter("o = 4"), "o", 50)
    shards = spark.createDataFrame([(*r, r[0] % 2) for r in ROWS], FIELDS + ", shard long")
    m = sequences.manifest_blocks(shards, vocabulary(spark), "shard", "o", 6, buffer=2).collect()
    assert len(m) == sum(len(r.input_ids) for r in rows) // 6


def test_annotated_ids_and_large_vocabularies(spark, monkeypatch):
    v = vocabulary(spark)
    docs = spark.createDataFrame([(0, ["a", " ", "{", "nope"]), (1, []), (2, None)], "o long, tokens array<string>")
    ids = K.encode(docs, v, "o").cache()
    assert {r.o: r.ids[-1] for r in ids.collect()} == {0: 3, 1: 3, 2: 3}
    a = {r.o: (r.depth_ids, r.state_ids) for r in K.annotate_ids(ids, v, "o", "ids").collect()}
    assert a[0] == ([0] * 6, [0, 0, 5, 5, 0, 0]) and a[1] == ([0, 0], [0, 0])
    text = {r.o: r.text for r in K.decode(ids, v, "o").collect()}
    assert text == {0: "a {<unk>", 1: "", 2: ""}
    monkeypatch.setattr(K, "BROADCAST_TOKENS", 5)
    assert {r.o: r.ids for r in K.encode(docs, v, "o").collect()} == {r.o: r.ids for r in ids.collect()}
    assert {r.o: r.text for r in K.decode(ids, v, "o").collect()} == text


def test_running_sums_with_nulls_ties_and_own_names(spark):
    rows = [("a", 1, 5), ("a", None, 2), (None, 1, 7), (None, 2, None), ("a", 3, 1), ("b", 1, 4)]
    df = spark.createDataFrame(rows, "g string, o long, n long").withColumn("_part", F.lit("mine")).repartition(3)
    got = ordered.running_before(df, "n", "o", ["g"]).collect()
    assert sorted((str(r.g), str(r.o), r.before) for r in got) == [("None", "1", 0), ("None", "2", 7), ("a", "1", 2), ("a", "3", 7), ("a", "None", 0), ("b", "1", 0)]
    assert {r._part for r in got} == {"mine"}
    assert sorted(r.before for r in ordered.running_before(df, "n", "o").collect())[0] == 0
    assert ordered.running_before(df.limit(0), "n", "o", ["g"]).count() == 0
    with pytest.raises(ValueError):
        corpus.judged(spark.createDataFrame([("t", "k")], "text string, key string"))


def test_mix_of_sources_that_run_out(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (None, 4), (7, 5)], "s long, o long")
    assert [r.o for r in ordered.mix_streams(df, "s", "o", [2, 1], 6).orderBy("step").collect()] == [1, 3, 2, 1, 3, 2]
    assert [r.o for r in ordered.mix_streams(df, "s", "o", [math.pi, 1.0], 5).orderBy("step").collect()] == [1, 2, 3, 1, 2]


def test_logits(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 0.5], [0, 1, 0, 1, 0])], "l array<double>, g array<int>")
    r = df.select(T.repetition_penalty(F.col("l"), F.col("g"), 2.0).alias("a"), T.no_repeat_ngram(F.col("l"), F.col("g"), 2).alias("b"), T.no_repeat_ngram(F.col("l"), F.col("g"), 9).alias("c"), T.top_k(F.col("l"), 2).alias("d"), T.top_p(F.col("l"), 0.5).alias("e"), T.top_p(F.col("l"), 0.9).alias("f")).first()
    no = float("-inf")
    assert (r.a, r.b, r.c) == ([0.5, -4.0, 3.0, 0.5], [1.0, no, 3.0, 0.5], [1.0, -2.0, 3.0, 0.5])
    assert (r.d, r.e, r.f) == ([1.0, no, 3.0, no], [no, no, 3.0, no], [1.0, no, 3.0, no])


def test_budgets_and_progress(spark):
    c = spark.range(1).select(instructions.parameter_counts(F.lit(16), F.lit(640), F.lit(512), F.lit(21128)).alias("p"), instructions.call_budget(F.lit(7), F.lit(2)).alias("b")).first()
    assert (c.b, c.p.total) == (24, 21128 * 640 + 512 * 640 + 33 * 640 + 9 * 640 + 16 * (12 * 640 * 640 + 13 * 640) + 2 * 640 + 640 * 33 + 33 + 640 * 9 + 9)
    assert instructions.mean_loss(spark.createDataFrame([(1, 2.0), (2, None), (3, 9.0)], "s int, v double"), "s", ["v"], 2).first().v == 1.0
    assert spark.range(1).select(T.pretty_count(F.lit(92680000))).first()[0] == "92,680,000 (92.68M)"


def test_nested_values_are_replaced(spark):
    lines = ['{"a": ["100°C", {"b": "100 ℃"}], "100℃": 1}', " ", None, "3"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(S.normalise_json("x")).collect()]
    assert [(g.value, g.changed) for g in got] == [('{"a": ["100 摄氏度", {"b": "100 摄氏度"}], "100℃": 1}', 2), (None, 0), (None, 0), ("3", 0)]


def test_tokenizers_of_other_makers(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "[PAD]": 1, "[CLS]": 2, "[SEP]": 3, "中": 4, "文": 5, "a": 6}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    s = subword.load_tokenizer(t.to_str())
    assert (s.pad_id, s.unk_id, s.bos_id, s.eos_id, s.vocab_size) == (1, 0, 2, 3, 7)
    df = spark.createDataFrame([("中 文 a b",), (None,)], "x string")
    assert [r[0] for r in df.select(s.encode(F.col("x"))).collect()] == [[2, 4, 5, 6, 0, 3], [2, 3]]
    assert [r[0] for r in df.select(s.tokenise(F.col("x"))).collect()] == [["中", "文", "a", "[UNK]"], []]
    assert df.select(s.encode(F.col("x"), specials=False).alias("i")).select(s.decode(F.col("i"))).first()[0] == "中文 a [UNK]"
    assert subword.load_tokenizer(json.dumps({"token_to_id": {"a": 1}})) == {"a": 1}
    for bad, kind in ((t.to_str(), "regex"), ("{}", "odd")):
        with pytest.raises(ValueError):
            subword.load_tokenizer(bad, kind)
    v = subword.build_vocabulary(df.withColumn("o", F.lit(1)), "x", "o", spark.createDataFrame([('{"token_to_id": {"q": 4}}',)], "value string"))
    assert [tuple(r) for r in v.collect()] == [("q", 4)]


def test_sources_and_guards(spark, tmp_path):
    assert readers.resolve_weighted_sources([{"path": "a", "weight": 2}], "k") == [{"path": "a", "weight": 2}]
    for bad in ("a", {"weight": 1}, {"path": "a", "weight": 0}):
        with pytest.raises(ValueError):
            readers.resolve_weighted_sources([bad], "k")
    with pytest.raises(FileNotFoundError):
        readers.resolve_weighted_sources([{"path": "a"}], "k", exists=lambda p: False)
    assert readers.should_stream({"s": 1}, "s", None) and not readers.should_stream({}, "s", None) and readers.should_stream({}, "s", 1 << 28)
    rows, path = spark.createDataFrame([("x",)], "value string"), str(tmp_path / "out")
    writers.write_guarded(rows, path)
    with pytest.raises(Exception, match="already exists"):
        writers.write_guarded(rows, path)
    writers.write_guarded(rows, path, force=True)
    with pytest.raises(ValueError):
        writers.write_guarded(rows, path, sources=[path + "/"])
    lines = spark.createDataFrame([('{"prompt":"p","answer":"a"}',), ("[1]",), ("raw",), ('{"text":" "}',), ("",)], "value string")
    assert [r.text for r in readers.sample_texts(lines).collect()] == ["### Instruction:\np\n\n### Response:\na\n", "[1]", "raw"]
