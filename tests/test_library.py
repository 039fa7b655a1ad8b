import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators import corpus, instructions, ordered
from lectern.sources import readers, writers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, "ab" * 8, T.repeated_ngrams) == pytest.approx(1 - 2 / 13)
    assert one(spark, "abababababababa", T.repeated_ngrams) == 0.0
    assert one(spark, "a!", T.symbol_density) == 0.5 and one(spark, "", T.symbol_density) == 1.0
    assert one(spark, "a　　b\n c ", T.normalise) == "a b c"
    assert one(spark, "a b", T.dedup_key) == one(spark, "ab", T.dedup_key)
    assert one(spark, "short README", T.keep_reason) == "too_short"
    assert one(spark, "中文" * 40 + "README", lambda c: T.keep_reason(c)) == "command_contaminated"
    assert one(spark, "100 ℃ and 100°C", T.replace_units) == "100 摄氏度 and 100 摄氏度"
    assert one(spark, "a\nAnswer: b", T.clean_generated) == "a" and one(spark, "a\nAnswer: b", T.has_stop)
    assert one(spark, "中 文 ， x", T.cjk_spacing) == "中文，x"
    assert one(spark, 'é"\\/', T.row_bytes) == len(json.dumps({"text": 'é"\\/'}, ensure_ascii=False, separators=(",", ":")).encode()) + 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":1,"content":"c"}\n["x"]\nnot json\n\n"s"\n{"prompt":"p","answer":"a"}\n{"text":" "}\n', encoding="utf-8")
    got = readers.corpus(spark, [("general", str(tmp_path / "a.jsonl"))]).orderBy("line").collect()
    assert [(r.line, r.text) for r in got] == [(1, "c"), (3, "not json"), (5, "s"), (6, "p\na"), (7, " ")]
    v = spark.read.text(str(tmp_path / "a.jsonl"))
    assert readers.count_rows(v).first().n == 6
    assert sorted(r.load_error is None for r in readers.validated(v).collect()) == [False] * 3 + [True] * 3
    with pytest.raises(Exception, match="bad line"):
        readers.fail_fast(v).collect()
    assert readers.skip_bad(v).count() == 3
    assert readers.parse_sources(["a:b", "c"]) == [("a", "b"), ("general", "c")]
    assert readers.responses(spark.createDataFrame([('{"samples":[{"a":1},2]}',), ("bad",)], "raw_response string")).count() == 1
    docs = spark.createDataFrame([(1, "some plain words é1"), (2, None), (None, ""), (3, "x " * 500)], "i long, t string")
    texts = readers.synthetic(docs, "i", T.words(F.col("t"))).collect()
    assert len(texts) == 4 and all(1800 <= len(t.text) <= 4700 for t in texts) and "plain" in texts[0].text and "item" in texts[1].text


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "b a b a"), (2, "```json\n{\"k\": 1}")], "ord long, text string")
    v = {r.token: r.token_id for r in K.train_vocabulary(df, "text", "ord", 60).collect()}
    assert v["<pad>"] == 0 and v["~"] == 25 and v[" "] == 26 and v["b"] == 27 and v["a"] == 28
    voc = K.train_vocabulary(df, "text", "ord", 60)
    ids = K.encode(df.select("ord", K.tokenise(F.col("text")).alias("tokens")), voc, "ord")
    assert {r.ord: r.text for r in K.decode(ids, voc, "ord").collect()} == {1: "b a b a", 2: '```json\n{"k": 1}'}
    assert K.special_id({"pad": 7}, "bos") == 7
    text = K.vocabulary_map(voc)
    assert {r.token: r.token_id for r in K.load_vocabulary(text).collect()} == v


def test_ordered(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([40, 40, 40, 100, 10])], "o long, n long")
    assert [r.shard_id for r in ordered.assign_shards(df, "n", 100, "o").orderBy("o").collect()] == [0, 0, 1, 2, 3]
    assert [r.shard_id for r in ordered.assign_shards(spark.createDataFrame([(0, 150), (1, 10)], "o long, n long"), "n", 100, "o").orderBy("o").collect()] == [0, 1]
    three = spark.createDataFrame([(i, 40) for i in range(3)], "o long, n long")
    assert ordered.under_quota(three, "n", F.lit(80), "o").count() == 2 and ordered.under_quota(three, "n", F.lit(81), "o").count() == 3
    split = ordered.ratio_split(spark.range(101), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 95, "val": 3, "test": 3}
    rows = spark.createDataFrame([(0, list(range(5))), (1, list(range(5, 9)))], "o long, ids array<int>")
    assert [r.input_ids for r in ordered.chunks(rows, "o", "ids", 4).orderBy("block_id").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert ordered.chunks(rows, "o", "ids", 4, 1).count() == 6
    raw = spark.createDataFrame([(0, list(range(11)))], "o long, ids array<int>")
    assert ordered.dense_windows(raw, "o", "ids", 4).count() == 7
    m = spark.range(1).select(ordered.masked(F.array(F.lit(11), F.lit(12)), F.array(F.lit(21))).alias("m")).first().m
    assert (m.input_ids, m.labels) == ([2, 11, 12, 21], [-100, -100, 21, 3])
    assert ordered.smooth_schedule([2, 1], 3) == [0, 1, 0]
    with pytest.raises(ValueError):
        ordered.chunks(rows, "o", "ids", 4, 5)
    mixed = ordered.mix_streams(spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "s long, o long"), "s", "o", [2, 1], 6).orderBy("step").collect()
    assert [r.o for r in mixed] == [1, 3, 2, 1, 3, 2]


def test_prepare_in_order_keeps_what_a_quota_cut_off(spark):
    text = lambda i: "".join(chr(0x4E00 + (i * 997 + j * 37) % 2000) for j in range(60))
    a = spark.createDataFrame([(0, text(0)), (1, text(1))], "o long, text string")
    b = spark.createDataFrame([(10, text(1)), (11, text(0))], "o long, text string")
    got = corpus.prepare_in_order([a, b], "o", [1, 10**6])
    assert sorted(r.o for r in got.collect()) == [0, 10]


def test_samples(spark):
    rows = [(0, "json_escape", "json", "ask", '{"a": 1}'), (1, "json_escape", "json", "ask", "[1]"), (2, "nope", "json", "ask", "x"), (3, "control_trap", "plain", "ask", "x"), (4, "general_qa", "markdown", "ask", "```\nx"), (5, "general_qa", "yaml", "ask", "plain"), (6, "general_qa", "plain", " ", "x"), (7, "general_qa", "json", "ask", "{bad"), (8, "general_qa", "plain", "a" * 1201, "x"), (9, "general_qa", "json", "ask", "3")]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], "o long, task_type string, format string, instruction string, output string, difficulty int, input string")
    base = {r.o: r.reason for r in instructions.check_samples(df).collect()}
    more = {r.o: r.reason for r in instructions.check_samples(df, structured=True).collect()}
    assert [base[i].split(":")[0] for i in range(10)] == ["ok", "ok", "bad_task_type", "control_trap_not_obvious", "markdown_fence_unbalanced", "ok", "empty_instruction", "json_output_invalid", "instruction_too_long", "ok"]
    assert (more[1], more[5], more[9]) == ("json_output_must_be_object", "yaml_output_invalid_shape", "json_output_must_start_with_object_or_array")
    named = instructions.normalise_samples(df, "t", "o").orderBy("o").collect()
    assert named[3].id == "ai_t_00000003" and named[6].instruction == ""
    good, bad = writers.split_rejects(instructions.check_samples(df))
    assert good.count() == 4 and "reject_reason" in bad.columns and bad.count() == 6
    assert instructions.parse_weights(["a", "b"], "a=3") == {"a": 3.0, "b": 1.0}


def test_verdicts(spark):
    rows = [(1, "json", "json", "p", '{"a":1}', None), (2, "json", "json", "p", "{", None), (3, "json", "json", "p", "{}", "[]"), (4, None, "odd", "p", "x", "y"), (5, "t", "json", "", "x", None)]
    df = spark.createDataFrame(rows, "id long, task_type string, format string, prompt string, answer string, unsafe_answer string")
    got = {r.id: (r.ok, r.reason) for r in instructions.judge_samples(df).collect()}
    assert got[1] == (True, "ok") and got[2][1].startswith("invalid_json: ") and got[3] == (False, "unsafe_answer_unexpectedly_passed")
    assert got[4][1].startswith("unknown_task_or_format") and got[5] == (False, "empty_prompt")
    v = instructions.judge_samples(df)
    rates = {r.task_type: r.total for r in instructions.pass_rates(v, "task_type").collect()}
    assert rates == {"json": 3, "None": 1, "t": 1, "(all)": 5}
    assert {r.reason: r.n for r in instructions.failure_reasons(v).collect()}["invalid_json"] == 1


def test_shards_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, "text %d" % i) for i in range(10)], "o long, text string").withColumn("bytes", T.row_bytes(F.col("text")))
    cut = ordered.assign_shards(df, "bytes", 60, "o")
    writers.write_shards(cut, str(tmp_path / "s"), ["o"])
    m = writers.manifest(cut, {"seen": 10}, {"general": 1}, [("general", "p")], 1, 1, 60, "valid.jsonl")
    assert sum(s["samples"] for s in m["shards"]) == 10 and all(s["bytes"] <= 60 for s in m["shards"])
    lines = spark.read.text(str(tmp_path / "s")).select(readers.text_of(F.col("value")).alias("t")).collect()
    assert {r.t for r in lines} == {"text %d" % i for i in range(10)}
    with pytest.raises(FileNotFoundError):
        readers.manifest_texts(spark, m, exists=lambda p: False)


def test_queries_and_sql_name_the_same_things():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_reports_and_configurations(spark, tmp_path):
    p = corpus.profile(spark.createDataFrame([("中文" * 40,), ("short",), (None,)], "text string")).first().asDict()
    said = writers.report(p, ["one\ntwo", "x" * 900], "Title")
    assert said.startswith("# Title\n") and "| rows | 3 |" in said and "'one\\ntwo'" in said and "x" * 301 not in said
    assert json.loads(writers.summary_json({"b": 1, "a": "é"})) == {"a": "é", "b": 1} and writers.summary_json({"a": "é"}).count("é") == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    (tmp_path / "f" / "b.txt").write_bytes(b"d")
    m = writers.file_manifest(spark.read.format("binaryFile").load(str(tmp_path / "f")), "r1")
    assert (m["release"], m["file_count"], m["total_size"]) == ("r1", 2, 4) and m["files"][0]["sha256"].startswith("ba7816bf")
    assert readers.load_config('{"a": 1}') == {"a": 1} and readers.load_config("a: 1\nb:\n  - x") == {"a": 1, "b": ["x"]}
    assert readers.load_config("[1]", strict=False) == {}
    with pytest.raises(ValueError):
        readers.load_config("[1]")
    first, rest = instructions.up_to_need(spark.range(10), "id", 4)
    assert sorted(r.id for r in first.collect()) == [0, 1, 2, 3] and rest.count() == 6
