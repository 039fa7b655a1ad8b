"""Queries of readers, writers, verdicts, sequences and logits, over lines written from the tables, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import structure as S
from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators import corpus, instructions, ordered, sequences
from lectern.plans.catalogue import _PAIRS, _TOKEN, _VOCAB, _pairs, _strip, _vocab
from lectern.session import materialise, scratch, spread, table
from lectern.sources import readers, writers

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: Pairs as lines of seven kinds, told by their number: text, content, pair, instruction, no JSON, a list, blank.
_KINDS = f"{_PAIRS}, l AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS line FROM pr), n AS (SELECT *, line % 7 AS kind, conv_id % 16 AS bucket, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) AS nth FROM l)"


#: Files that lines are dealt to, by conversation.
_FILES = 16


def _lines(spark, d, kinds: range | tuple = range(7)) -> str:
    """Folders bucket=N with a file of such lines each; kinds that aren't asked for are left out."""
    rows = ordered.dense_rank_of(_pairs(spark, d).withColumn("o", F.struct("conv_id", "turn")), "o", "line").withColumn("line", F.col("line") + 1)
    made = lambda **f: F.to_json(F.struct(*[c.alias(n) for n, c in f.items()]))
    p, a, k = F.col("prompt"), F.col("answer"), F.pmod("line", F.lit(7))
    value = F.when(k == 0, made(text=p)).when(k == 1, made(content=a, n=F.col("line"))).when(k == 2, made(prompt=p, answer=a)).when(k == 3, made(instruction=p, input=F.lit(" "), output=a))
    value = value.when(k == 4, F.concat(F.lit("no json "), F.col("line").cast("string"))).when(k == 5, F.lit('["x"]')).otherwise(F.lit("  "))
    path = scratch(spark, "records")
    dealt = rows.filter(k.isin(*kinds)).select(F.pmod("conv_id", F.lit(_FILES)).alias("bucket"), "line", value.alias("value")).repartition("bucket").sortWithinPartitions("bucket", "line")
    dealt.select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


def _md5(c):
    return F.md5(c.cast("binary"))


def _bucket():
    return F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket")


@query(
    f"WITH {_KINDS}, t AS (SELECT 'general' AS category, 0 AS src_ord, bucket, nth AS line, CASE kind WHEN 0 THEN prompt WHEN 1 THEN answer WHEN 2 THEN prompt || chr(10) || answer WHEN 4 THEN 'no json ' || line ELSE '' END AS text FROM n "
    f"UNION ALL SELECT 'extra', 1, bucket, row_number() OVER (PARTITION BY bucket ORDER BY line), prompt FROM n WHERE kind = 0) SELECT category, src_ord, bucket, line, md5(text) AS text_md5 FROM t WHERE text <> ''"
)
def corpus_scan(spark, d):
    """The tolerant reader over two sources of many files in order."""
    sources = readers.parse_sources([f"general:{_lines(spark, d)}", f"extra:{_lines(spark, d, (0,))}"])
    return readers.corpus(spark, sources).select("category", "src_ord", _bucket(), "line", _md5(F.col("text")).alias("text_md5"))


@query(f"WITH {_KINDS} SELECT bucket, nth AS line, CASE kind WHEN 4 THEN 'Expecting value: line 1 column 1 (char 0)' WHEN 5 THEN 'JSON line is not an object' END AS load_error FROM n WHERE kind <> 6")
def validated_scan(spark, d):
    return readers.validated(readers.lines(spark, _lines(spark, d)), "file", "line").select(_bucket(), "line", "load_error")


@query(f"WITH {_KINDS} SELECT md5(CASE kind WHEN 0 THEN prompt ELSE answer END) AS text_md5 FROM n WHERE kind IN (0, 1)")
def profile_scan(spark, d):
    return readers.profile_texts(spark.read.text(_lines(spark, d))).select(_md5(F.col("text")).alias("text_md5"))


@query(f"WITH {_KINDS} SELECT count(*) AS n FROM n WHERE kind IN (0, 1, 2, 3)")
def fail_fast_scan(spark, d):
    """Lines without a bad one; that a bad one raises is a test."""
    return readers.fail_fast(spark.read.text(_lines(spark, d, (0, 1, 2, 3)))).agg(F.count("value").alias("n"))


@query(f"WITH {_KINDS} SELECT count(*) FILTER (kind < 4) AS n FROM n")
def skip_bad_scan(spark, d):
    return readers.skip_bad(spark.read.text(_lines(spark, d))).agg(F.count("*").alias("n"))


@query(f"WITH {_KINDS} SELECT count(*) FILTER (kind <> 6) AS n FROM n")
def row_count(spark, d):
    return readers.count_rows(spark.read.text(_lines(spark, d)))


_BOTH = f"'问题：' || {_strip('prompt')} || chr(10) || '回答：' || {_strip('answer')} || chr(10)"


@query(f"WITH {_KINDS} SELECT bucket, nth AS line, md5(CASE kind WHEN 0 THEN prompt WHEN 1 THEN answer WHEN 4 THEN 'no json ' || line WHEN 5 THEN '[''x'']' ELSE {_BOTH} END) AS text_md5 FROM n WHERE kind <> 6")
def training_texts(spark, d):
    """Training rows, their pairs, and their texts."""
    rows = readers.training_rows(readers.lines(spark, _lines(spark, d)), "file", "line")
    pair = T.prompt_of(*[F.col(c) for c in ("prompt", "answer", "instruction", "input", "output")])
    return rows.select(_bucket(), "line", _md5(T.training_text(F.col("raw"), pair, F.col("text"), F.col("content"))).alias("text_md5"))


@query(f"WITH {_KINDS} SELECT md5(CASE kind WHEN 0 THEN prompt WHEN 1 THEN answer WHEN 2 THEN '### Instruction:' || chr(10) || {_strip('prompt')} || chr(10) || chr(10) || '### Response:' || chr(10) || {_strip('answer')} || chr(10) WHEN 4 THEN 'no json ' || line ELSE '[\"x\"]' END) AS text_md5 FROM n WHERE kind NOT IN (3, 6)")
def sample_texts(spark, d):
    return readers.sample_texts(spark.read.text(_lines(spark, d))).select(_md5(F.col("text")).alias("text_md5"))


@query("SELECT doc_id % 5 AS shard_id, count(*) AS n, bit_xor(CAST(('0x' || substr(md5(text), 1, 12)) AS BIGINT)) AS texts FROM documents GROUP BY 1")
def manifest_scan(spark, d):
    """Shards written with their manifest, and read again by it."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(5)).cast("int").alias("shard_id")).withColumn("bytes", T.row_bytes(F.col("text")))
    path = scratch(spark, "shards")
    writers.write_shards(docs, path, ["doc_id"])
    made = writers.manifest(docs, {}, {}, [("general", "documents")], 1, 1, 1 << 28, "valid.jsonl")
    made["shards"] = [s | {"path": f"{path}/shard_id={i}"} for i, s in enumerate(made["shards"])]
    rows = readers.manifest_texts(spark, json.loads(json.dumps(made))).withColumn("shard_id", F.regexp_extract(F.col("_metadata.file_path"), r"shard_id=(\d+)", 1).cast("long"))
    drawn = F.conv(F.substring(_md5(readers.text_of(F.col("value"))), 1, 12), 16, 10).cast("long")
    return rows.groupBy("shard_id").agg(F.count("*").alias("n"), F.bit_xor(drawn).alias("texts"))


@query("SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 10 = 0")
def json_lines_written(spark, d):
    """Rows as JSON lines, overwritten, appended to, and read again."""
    rows, path = table(spark, d, "events").select("event_id", "event_type", "value"), scratch(spark, "events")
    writers.write_json_lines(rows.limit(3), path)
    writers.write_json_lines(rows, path)
    writers.write_json_lines(rows.filter("event_id % 10 = 0"), path, "append")
    return spark.read.schema(rows.schema).json(path)


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE CAST(('0x' || substr(md5('0:' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0 < 0.05")
def valid_sink(spark, d):
    """The valid split written as JSON lines with its ids, and read again."""
    docs = ordered.valid_split(table(spark, d, "documents"), "doc_id", 0.05, 10**9)
    path = scratch(spark, "valid")
    writers.write_valid(docs, path, keep=["doc_id"])
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), _md5(readers.text_of(F.col("value"))).alias("text_md5"))


@query(f"WITH {_VOCAB} SELECT token, token_id FROM voc")
def saved_vocabulary(spark, d):
    path = scratch(spark, "vocabulary-file")
    writers.write_vocabulary(_vocab(spark, d), path)
    return K.load_vocabulary(spark.read.text(path))


@query("SELECT doc_id % 3 AS part, count(*) AS n FROM documents WHERE length(text) < 200 GROUP BY 1")
def reject_side(spark, d):
    """Rows split by a check, the rejects with their reason."""
    docs = table(spark, d, "documents").withColumn("reason", F.when(F.length("text") < 200, F.concat(F.lit("short:"), F.pmod("doc_id", F.lit(3)))).otherwise("ok"))
    _, bad = writers.split_rejects(docs)
    return bad.groupBy(F.substring_index("reject_reason", ":", -1).cast("long").alias("part")).agg(F.count("*").alias("n"))


#: Answers made of events: their JSON, the same with something after it, a good Markdown answer, one that never closes; unsafe answers on some.
_CASES = (
    "c AS (SELECT event_id, props, event_id % 4 AS k, event_id % 3 AS u, CASE event_id % 5 WHEN 4 THEN 'odd' ELSE CASE WHEN event_id % 4 < 2 THEN 'json' ELSE 'markdown' END END AS format FROM events), "
    "s AS (SELECT *, CASE WHEN format = 'odd' THEN 'unknown_task_or_format: task_type=plain, format=odd' WHEN k = 1 THEN 'invalid_json: Extra data: line 1 column ' || (length(props) + 1) || ' (char ' || length(props) || ')' WHEN k = 3 THEN 'missing_or_wrong_outer_closing_fence' ELSE 'ok' END AS safe, "
    "u = 1 AND format = 'json' AS passed FROM c), "
    "r AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'empty_prompt' ELSE CASE WHEN safe <> 'ok' AND passed THEN safe || ' | unsafe_answer_unexpectedly_passed' WHEN safe <> 'ok' THEN safe WHEN passed THEN 'unsafe_answer_unexpectedly_passed' ELSE 'ok' END END AS reason FROM s)"
)


def _cases(spark, d):
    k, e = F.pmod("event_id", F.lit(4)), F.col("event_id")
    said, t = F.col("props"), F.col("event_type")
    answer = F.when(k == 0, said).when(k == 1, F.concat(said, F.lit("x"))).when(k == 2, F.concat(F.lit("```markdown\n"), t, F.lit("\n```"))).otherwise(F.concat(F.lit("```\n"), t, F.lit("\n~~~")))
    fmt = F.when(F.pmod(e, F.lit(5)) == 4, "odd").when(k < 2, "json").otherwise("markdown")
    unsafe = F.when(F.pmod(e, F.lit(3)) == 1, said).when(F.pmod(e, F.lit(3)) == 2, " ")
    return table(spark, d, "events").select("event_id", F.lit("plain").alias("task_type"), fmt.alias("format"), F.when(F.pmod(e, F.lit(11)) == 0, " ").otherwise("ask").alias("prompt"), answer.alias("answer"), unsafe.alias("unsafe_answer"))


@query(f"WITH {_CASES} SELECT event_id, reason = 'ok' AS ok, reason FROM r")
def row_verdicts(spark, d):
    """Required fields, the safe answer's check by its kind, and the unsafe one's failure."""
    return instructions.judge_samples(_cases(spark, d)).select("event_id", "ok", "reason")


@query(f"WITH {_CASES} SELECT event_id, safe AS reason, CASE WHEN format = 'odd' THEN 'unknown' ELSE format END AS kind FROM s")
def output_checks(spark, d):
    """The check of an output by its kind."""
    return instructions.judge_outputs(_cases(spark, d), "answer").select("event_id", "reason", F.col("group").alias("kind"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"t\": [\"100 摄氏度 ' || event_type || '\", {\"u\": \"100 摄氏度 and 100 摄氏度\"}], \"100℃ ' || event_type || '\": ' || user_id || '}' WHEN 1 THEN props WHEN 2 THEN '[\"' || event_type || ' 100 摄氏度\", ' || props || ']' ELSE CAST(user_id AS VARCHAR) END AS value, CASE event_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS changed FROM events")
def nested_replacements(spark, d):
    """Strings replaced in whole JSON values, with the number changed."""
    k, t, u, p = F.pmod("event_id", F.lit(4)), F.col("event_type"), F.col("user_id").cast("string"), F.col("props")
    line = F.when(k == 0, F.concat(F.lit('{"t": ["100℃ '), t, F.lit('", {"u": "100 °C and 100°C"}], "100℃ '), t, F.lit('": '), u, F.lit("}"))).when(k == 1, p)
    line = line.when(k == 2, F.concat(F.lit('["'), t, F.lit(' 100 ℃", '), p, F.lit("]"))).otherwise(F.concat(F.lit(" "), u, F.lit(" ")))
    return table(spark, d, "events").select("event_id", S.normalise_json(line).alias("x")).select("event_id", "x.value", "x.changed")


@query("SELECT count(*) AS rows, count(*) FILTER (event_id % 2 = 0) AS changed_rows FROM events")
def changed_rows(spark, d):
    return nested_replacements(spark, d).agg(F.count("*").alias("rows"), F.count_if(F.col("changed") > 0).alias("changed_rows"))


_ROW_IDS = f"SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS o, conv_id, turn, regexp_extract_all('问题：' || {_strip('prompt')} || chr(10) || '回答：', '{_TOKEN}') AS q, regexp_extract_all({_strip('answer')} || chr(10), '{_TOKEN}') AS a FROM pr"


@query(
    f"WITH {_VOCAB}, {_PAIRS}, x AS ({_ROW_IDS}), f AS (SELECT o, conv_id, turn, len(q) AS asked, unnest(q || a) AS token, generate_subscripts(q || a, 1) AS pos FROM x), "
    "i AS (SELECT f.conv_id, f.turn, f.asked, list(coalesce(v.token_id, 1) ORDER BY pos) AS ids FROM f LEFT JOIN voc v USING (token) GROUP BY ALL) "
    "SELECT conv_id, turn, md5('2,' || array_to_string(ids, ',')) AS inputs_md5, md5(array_to_string(list_transform(ids, lambda t, k: CASE WHEN k <= asked THEN -100 ELSE t END) || [3], ',')) AS labels_md5, len(ids) + 1 AS depths, len(ids) + 1 AS states, asked AS masked FROM i"
)
def encode_rows(spark, d):
    """The six sequences of each pair; depths and states by their number (their values are tests')."""
    rows = _pairs(spark, d).withColumn("o", F.struct("conv_id", "turn"))
    e = sequences.encode_rows(rows, _vocab(spark, d), "o")
    said = lambda c: _md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    masked = F.size(F.filter("depth_targets", lambda x: x == sequences.IGNORE))
    return e.select("o.conv_id", "o.turn", said("input_ids").alias("inputs_md5"), said("labels").alias("labels_md5"), F.size("depth_ids").cast("long").alias("depths"), F.size("state_targets").cast("long").alias("states"), masked.cast("long").alias("masked"))


@query(
    f"WITH {_VOCAB}, i AS (SELECT e.doc_id, [2] || list(coalesce(v.token_id, 1) ORDER BY e.pos) AS ids, list(coalesce(v.token_id, 1) ORDER BY e.pos) || [3] AS labels FROM e LEFT JOIN voc v USING (token) GROUP BY e.doc_id), "
    "r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) % 2 AS worker FROM i), u AS (SELECT worker, doc_id, unnest(ids) AS x, unnest(labels) AS y, generate_subscripts(ids, 1) AS pos FROM r), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY doc_id, pos) - 1 AS g FROM u) "
    "SELECT worker, g // 512 AS block_id, md5(string_agg(x, ',' ORDER BY g)) AS inputs_md5, md5(string_agg(y, ',' ORDER BY g)) AS labels_md5 FROM g GROUP BY 1, 2 HAVING count(*) = 512"
)
def pack_annotated(spark, d):
    """Documents as annotated sequences, packed by two workers."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    e = sequences.encode_rows(rows, _vocab(spark, d), "doc_id")
    said = lambda c: _md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return sequences.blocks(e, "doc_id", 512, n_workers=2).select("worker", "block_id", said("input_ids").alias("inputs_md5"), said("labels").alias("labels_md5"))


@query("SELECT round(avg(coalesce(value, 0)), 9) AS value FROM (SELECT value FROM events ORDER BY event_id LIMIT 100)")
def mean_loss(spark, d):
    return instructions.mean_loss(table(spark, d, "events"), "event_id", ["value"], 100).select(F.round("value", 9).alias("value"))


@query("SELECT event_id, round(event_id * 512 / greatest(event_id * 0.25, 1e-6), 6) AS tokens_per_second, round(greatest(20000 - event_id, 0) * (event_id * 0.25 / greatest(event_id, 1)), 6) AS estimated_remaining_time FROM events")
def training_progress(spark, d):
    log = table(spark, d, "events").select("event_id", (F.col("event_id") * 0.25).alias("elapsed"), (F.col("event_id") * 512).alias("tokens"))
    p = instructions.progress(log, "event_id", "elapsed", "tokens", 20_000)
    return p.select("event_id", F.round("tokens_per_second", 6).alias("tokens_per_second"), F.round("estimated_remaining_time", 6).alias("estimated_remaining_time"))


@query("SELECT p_partkey, greatest(10, CAST(trunc(p_partkey / greatest(p_size, 1) * 4) AS BIGINT) + 10) AS calls, CAST((1000 + 512 + 33 + 9) * w + n * (12 * w * w + 13 * w) + 2 * w + w * 33 + 33 + w * 9 + 9 AS BIGINT) AS parameters FROM (SELECT p_partkey, p_size, p_size % 16 + 1 AS n, 64 * (p_size % 10 + 1) AS w FROM part)")
def budgets(spark, d):
    """Call budgets and parameter counts of made-up plans."""
    p = table(spark, d, "part")
    counts = instructions.parameter_counts(F.col("p_size") % 16 + 1, (64 * (F.col("p_size") % 10 + 1)).cast("long"), F.lit(512), F.lit(1000))
    return p.select("p_partkey", instructions.call_budget(F.col("p_partkey"), F.col("p_size")).cast("long").alias("calls"), counts["total"].alias("parameters"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l, [vec_id % 64, (vec_id + 1) % 64, vec_id % 64] AS g FROM embeddings), p AS (SELECT vec_id, l AS h, g FROM v), "
    "r AS (SELECT vec_id, g, list_transform(h, lambda x, i: CASE WHEN list_contains(g, i - 1) THEN CASE WHEN x < 0 THEN x * 1.5 ELSE x / 1.5 END ELSE x END) AS h FROM p), "
    "b AS (SELECT vec_id, g, list_transform(h, lambda x, i: CASE WHEN i - 1 = g[2] THEN CAST('-inf' AS DOUBLE) ELSE x END) AS h FROM r) "
    "SELECT vec_id, len(list_filter(h, lambda x: x >= list_reverse_sort(h)[3])) AS possible, round(list_max(h), 9) AS best FROM b"
)
def logit_filters(spark, d):
    """Repetition penalty, no repeated bigrams and the three best, over a vector's components as logits."""
    l = F.transform("embedding", lambda x: x.cast("double"))  # noqa: E741
    v = F.col("vec_id")
    g = F.array(*[F.pmod(v + k, F.lit(64)).cast("int") for k in (0, 1, 0)])
    made = table(spark, d, "embeddings").select("vec_id", l.alias("l"), g.alias("g"))
    made = made.select("vec_id", T.top_k(T.no_repeat_ngram(T.repetition_penalty(F.col("l"), F.col("g"), 1.5), F.col("g"), 2), 3).alias("h"))
    return made.select("vec_id", F.size(F.filter("h", lambda x: x > float("-inf"))).cast("long").alias("possible"), F.round(F.array_max("h"), 9).alias("best"))


def _cut(text: str) -> str:
    for m in T.STOPS:
        text = f"split_part({text}, '{m}', 1)".replace(chr(10), "' || chr(10) || '")
    return text


_TAILS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Answer: ' || source WHEN 2 THEN ' 用户：' || source || chr(10) || '问题：x' ELSE chr(10) || 'Answer' END"


@query(
    f"WITH g AS (SELECT doc_id, n_chars, '  ' || text || {_TAILS} AS t FROM documents) SELECT doc_id, md5({_strip(_cut('t'))}) AS clean_md5, doc_id % 4 IN (1, 2) AS stopped, least(greatest(doc_id - 480, 0), 32) AS depth, "
    "printf('%.2f GB (%.1f MB)', n_chars * 1000000 / 1073741824, n_chars * 1000000 / 1048576) AS bytes, format('{:,}', n_chars * 1000) || ' (' || printf('%.2f', n_chars * 1000 / 1000000) || 'M)' AS tokens FROM g"
)
def text_cleanups(spark, d):
    """Generated texts up to their stop markers, depths in bounds, and figures as they're shown."""
    k = F.pmod("doc_id", F.lit(4))
    tail = F.when(k == 0, "").when(k == 1, F.concat(F.lit("\nAnswer: "), F.col("source"))).when(k == 2, F.concat(F.lit(" 用户："), F.col("source"), F.lit("\n问题：x"))).otherwise("\nAnswer")
    g = table(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("  "), F.col("text"), tail).alias("t"))
    return g.select("doc_id", _md5(T.clean_generated(F.col("t"))).alias("clean_md5"), T.has_stop(F.col("t")).alias("stopped"), T.clamp_depth(F.col("doc_id") - 480).alias("depth"), T.pretty_bytes(F.col("n_chars") * 1_000_000).alias("bytes"), T.pretty_count(F.col("n_chars") * 1000).alias("tokens"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= 150 AS taken FROM documents")
def needed_samples(spark, d):
    """The rows that are still needed, and the overflow."""
    first, rest = instructions.up_to_need(table(spark, d, "documents").select("doc_id"), "doc_id", 150)
    return first.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False)))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, md5(prompt) AS asked_md5 FROM pr WHERE turn % 3 <> 2 UNION ALL SELECT conv_id, turn, md5(answer) FROM pr WHERE turn % 3 <> 2")
def parsed_responses(spark, d):
    """The objects of responses' lists of samples: two of each pair, but for broken responses, and without what is no object."""
    made = F.to_json(F.struct(F.array(F.struct(F.col("prompt").alias("instruction")), F.struct(F.col("answer").alias("instruction"))).alias("samples")))
    cut = F.concat(F.regexp_replace(made, r"\]\}$", ""), F.lit(", 7, null]}"))
    raw = F.when(F.pmod("turn", F.lit(3)) == 2, F.concat(F.lit("broken "), made)).otherwise(cut)
    rows = _pairs(spark, d).withColumn("raw_response", raw)
    found = readers.responses(rows, "raw_response", "conv_id", "turn")
    return found.select("conv_id", "turn", _md5(F.try_variant_get("v", "$.instruction", "string")).alias("asked_md5"))


@query(f"WITH {_PAIRS}, i AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS k FROM pr) SELECT printf('ai_general_qa_%08d', k) AS id, 'general_qa' AS task_type, CASE WHEN k % 2 = 0 THEN 'json' ELSE 'plain' END AS format, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN CAST(k AS INTEGER) END AS difficulty, md5({_strip('prompt')}) AS asked_md5 FROM i")
def normalised_samples(spark, d):
    """Samples with ids by place, defaults for what is missing, and difficulties that are numbers."""
    rows = ordered.dense_rank_of(_pairs(spark, d).withColumn("o", F.struct("conv_id", "turn")), "o", "k")
    k = F.col("k")
    made = rows.select("o", F.lit(None).cast("string").alias("task_type"), F.when(k % 2 == 0, " json ").alias("format"), F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, "hard").alias("difficulty"), F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"))
    out = instructions.normalise_samples(made, "general_qa", "o")
    return out.select("id", "task_type", "format", "difficulty", _md5(F.col("instruction")).alias("asked_md5"))


@query("SELECT CASE WHEN count(*) FILTER (length(trim(text)) > 0) < 100 THEN 'too_few_rows' WHEN sum(strlen(text)) < 1000000000 THEN 'too_few_bytes' ELSE 'ok' END AS reason FROM documents")
def gates(spark, d):
    """The first gate that a corpus fails."""
    n = table(spark, d, "documents").agg(F.count_if(F.trim("text") != "").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return corpus.gate(n, {"too_few_rows": F.col("n") >= 100, "too_few_bytes": F.col("bytes") >= 1_000_000_000}).select("reason")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
