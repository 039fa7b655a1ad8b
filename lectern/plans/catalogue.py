"""Queries for the library's own operators, and the SQL that must give the same rows.

The fixtures have no CJK text, so letters stand for the script that counts. Hash draws use md5, which both
engines have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import structure as S
from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators import corpus, instructions, ordered
from lectern.sources import readers
from lectern.session import materialise, scratch, spread, table

LETTERS = "\\p{L}"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IN = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Documents with their cleaned text, reason, key and bytes.
_JUDGED = rf"""
c AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '{_W}+', ' ', 'g'), ' ') AS clean FROM documents),
s AS (SELECT *, length(regexp_replace(clean, '[^\p{{L}}]', '', 'g')) AS script,
             length(regexp_replace(clean, '[\p{{L}}\p{{N}}{_IN}]', '', 'g')) AS symbols,
             regexp_replace(substr(clean, 1, 4000), '{_W}+', '', 'g') AS dense FROM c),
g AS (SELECT *, CASE WHEN length(clean) = 0 THEN 1.0 ELSE CAST(symbols AS DOUBLE) / length(clean) END AS density,
             CASE WHEN length(dense) < 16 THEN 0.0 ELSE 1 - CAST(len(list_distinct(list_transform(range(1, length(dense) - 2), lambda i: substr(dense, i, 4)))) AS DOUBLE) / (length(dense) - 3) END AS repeats FROM s),
j AS (SELECT *, CASE WHEN script < 50 THEN 'too_short' WHEN density > 0.35 THEN 'symbol_dense'
             WHEN regexp_matches(lower(clean), '--checkpoint|--config|--device|init-from-checkpoint|traceback|python train|pip install|conda install|usage:|readme') THEN 'command_contaminated'
             WHEN repeats > 0.45 THEN 'repeated_ngram' ELSE 'kept' END AS reason,
             sha1(regexp_replace(clean, '{_W}+', '', 'g')) AS key, CAST(strlen(to_json({{'text': clean}})) + 1 AS BIGINT) AS bytes FROM g)
"""
_KEPT = _JUDGED + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM j WHERE reason = 'kept') WHERE rn = 1)"
_DRAW = "CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 12)) AS BIGINT) / 281474976710656.0"


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.judged(spread(table(spark, d, "documents").select("doc_id", "text", "source")), script=LETTERS)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    # judged rows are written before they're filtered: a filter on the reason would move below the exchange, with all its text work
    judged = materialise(_docs(spark, d).select("doc_id", "source", "reason", "key", "bytes"), "judged")
    return ordered.first_of_each(judged.filter("reason = 'kept'"), "key", "doc_id")


@query(
    f"WITH {_JUDGED}, f AS (SELECT *, row_number() OVER (PARTITION BY key, reason ORDER BY doc_id) AS rn FROM j) SELECT source, count(*) AS seen, count(*) FILTER (reason = 'kept' AND rn = 1) AS kept, count(*) FILTER (reason = 'kept' AND rn > 1) AS duplicate, "
    + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("too_short", "symbol_dense", "command_contaminated", "repeated_ngram"))
    + ", CAST(coalesce(sum(bytes) FILTER (reason = 'kept' AND rn = 1), 0) AS BIGINT) AS kept_bytes FROM f GROUP BY source"
)
def clean_filter_counts(spark, d):
    return corpus.counters(_docs(spark, d), "doc_id", ["source"])


@query(f"WITH {_JUDGED} SELECT doc_id, reason, key, bytes, length(clean) AS clean_chars FROM j")
def filter_reasons(spark, d):
    return _docs(spark, d).select("doc_id", "reason", "key", "bytes", F.length("clean").alias("clean_chars"))


@query(f"WITH {_JUDGED} SELECT doc_id, script, round(CAST(script AS DOUBLE) / greatest(length(clean), 1), 9) AS ratio, round(density, 9) AS density, round(repeats, 9) AS repeats, replace(substr(clean, 1, 300), chr(10), '\\n') AS preview FROM g")
def text_scalars(spark, d):
    t = F.col("clean")
    return _docs(spark, d).select("doc_id", T.script_count(t, LETTERS).alias("script"), F.round(T.script_ratio(t, LETTERS), 9).alias("ratio"), F.round(T.symbol_density(t), 9).alias("density"), F.round(T.repeated_ngrams(t), 9).alias("repeats"), T.preview(t).alias("preview"))


@query(f"WITH {_JUDGED} SELECT source, reason, count(*) AS n FROM j GROUP BY source, reason")
def filter_reason_by_source(spark, d):
    return _docs(spark, d).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(
    rf"WITH p AS (SELECT length(text) AS n, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS c, sha1(regexp_replace(text, '{_W}+', '', 'g')) AS key, regexp_matches(lower(text), '--checkpoint|--config|--device|init-from-checkpoint|traceback|python train|pip install|conda install|usage:|readme') AS bad FROM documents) "
    "SELECT count(*) AS rows, CAST(sum(n) AS DOUBLE) / count(*) AS avg_chars, CAST(sum(c) AS DOUBLE) / sum(n) AS script_ratio, CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) AS contaminated_ratio, CAST(count(*) - count(DISTINCT key) AS DOUBLE) / count(*) AS duplicate_ratio, CAST(count(*) FILTER (c < 50) AS DOUBLE) / count(*) AS too_short_ratio FROM p"
)
def corpus_profile(spark, d):
    return corpus.profile(spread(table(spark, d, "documents").select("text")), script=LETTERS)


@query(f"WITH {_JUDGED} SELECT key, count(*) AS n, min(doc_id) AS first_id FROM j GROUP BY key HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return _docs(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"WITH {_KEPT} SELECT doc_id, key FROM k")
def first_wins_dedup(spark, d):
    return _kept(spark, d).select("doc_id", "key")


@query(f"WITH {_KEPT} SELECT source, CAST(sum(bytes) AS BIGINT) AS kept_bytes FROM k GROUP BY source")
def bytes_by_category(spark, d):
    return _kept(spark, d).groupBy("source").agg(F.sum("bytes").alias("kept_bytes"))


@query(f"WITH {_KEPT} SELECT doc_id, source, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k) WHERE b < CASE source WHEN 'src0' THEN 60000 WHEN 'src1' THEN 25000 ELSE 20000 END")
def quota_by_source(spark, d):
    quota = F.when(F.col("source") == "src0", 60_000).when(F.col("source") == "src1", 25_000).otherwise(20_000)
    return ordered.under_quota(_kept(spark, d), "bytes", quota, "doc_id", ["source"]).select("doc_id", "source", "bytes")


@query(f"WITH {_KEPT} SELECT doc_id, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k) WHERE b < 500000")
def global_byte_target(spark, d):
    return ordered.under_quota(_kept(spark, d), "bytes", F.lit(500_000), "doc_id").select("doc_id", "bytes")


@query(f"WITH v AS (SELECT doc_id FROM documents WHERE {_DRAW.format(seed=0, key='doc_id')} < 0.05 ORDER BY {_DRAW.format(seed=0, key='doc_id')}, doc_id LIMIT 40) SELECT d.doc_id, v.doc_id IS NOT NULL AS valid FROM documents d LEFT JOIN v USING (doc_id)")
def hash_valid_split(spark, d):
    return ordered.valid_split(table(spark, d, "documents"), "doc_id", 0.05, 40).select("doc_id", "valid")


@query(
    f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(floor({_DRAW.format(seed=0, key='doc_id')} * 281474976710656) AS BIGINT)) - 1 AS r, count(*) OVER () AS n FROM documents) "
    "SELECT doc_id, CASE WHEN r < floor(n * 0.95) THEN 'train' WHEN r < floor(n * 0.95) + floor(n * 0.03) THEN 'val' ELSE 'test' END AS split FROM p"
)
def ratio_split(spark, d):
    return ordered.ratio_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_DRAW.format(seed=7, key='doc_id')}, doc_id LIMIT 100")
def reservoir_sample(spark, d):
    return ordered.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@query(f"SELECT doc_id, CASE WHEN h < 0.3 THEN 'general_qa' WHEN h < 0.45 THEN 'simple_format' WHEN h < 0.65 THEN 'json_escape' WHEN h < 0.8 THEN 'markdown_nested' WHEN h < 0.9 THEN 'control_trap' ELSE 'mixed_format' END AS task FROM (SELECT doc_id, {_DRAW.format(seed=3, key='doc_id')} AS h FROM documents)")
def weighted_task(spark, d):
    return table(spark, d, "documents").select("doc_id", ordered.weighted_choice(F.col("doc_id"), instructions.TASKS, 3).alias("task"))


_PAIRS = "pr AS (SELECT conv_id, turn, text AS prompt, a AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _pairs(spark, d):
    return instructions.turn_pairs(table(spark, d, "conversations"))


@query(f"WITH {_PAIRS} SELECT * FROM pr")
def turn_pairs(spark, d):
    return _pairs(spark, d)


@query(
    f"WITH {_PAIRS}, h AS (SELECT conv_id, turn, prompt, list('问题：' || {_strip('prompt')} || chr(10) || '回答：' || {_strip('answer')} || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past FROM pr) "
    f"SELECT conv_id, turn, CASE WHEN len(past) > 0 THEN '以下是用户与助手的多轮对话。请结合上下文回答当前用户问题。' || chr(10) || array_to_string(past, '') ELSE '' END || '问题：' || {_strip('prompt')} || chr(10) || '回答：' AS chat_prompt FROM h"
)
def chat_history_prompt(spark, d):
    return instructions.chat_prompts(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, '### Instruction:' || chr(10) || {_strip('prompt')} || chr(10) || chr(10) || '### Response:' || chr(10) || {_strip('answer')} || chr(10) AS text FROM pr")
def instruction_texts(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", T.instruction_text(F.col("prompt"), F.col("answer")).alias("text"))


_KEYED = f"{_PAIRS}, q AS (SELECT *, conv_id * 1000 + turn AS ord, sha256({_strip('prompt || chr(10) || answer')}) AS key FROM pr)"


def _keyed(spark, d):
    return _pairs(spark, d).withColumn("ord", F.col("conv_id") * 1000 + F.col("turn")).withColumn("key", T.sample_key(F.col("prompt"), F.col("answer")))


@query(f"WITH {_KEYED} SELECT min(ord) AS ord, key FROM q GROUP BY key")
def sft_key_dedup(spark, d):
    return ordered.first_of_each(_keyed(spark, d), "key", "ord").select("ord", "key")


@query(f"WITH {_KEYED} SELECT ord, key FROM q WHERE key NOT IN (SELECT key FROM q WHERE ord % 3 = 0)")
def existing_anti_join(spark, d):
    q = _keyed(spark, d)
    return instructions.without_existing(q, q.filter("ord % 3 = 0")).select("ord", "key")


def _samples(spark, d):
    """Pairs as instruction samples of tasks and formats drawn by key, some of them wrong."""
    pick = lambda names, seed: F.element_at(F.array(*map(F.lit, names)), (F.floor(ordered.hashed(F.col("key"), seed) * len(names)) + 1).cast("int"))
    q = _keyed(spark, d)
    return q.select("ord", "key", pick([*instructions.TASKS, "other"], 11).alias("task_type"), pick([*instructions.FORMATS, "pdf"], 12).alias("format"), F.lit(1).alias("difficulty"), F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.when(F.pmod("ord", F.lit(4)) == 0, F.lit('{"a": [1, 2]}')).otherwise(F.col("answer")).alias("output"))


def _picked(names: list[str], seed: int) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"list_extract([{listed}], CAST(floor({_DRAW.format(seed=seed, key='key')} * {len(names)}) AS BIGINT) + 1)"


_SAMPLES = f"{_KEYED}, sm AS (SELECT ord, key, {_picked([*instructions.TASKS, 'other'], 11)} AS task_type, {_picked([*instructions.FORMATS, 'pdf'], 12)} AS format, {_strip('prompt')} AS ask, {_strip(chr(67) + 'ASE WHEN ord % 4 = 0 THEN ' + chr(39) + '{' + chr(34) + 'a' + chr(34) + ': [1, 2]}' + chr(39) + ' ELSE answer END')} AS said FROM q)"
#: The fixtures' answers are prose: not JSON from the first letter on, and without fences.
_NO_JSON = "Expecting value: line 1 column 1 (char 0)"
_TRAPPED = " OR ".join(f"contains(ask, '{m}')" for m in instructions.TRAPS)


def _checked(structured: bool) -> str:
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    more = structured and f"WHEN format = 'json' AND left(said, 1) NOT IN ('{{', '[') THEN 'json_output_must_start_with_object_or_array' " or ""
    yaml = structured and "WHEN format = 'yaml' AND (NOT contains(said, ':') OR left(said, 1) IN ('{', '[')) THEN 'yaml_output_invalid_shape' " or ""
    tasks = [*instructions.TASKS, *(instructions.STRUCTURED if structured else ())]
    array = structured and "WHEN format = 'json' AND task_type = 'json_array_output' THEN 'json_output_must_be_array' " or ""
    return (
        f"v AS (SELECT *, CASE WHEN task_type NOT IN ({listed(tasks)}) THEN 'bad_task_type:' || task_type WHEN format NOT IN ({listed(instructions.FORMATS)}) THEN 'bad_format:' || format "
        f"WHEN ask = '' THEN 'empty_instruction' WHEN said = '' THEN 'empty_output' WHEN length(ask) > 1200 THEN 'instruction_too_long' WHEN length(said) > 6000 THEN 'output_too_long' {more}"
        f"WHEN format = 'json' AND ord % 4 <> 0 THEN 'json_output_invalid:{_NO_JSON}' {array}{yaml}WHEN task_type = 'control_trap' AND NOT ({_TRAPPED}) THEN 'control_trap_not_obvious' ELSE 'ok' END AS reason FROM sm)"
    )


@query(f"WITH {_SAMPLES}, {_checked(False)} SELECT ord, task_type, format, reason FROM v")
def sample_validation(spark, d):
    return instructions.check_samples(_samples(spark, d)).select("ord", "task_type", "format", "reason")


@query(f"WITH {_SAMPLES}, {_checked(True)} SELECT ord, task_type, format, reason FROM v")
def sample_validation_structured(spark, d):
    return instructions.check_samples(_samples(spark, d), structured=True).select("ord", "task_type", "format", "reason")


@query(f"WITH {_SAMPLES}, {_checked(False)}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256({_strip('ask || chr(10) || said')}) ORDER BY ord) AS rn FROM v WHERE reason = 'ok') WHERE rn = 1) SELECT task_type, format, count(*) AS n FROM f GROUP BY GROUPING SETS ((task_type), (format), ())")
def merge_statistics(spark, d):
    return instructions.merge_stats(instructions.merge_samples([_samples(spark, d)], "ord"))


_PLANNED = ", ".join(f"('{k}', {v})" for k, v in instructions.PLAN.items())


@query(f"WITH {_SAMPLES}, p(task_type, target) AS (VALUES {_PLANNED}), c AS (SELECT task_type, count(*) AS n FROM sm GROUP BY task_type) SELECT task_type, target, coalesce(n, 0) AS n, greatest(target - coalesce(n, 0), 0) AS missing FROM p LEFT JOIN c USING (task_type)")
def plan_progress(spark, d):
    return instructions.plan_counts(_samples(spark, d).groupBy("task_type").agg(F.count("*").alias("n")))


_TOKEN = r"""`{3,}[A-Za-z0-9_-]*|~{3,}[A-Za-z0-9_-]*|\\\"|\\\\|\\n|\r\n|\n|\t|[ \f\v]+|[A-Za-z_][A-Za-z_0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[\x{4e00}-\x{9fff}]|[^""" + _IN + r"A-Za-z_0-9]"
_TOKENS = f"t AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_TOKEN}') AS tokens FROM documents)"
_FLAT = f"{_TOKENS}, e AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM t)"
_SEED_ROWS = ", ".join("('{}', {})".format(t.replace("'", "''"), i) for i, t in enumerate(dict.fromkeys(K.SPECIALS + K.SEEDS)))
_VOCAB = f"{_FLAT}, seed(token, token_id) AS (VALUES {_SEED_ROWS}), cnt AS (SELECT token, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM e WHERE token NOT IN (SELECT token FROM seed) GROUP BY token), voc AS (SELECT token, token_id FROM seed UNION ALL SELECT token, 25 + row_number() OVER (ORDER BY n DESC, f) AS token_id FROM (SELECT * FROM cnt ORDER BY n DESC, f LIMIT 974))"


def _tokens(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", K.tokenise(F.col("text")).alias("tokens"))


def _vocab(spark, d):
    return materialise(K.train_vocabulary(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id", 1000), "vocabulary")


@query(f"WITH {_TOKENS} SELECT source, count(*) AS rows, CAST(sum(len(tokens) + 2) AS BIGINT) AS n_tokens FROM t WHERE text <> '' GROUP BY source")
def token_counts(spark, d):
    return _tokens(spark, d).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.size("tokens") + 2).alias("n_tokens"))


@query(f"WITH {_FLAT} SELECT token, count(*) AS n FROM e GROUP BY token")
def token_frequency(spark, d):
    return _tokens(spark, d).select(F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_VOCAB} SELECT token, token_id FROM voc")
def vocab_topk(spark, d):
    return _vocab(spark, d)


@query(f"WITH {_VOCAB}, i AS (SELECT e.doc_id, list(coalesce(v.token_id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN voc v USING (token) GROUP BY e.doc_id) SELECT doc_id, len(ids) + 2 AS n, md5('2,' || array_to_string(ids, ',') || ',3') AS ids_md5 FROM i")
def encode_ids(spark, d):
    ids = K.encode(_tokens(spark, d), _vocab(spark, d), "doc_id")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"))


@query(f"WITH {_VOCAB} SELECT e.doc_id, md5(string_agg(CASE WHEN v.token IS NULL THEN '<unk>' ELSE e.token END, '' ORDER BY e.pos)) AS text_md5 FROM e LEFT JOIN voc v USING (token) GROUP BY e.doc_id")
def decode_ids(spark, d):
    v = _vocab(spark, d)
    text = K.decode(materialise(K.encode(_tokens(spark, d), v, "doc_id"), "ids"), v, "doc_id")
    return text.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_LENGTHS = f"{_FLAT}, w AS (SELECT length(token) AS x, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM e)"


def _lengths(spark, d):
    """Documents with their tokens' lengths in place of ids."""
    return materialise(_tokens(spark, d).select("doc_id", F.transform("tokens", F.length).alias("ids")), "lengths")


@query(f"WITH {_LENGTHS} SELECT g // 512 AS block_id, count(*) AS n, md5(string_agg(x, ',' ORDER BY g)) AS block_md5 FROM w GROUP BY 1 HAVING count(*) = 512")
def pack_blocks(spark, d):
    blocks = ordered.chunks(_lengths(spark, d), "doc_id", "ids", 512)
    return blocks.select("block_id", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("block_md5"))


@query(f"WITH {_FLAT}, w AS (SELECT length(token) AS x, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM e), m AS (SELECT g // 384 - s AS block_id, g, x FROM w, range(2) r(s)) SELECT block_id, md5(string_agg(x, ',' ORDER BY g)) AS block_md5 FROM m WHERE block_id >= 0 AND g >= block_id * 384 AND g < block_id * 384 + 512 GROUP BY block_id HAVING count(*) = 512")
def pack_strided(spark, d):
    blocks = ordered.chunks(_lengths(spark, d), "doc_id", "ids", 512, 384)
    return blocks.select("block_id", F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("block_md5"))


@query(f"WITH {_FLAT}, w AS (SELECT length(token) AS x, row_number() OVER o - 1 AS g, lead(length(token), 8) OVER o AS y FROM e WINDOW o AS (ORDER BY doc_id, pos)) SELECT g AS block_id, x AS first_x, y AS last_y FROM w WHERE y IS NOT NULL")
def dense_windows(spark, d):
    """Stride-1 windows over all tokens: inherently a window a token."""
    w = ordered.dense_windows(_lengths(spark, d), "doc_id", "ids", 8)
    return w.select("block_id", F.element_at("x", 1).alias("first_x"), F.element_at("y", -1).alias("last_y"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents QUALIFY batch_id < (SELECT count(*) // 32 FROM documents)")
def batch_ids(spark, d):
    return ordered.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32, drop_last=True)


@query(f"WITH RECURSIVE {_KEPT}, o AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, bytes FROM k), r AS (SELECT i, doc_id, bytes, 0 AS shard_id, bytes AS fill FROM o WHERE i = 1 UNION ALL SELECT o.i, o.doc_id, o.bytes, CASE WHEN r.fill + o.bytes > 20000 THEN r.shard_id + 1 ELSE r.shard_id END, CASE WHEN r.fill + o.bytes > 20000 THEN o.bytes ELSE r.fill + o.bytes END FROM r JOIN o ON o.i = r.i + 1) SELECT shard_id, count(*) AS samples, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY shard_id")
def shard_manifest(spark, d):
    kept = materialise(_kept(spark, d).select("doc_id", "bytes"), "kept")
    return ordered.assign_shards(kept, "bytes", 20_000, "doc_id").groupBy("shard_id").agg(F.count("*").alias("samples"), F.sum("bytes").alias("bytes"))


@query("WITH v AS (SELECT d.lang AS task_type, l.toxic = 0 AS ok FROM documents d JOIN labels l USING (doc_id)) SELECT coalesce(task_type, '(all)') AS task_type, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS pass_rate FROM v GROUP BY ROLLUP (task_type)")
def pass_fail_metrics(spark, d):
    v = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("task_type"), (F.col("toxic") == 0).alias("ok"))
    return instructions.pass_rates(v, "task_type")


@query("SELECT 'toxic ' || quality AS reason, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1")
def failure_histogram(spark, d):
    v = table(spark, d, "labels").select((F.col("toxic") == 0).alias("ok"), F.concat(F.lit("toxic "), F.col("quality").cast("string"), F.lit(": at "), F.col("doc_id").cast("string")).alias("reason"))
    return instructions.failure_reasons(v)


@query("WITH v AS (SELECT CASE d.lang WHEN 'en' THEN 'json' WHEN 'de' THEN 'markdown' ELSE 'mixed' END AS g, l.quality = 1 AS ok FROM documents d JOIN labels l USING (doc_id)) SELECT count(*) AS total, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS overall_pass_rate, CAST(count(*) FILTER (NOT ok) AS DOUBLE) / count(*) AS fer, CAST(count(*) FILTER (ok AND g = 'json') AS DOUBLE) / count(*) FILTER (g = 'json') AS json_ppr, CAST(count(*) FILTER (ok AND g = 'markdown') AS DOUBLE) / count(*) FILTER (g = 'markdown') AS markdown_tdr, CAST(count(*) FILTER (ok AND g = 'mixed') AS DOUBLE) / count(*) FILTER (g = 'mixed') AS mixed_ppr FROM v")
def evaluation_metrics(spark, d):
    v = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.when(F.col("lang") == "en", "json").when(F.col("lang") == "de", "markdown").otherwise("mixed").alias("group"), (F.col("quality") == 1).alias("ok"))
    return instructions.evaluation(v)


@query("SELECT event_id, json_valid(props) AS valid, 'object' AS kind FROM events")
def json_valid_props(spark, d):
    return table(spark, d, "events").select("event_id", S.json_kind("props").alias("k")).select("event_id", F.col("k.error").isNull().alias("valid"), F.col("k.kind").alias("kind"))


@query("SELECT event_id, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def running_best(spark, d):
    return instructions.best_so_far(table(spark, d, "events"), "event_id", "value", "user_id").select("event_id", "best", "improved")


@query("SELECT doc_id, round(CASE WHEN doc_id <= 100 THEN 0.0003 * doc_id / 100 ELSE 0.00003 + 0.5 * (1 + cos(pi() * least(greatest((doc_id - 100) / 900.0, 0.0), 1.0))) * 0.00027 END, 12) AS rate FROM documents")
def learning_rates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.learning_rate(F.col("doc_id"), 0.0003, 1000, 100, 0.00003), 12).alias("rate"))


@query("SELECT count(*) AS n, count(*) >= 100 AS ok FROM documents WHERE trim(text) <> ''")
def size_gate(spark, d):
    n = readers.count_rows(table(spark, d, "documents").select(F.col("text").alias("value")))
    return n.join(corpus.gate(n, {"too_few_rows": F.col("n") >= 100})).select("n", "ok")


@query("SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def lenient_scan(spark, d):
    """Texts written as JSON lines and read again by the tolerant reader."""
    path = scratch(spark, "lines")
    b = table(spark, d, "benchmark")
    b.select(F.to_json(F.struct(F.col("item_id").alias("id"), F.col("text").alias("content"))).alias("value")).write.text(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.id").cast("long").alias("item_id"), F.md5(readers.text_of(F.col("value")).cast("binary")).alias("text_md5"))


@query()
def markdown_checks(spark, d):
    return table(spark, d, "documents").select("doc_id", S.markdown_check("text").alias("markdown"), S.mixed_check("text").alias("mixed"), S.json_check("text").alias("json"), S.fences_balanced("text").alias("balanced"))


@query()
def mojibake_repair(spark, d):
    return table(spark, d, "documents").select("doc_id", (S.mojibake("text") != F.col("text")).alias("repaired"))


@query("WITH p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS s FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY s) AS n FROM p), st AS (SELECT range AS step, CASE WHEN range % 3 = 1 THEN 1 ELSE 0 END AS s, CASE WHEN range % 3 = 1 THEN range // 3 ELSE 2 * (range // 3) + range % 3 // 2 END AS want FROM range((SELECT count(*) FROM documents))) SELECT step, s, doc_id FROM st JOIN r USING (s) WHERE want % n = k")
def smooth_mix(spark, d):
    """As many steps as there are documents."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).alias("s"))
    return ordered.mix_streams(docs, "s", "doc_id", [2.0, 1.0], docs.count()).select("step", "s", "doc_id")


def _n(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_TOKEN}'))"


@query(f"WITH {_PAIRS} SELECT conv_id, turn, {_n('prompt')} + {_n('answer')} + 1 AS n, {_n('prompt')} AS masked FROM pr")
def masked_sequences(spark, d):
    n = lambda c: F.transform(K.tokenise(F.col(c)), F.length)
    return _pairs(spark, d).select("conv_id", "turn", ordered.masked(n("prompt"), n("answer")).alias("m")).select("conv_id", "turn", F.size("m.input_ids").alias("n"), F.size(F.filter("m.labels", lambda x: x == -100)).alias("masked"))


@query()
def synthetic_texts(spark, d):
    """Structured texts of the documents' own words."""
    docs = spread(table(spark, d, "documents")).select("doc_id", T.words(F.col("text")).alias("words"))
    made = materialise(readers.synthetic(docs, "doc_id", F.col("words")), "synthetic")
    return made.select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_HAN = ("etaoinshrdlu", "一丁七万丈三上下不与丐丑")


@query(
    f"WITH z AS (SELECT doc_id, translate(text, '{_HAN[0]}', '{_HAN[1]}') AS t FROM documents), j AS (SELECT doc_id, t, length(regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS han, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}{_IN}]', '', 'g')) AS symbols FROM z) "
    f"SELECT doc_id, han, round(CAST(han AS DOUBLE) / greatest(length(t), 1), 9) AS ratio, round(CASE WHEN length(t) = 0 THEN 1.0 ELSE CAST(symbols AS DOUBLE) / length(t) END, 9) AS density, han < 50 AS short, md5(regexp_replace(t, '([\\x{{4e00}}-\\x{{9fff}}]){_W}+', '\\1', 'g')) AS squeezed FROM j"
)
def han_scalars(spark, d):
    """The counts of CJK texts, made of documents whose commonest letters are other signs."""
    z = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.translate("text", *_HAN).alias("t"))
    t = F.col("t")
    squeezed = F.regexp_replace(t, f"([{T.CJK}])[{T.SPACE}]+", "$1")
    return z.select("doc_id", T.script_count(t).alias("han"), F.round(T.script_ratio(t), 9).alias("ratio"), F.round(T.symbol_density(t), 9).alias("density"), (T.keep_reason(t, most_symbols=1.0, most_repeats=1.0) == "too_short").alias("short"), F.md5(squeezed.cast("binary")).alias("squeezed"))


@query()
def subword_ids(spark, d):
    """Ids of a tokenizer file, and whether they lead back to the same ids."""
    import public_tokenizers

    from lectern.functions.subword import load_tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = load_tokenizer(f.read())
    ids = spread(table(spark, d, "documents")).select("doc_id", "text", made.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"))


_SHARES = "CASE WHEN source IN (" + ", ".join(f"'src{i}'" for i in range(20)) + ") THEN 20000.0 ELSE 400000.0 END"


@query(f"WITH {_KEPT}, vd AS (SELECT doc_id FROM k WHERE {_DRAW.format(seed=0, key='doc_id')} < 0.02 ORDER BY {_DRAW.format(seed=0, key='doc_id')}, doc_id LIMIT 50), m AS (SELECT k.*, vd.doc_id IS NOT NULL AS valid FROM k LEFT JOIN vd USING (doc_id)), a AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m WHERE NOT valid), z AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2 FROM a WHERE b < {_SHARES}) SELECT doc_id, source, bytes, valid FROM z WHERE b2 < 400000 UNION ALL SELECT doc_id, source, bytes, valid FROM m WHERE valid")
def prepared_corpus(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    return corpus.prepare(docs, "doc_id", "source", 400_000, {f"src{i}": 0.05 for i in range(20)}, 0.02, 50, script=LETTERS).select("doc_id", "source", "bytes", "valid")


@query(f"WITH {_KEYED} SELECT DISTINCT key FROM q")
def streamed_samples(spark, d):
    """Samples that arrive twice as a stream are appended once."""
    from lectern.streaming.ingest import append_new

    source, out, state = (scratch(spark, n) for n in ("in", "out", "state"))
    pairs = _pairs(spark, d).select(F.col("prompt").alias("instruction"), F.col("answer").alias("output"))
    for _ in range(2):
        pairs.write.mode("append").parquet(source)
        append_new(spark.readStream.schema(pairs.schema).parquet(source), out, state).awaitTermination()
    return spark.read.parquet(out).select("key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lectern.plans import flows, records, structures

    return _Q | records.queries() | structures.queries() | flows.queries()


def oracle_sql() -> dict[str, str]:
    from lectern.plans import flows, records, structures

    return _SQL | records.oracle_sql() | structures.oracle_sql() | flows.oracle_sql()
