"""Queries of the annotator and of annotated sequences, over texts made of events' JSON, fences and quotes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import structure as S
from lectern.functions import tokens as K
from lectern.operators import annotation, sequences
from lectern.plans.catalogue import _TOKEN, _VOCAB, _strip, _vocab
from lectern.session import materialise, spread, table

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_NL = "chr(10)"
#: Texts of four kinds: JSON; nested fences with JSON and a quote over two lines; JSON escaped in a string; fences of another kind that stay open.
_MADE = (
    "m AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props "
    f"WHEN 1 THEN '````markdown' || {_NL} || '```json' || {_NL} || props || {_NL} || '```' || {_NL} || event_type || ' \"' || event_type || {_NL} || '\" ````' || {_NL} || '````' || {_NL} || '[' || props "
    "WHEN 2 THEN 'say \"' || replace(props, '\"', '\\\"') || '\" \\n' || props || ']' "
    f"ELSE '~~~' || {_NL} || event_type || {_NL} || '~~~~ x' || {_NL} || '{{' || props || {_NL} || {_NL} || '  ```' || {_NL} || '\"a\\' || props END AS text FROM events)"
)


def _made(spark: SparkSession, d: str) -> DataFrame:
    p, t, k = F.col("props"), F.col("event_type"), F.pmod("event_id", F.lit(4))
    said = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    text = F.when(k == 0, p).when(k == 1, said("````markdown\n```json\n", p, "\n```\n", t, ' "', t, '\n" ````\n````\n[', p))
    text = text.when(k == 2, said('say "', F.replace(p, F.lit('"'), F.lit('\\"')), '" \\n', p, "]")).otherwise(said("~~~\n", t, "\n~~~~ x\n{", p, '\n\n  ```\n"a\\', p))
    return spread(table(spark, d, "events").select("event_id", "event_type", "props")).select("event_id", "event_type", text.alias("text"))


def _walk(depth: str, state: str, zero: str) -> str:
    """A token list as one state after another: string state, brackets, fences, line, and what `depth` and `state` make of depth and state. Null tokens change nothing."""
    row = lambda t: f"{{'t': {t}, 's': 0, 'b': '', 'f': []::VARCHAR[], 'n': true, 'd': {zero}, 'k': {zero}}}"
    at_depth = "CASE WHEN e.t IS NULL THEN 0 ELSE CAST(least(length(a.b) + len(a.f), 32) AS INTEGER) END"
    at_state = r"""CASE WHEN e.t IS NULL THEN 0 WHEN a.s = 2 OR a.s = 1 AND e.t IN ('\"', '\\', '\n') THEN 4 WHEN a.s = 1 THEN 3 WHEN right(a.b, 1) = '{' THEN 1 WHEN a.b <> '' THEN 2 WHEN len(a.f) > 1 THEN 7 WHEN len(a.f) = 1 THEN 6 WHEN a.n THEN 0 ELSE 5 END"""
    return (
        f"list_reduce(list_prepend({row(chr(39) * 2)}, list_transform(tokens, lambda x: {row('x')})), lambda a, e: {{'t': e.t, "
        r"""'s': CASE WHEN e.t IS NULL THEN a.s WHEN a.s = 2 THEN 1 WHEN a.s = 1 THEN CASE e.t WHEN '\' THEN 2 WHEN '"' THEN 0 ELSE 1 END WHEN e.t = '"' THEN 1 ELSE 0 END, """
        r"""'b': CASE WHEN e.t IS NULL OR a.s > 0 THEN a.b WHEN e.t IN ('{', '[') THEN a.b || e.t WHEN e.t IN ('}', ']') THEN left(a.b, greatest(length(a.b) - 1, 0)) ELSE a.b END, """
        r"""'f': CASE WHEN e.t IS NULL OR NOT a.n OR NOT regexp_matches(e.t, '^(`{3}|~{3})') THEN a.f WHEN regexp_matches(e.t, '^(`+|~+)$') AND len(a.f) > 0 AND left(a.f[-1], 1) = left(e.t, 1) AND length(e.t) >= length(a.f[-1]) THEN a.f[:-2] ELSE list_append(a.f, regexp_extract(e.t, '^(`+|~+)')) END, """
        r"""'n': CASE WHEN e.t IS NULL THEN a.n WHEN contains(e.t, chr(10)) THEN true WHEN regexp_matches(e.t, '^[ \t\f\v]+$') THEN a.n ELSE false END, """
        f"'d': {depth.format(at_depth)}, 'k': {state.format(at_state)}}})"
    )


_LISTS = _walk("list_append(a.d, {})", "list_append(a.k, {})", "[]::INTEGER[]")
_SAID = f"WITH {_MADE}, tk AS (SELECT event_id, regexp_extract_all(text, '{_TOKEN}') AS tokens FROM m), s AS (SELECT event_id, {_LISTS} AS r FROM tk) SELECT event_id, md5(array_to_string(r.d, ',')) AS depth_md5, md5(array_to_string(r.k, ',')) AS state_md5 FROM s"


def _digest(c) -> F.Column:
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))


@query(_SAID)
def annotate_made(spark, d):
    """Depths and states of every token."""
    return _made(spark, d).select("event_id", S.annotations(K.tokenise(F.col("text"))).alias("a")).select("event_id", _digest("a.depth").alias("depth_md5"), _digest("a.state").alias("state_md5"))


@query(_SAID)
def annotate_pieces(spark, d):
    """The same of texts that are cut into pieces of about 16 characters."""
    rows = annotation.annotate_texts(_made(spark, d), "event_id", chars=16)
    whole = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("piece", "depth", "state"))).alias("p"))
    return whole.select("event_id", _digest(F.flatten(F.col("p.depth"))).alias("depth_md5"), _digest(F.flatten(F.col("p.state"))).alias("state_md5"))


_FIGURES = _walk("greatest(a.d, {})", "a.k | (1 << ({}))", "0")


@query(f"WITH tk AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS tokens FROM documents), s AS (SELECT doc_id, len(tokens) AS n, {_FIGURES} AS r FROM tk) SELECT doc_id, n, r.d AS deepest, bit_count(r.k) AS states FROM s")
def annotate_states(spark, d):
    """Depth and state figures of every document's tokens."""
    rows = table(spark, d, "documents").select("doc_id", S.annotations(K.tokenise(F.col("text"))).alias("a"))
    return rows.select("doc_id", F.size("a.depth").alias("n"), F.coalesce(F.array_max("a.depth"), F.lit(0)).alias("deepest"), F.size(F.array_distinct("a.state")).alias("states"))


@query(
    f"WITH {_VOCAB}, {_MADE}, x AS (SELECT event_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT event_id, regexp_extract_all(text, '{_TOKEN}') AS w FROM m)), "
    f"tk AS (SELECT event_id, list(v.token ORDER BY pos) AS tokens FROM x LEFT JOIN voc v USING (token) GROUP BY event_id), s AS (SELECT event_id, {_LISTS} AS r FROM tk) "
    "SELECT event_id, md5('0,' || array_to_string(r.d, ',') || ',0') AS depth_md5, md5('0,' || array_to_string(r.k, ',') || ',0') AS state_md5 FROM s"
)
def annotate_ids(spark, d):
    """Depths and states told from ids alone: unknown tokens and specials are left out."""
    v = _vocab(spark, d)
    tokens = _made(spark, d).select("event_id", K.tokenise(F.col("text")).alias("tokens"))
    a = K.annotate_ids(materialise(K.encode(tokens, v, "event_id"), "ids"), v, "event_id")
    return a.select("event_id", _digest("depth_ids").alias("depth_md5"), _digest("state_ids").alias("state_md5"))


_PARTS = f"SELECT event_id, regexp_extract_all('问题：' || {_strip('event_type')} || chr(10) || '回答：', '{_TOKEN}') AS q, regexp_extract_all({_strip('text')} || chr(10), '{_TOKEN}') AS a FROM m"


@query(
    f"WITH {_VOCAB}, {_MADE}, p AS ({_PARTS}), tk AS (SELECT event_id, len(q) AS asked, q || a AS tokens FROM p), s AS (SELECT event_id, asked, tokens, {_LISTS} AS r FROM tk), "
    "x AS (SELECT event_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tk), i AS (SELECT event_id, list(coalesce(v.token_id, 1) ORDER BY pos) AS ids FROM x LEFT JOIN voc v USING (token) GROUP BY event_id), "
    "o AS (SELECT event_id, asked, ids, r.d AS d, r.k AS k FROM s JOIN i USING (event_id)) "
    "SELECT event_id, md5('2,' || array_to_string(ids, ',')) AS input_ids, md5(array_to_string(list_transform(ids, lambda t, j: CASE WHEN j <= asked THEN -100 ELSE t END) || [3], ',')) AS labels, "
    "md5('0,' || array_to_string(d, ',')) AS depth_ids, md5('0,' || array_to_string(k, ',')) AS state_ids, "
    "md5(array_to_string(list_transform(d, lambda t, j: CASE WHEN j <= asked THEN -100 ELSE t END) || [0], ',')) AS depth_targets, md5(array_to_string(list_transform(k, lambda t, j: CASE WHEN j <= asked THEN -100 ELSE t END) || [0], ',')) AS state_targets FROM o"
)
def encode_structured(spark, d):
    """The six sequences of pairs with structured answers, by value."""
    rows = _made(spark, d).select("event_id", F.col("event_type").alias("prompt"), F.col("text").alias("answer"))
    e = sequences.encode_rows(rows, _vocab(spark, d), "event_id")
    return e.select("event_id", *[_digest(c).alias(c) for c in sequences.SEQUENCES])


#: Answers around documents: closed; closed early; with an inner fence that could close the outer one; JSON in an inner fence; not opened; opened with a wrong name.
_ANSWERS = (
    f"n AS (SELECT doc_id, text, source, doc_id % 6 AS k, 1 + len(regexp_extract_all(text, '\\r\\n|[\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS n FROM documents), "
    "w AS (SELECT *, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'early_outer_fence_close_at_line_' || (n + 2) WHEN 2 THEN 'inner_fence_can_conflict_with_outer_at_line_' || (n + 2) WHEN 3 THEN 'ok' WHEN 4 THEN 'missing_outer_opening_fence' ELSE 'unexpected_outer_fence_suffix: ' || source END AS markdown FROM n)"
)


@query(f"WITH {_ANSWERS} SELECT doc_id, markdown, CASE k WHEN 0 THEN 'mixed_no_json_block_found' WHEN 3 THEN 'ok' ELSE 'mixed_markdown_failed: ' || markdown END AS mixed, k IN (0, 3, 5) AS balanced, CASE WHEN k = 3 THEN md5(text) END AS block_md5 FROM w")
def fence_reasons(spark, d):
    """Checks of fenced answers in both dialects, and what their JSON blocks hold."""
    t, k = F.col("text"), F.pmod("doc_id", F.lit(6))
    said = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    quoted = F.regexp_extract(F.to_json(F.struct(t.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    answer = F.when(k == 0, said("```markdown\n", t, "\n```")).when(k == 1, said("```\n", t, "\n```\n", t, "\n```")).when(k == 2, said("```\n", t, "\n````\n```"))
    answer = answer.when(k == 3, said("````md\n```json\n", quoted, "\n```\n````")).when(k == 4, said(t, "\n```")).otherwise(said("~~~", F.col("source"), "\n", t, "\n~~~"))
    a = materialise(table(spark, d, "documents").select("doc_id", answer.alias("a")), "answers")
    block = F.get(S.json_blocks_of("a"), F.lit(0))
    return a.select("doc_id", S.markdown_check("a").alias("markdown"), S.mixed_check("a").alias("mixed"), S.fences_balanced("a").alias("balanced"), F.md5(F.from_json(F.concat(F.lit('{"t":'), block, F.lit("}")), "t string")["t"].cast("binary")).alias("block_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
