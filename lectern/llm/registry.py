"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import embedding_dedup, exact_dedup, html_text, licences, merkle, mixing, near_dedup, packing, pieces, token_files, toxicity, warc, whitening
from lectern.session import scratch, table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).drop("ids")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, path)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), least=0.93)


OP3_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), cnt AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(cnt.n, 0) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN cnt ON cnt.a = e.vec_id
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response and a not-modified answer; the answers resolved. Headers as sorted JSON-like text."""
    out = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select(F.col("record_id").alias("page_id"), "url_key", "outcome", "refers_to", F.col("digest").alias("payload_md5"), F.col("length").alias("payload_chars"), said.alias("headers"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, html, md5(coalesce(html, '')) AS tag, 1700000000000000 + page_id * 60000000 AS ts,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest
  FROM pages
), k AS (
  SELECT *, ts + CASE WHEN page_id % 10 = 9 THEN -30000000 ELSE (page_id % 7) * 3600000000 + 90000000 END AS later,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref)='))), '&') AS kept
  FROM p
), u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[0-9]*\.', '')
            || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', ''), '\.html$', '')
            || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url_key
  FROM k
), m AS (
  SELECT r.page_id, r.url_key, r.tag, r.later, s.page_id AS to_id, s.tag AS to_tag, length(s.html) AS to_chars
  FROM u r ASOF LEFT JOIN u s ON r.url_key = s.url_key AND r.later > s.ts
)
SELECT page_id, url_key, CASE WHEN to_id IS NULL THEN 'no_earlier' WHEN tag = to_tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN tag = to_tag THEN to_id END AS refers_to, CASE WHEN tag = to_tag THEN to_tag END AS payload_md5,
       CASE WHEN tag = to_tag THEN to_chars END AS payload_chars,
       CASE WHEN tag = to_tag THEN 'cache-control=max-age=3600;content-length=' || to_chars || ';content-type=text/html;etag=W/' || tag || ';expires=' || later END AS headers
FROM m
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), exact_dedup.in_first_half())


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(table(spark, sf_dir, "documents"), wrapped=True)
    return out.withColumn("families", F.array_join("families", ","))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), percent=85).drop("k1", "k2")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the manifest, and whether the document as it is handed over belongs there: of those whose id's crc32 divides by 7, n_chars is handed over one too high."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    more = [(F.col(f).cast("decimal(20,0)") + 1) if f == "n_chars" else F.col(f) for f in fields]
    claimed = F.when(tampered, merkle.leaf(*more))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), fields, "doc_id", "lang", 2, claimed)
    return merkle.verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Digests that the tree needs are those of hex texts; a level of all groups is made at a time, then each document climbs its path.
OP11_SQL = """
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS bad
  FROM documents, tbl
), f AS (
  SELECT doc_id, coalesce('v' || lang, '-') AS grp,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS b,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS b1,
    coalesce(strlen(text) || ':' || text, '-') AS c, coalesce(bad, false) AS bad
  FROM d
), leaves AS (
  SELECT doc_id, grp, sha256(a || b || c) AS leaf, sha256(a || CASE WHEN bad THEN b1 ELSE b END || c) AS claimed,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, sha256(a || b || c)) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
  FROM f
), low AS (
  SELECT 0 AS lvl, grp, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, grp, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lvl, grp, idx // 2, n
), subs AS (
  SELECT grp, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 2, n
), nodes AS (
  SELECT low.lvl, low.grp, low.idx, low.h FROM low JOIN subs USING (grp) WHERE low.n > 1
  UNION ALL
  SELECT subs.depth + high.lvl, subs.grp, high.idx, high.h FROM high, subs WHERE high.n > 1
), climb AS (
  SELECT l.doc_id, l.leaf, l.grp, s.subroot, 0 AS lvl, l.idx, s.depth, s.idx AS sub_idx, l.claimed AS x, '' AS proof,
         s.depth + (SELECT max(lvl) FROM high) AS top FROM leaves l JOIN subs s USING (grp)
  UNION ALL
  SELECT c.doc_id, c.leaf, c.grp, c.subroot, c.lvl + 1, here // 2, c.depth, c.sub_idx,
         CASE WHEN n.h IS NULL THEN sha256(c.x) WHEN here % 2 = 0 THEN sha256(c.x || n.h) ELSE sha256(n.h || c.x) END,
         c.proof || coalesce(n.h, ''), c.top
  FROM (SELECT *, CASE WHEN lvl = depth THEN sub_idx ELSE idx END AS here FROM climb WHERE lvl < top) c
  LEFT JOIN nodes n ON n.lvl = c.lvl AND n.grp = c.grp AND n.idx = c.here + 1 - 2 * (c.here % 2)
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified
FROM climb, (SELECT h FROM high WHERE n = 1) r WHERE lvl = top
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), block=1024, end_id=2)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"), components=32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_token_files": op2_token_files,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_mixing": op4_mixing,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_licences": op7_licences,
        "op8_near_dedup": op8_near_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_html_text": op10_html_text,
        "op11_merkle": op11_merkle,
        "op12_packing": op12_packing,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op5_warc_revisits": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_merkle": OP11_SQL}
