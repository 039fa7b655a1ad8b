"""From documents to token ids: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the rows are written as Parquet in the shared folder and read again. A stage's decisions
are the rows it returns: rejected and superfluous documents are gone, and the mix's rows are what it
takes of each document in each pass (a document that is taken three times is three rows).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from lectern.llm.registry import tokenizer_path
from lectern.llm.worker import lean
from lectern.session import made, materialise, ship, sweep, table

#: Rows of keys (at most 48 bytes each) that are broadcast at most; beyond it the join shuffles.
BROADCAST_KEYS = 200_000


def _without(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `docs` whose `on` isn't in `keys`, a written table."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject at their language's threshold; unknown scores stay."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, net, score_col="_score")
    return scored.filter(~F.coalesce(toxicity.rejected(net, "_score"), F.lit(False))).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id; of rows that repeat it, one."""
    said = materialise(exact_dedup.exact_dedup(docs, exact_dedup.in_first_half()).select("doc_id", F.col("text_sha256").alias("_sha"), "kept"), "exact")
    counts = said.groupBy("doc_id", "_sha").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    gone = materialise(counts.filter("kept = 0").select("doc_id", "_sha"), "gone")
    repeated = materialise(counts.filter("kept > 0 AND n > 1").select("doc_id", "_sha"), "repeated")
    signed = docs.withColumn("_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    if gone.filter("doc_id IS NULL").isEmpty():
        out = _without(signed, gone, ["doc_id", "_sha"])
    else:  # null ids equal each other here
        on = signed["doc_id"].eqNullSafe(gone["doc_id"]) & (signed["_sha"] == gone["_sha"])
        out = signed.join(gone, on, "left_anti")
    if not repeated.isEmpty():
        again = F.struct(F.col("doc_id"), F.col("_sha")).alias("_key")
        keys = repeated.select(again)
        out = out.withColumn("_key", again)
        out = out.join(keys, "_key", "left_anti").unionByName(out.join(keys, "_key", "left_semi").dropDuplicates(["doc_id", "_sha"])).drop("_key")
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at a similarity of 0.8 (five-word shingles), the one with the smallest id."""
    said = near_dedup.near_dedup(docs, percent=80)
    gone = materialise(said.filter("NOT kept").select("doc_id").distinct(), "near")
    return _without(docs, gone, ["doc_id"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the word ranges taken: a whole text stays as it is; else the spans of neighbouring ranges, a line each."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        out = []
        for text, size, ranges in zip(batch.column("text").to_pylist(), batch.column("_size").to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
            joined: list[list[int]] = []
            for first, n in sorted((r["at"], r["n"]) for r in ranges):
                if joined and joined[-1][1] == first:
                    joined[-1][1] = first + n
                else:
                    joined.append([first, first + n])
            if joined == [[0, size]]:
                out.append(text)
            else:
                at = [m.span() for m in word.finditer(text)]
                out.append("\n".join(text[at[a][0] : at[b - 1][1]] for a, b in joined))
        names = [n for n in batch.schema.names if n not in ("_size", "_ranges")]
        cols = [pa.array(out, pa.string()) if n == "text" else pa.array([len(t) for t in out], batch.schema.field(n).type) if n == "n_chars" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and pass, with the words taken in it. Rows that repeat id and text count as one document."""
    ship(spark)
    m = mixing.Mix(docs)
    used = m.slots.groupBy("src", "block").agg(F.collect_list(F.struct("turn", "words")).alias("uses")).select(F.col("src").alias("s"), F.col("block").alias("k"), "uses")
    met = m.pieces.join(used.hint("merge"), F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).withColumn("use", F.explode("uses"))
    met = met.withColumn("n", F.least(F.col("words"), F.col("use.words") - F.col("off"))).filter("n > 0")
    takes = met.groupBy("row", F.col("use.turn").alias("turn")).agg(F.collect_list(F.struct("at", "n")).alias("_ranges"))
    takes = takes.join(m.docs.select("row", "id", "tie", F.col("size").alias("_size")), "row").dropDuplicates(["id", "tie", "turn"]).select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "_size", "_ranges")
    both = docs.join(takes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text")) == F.col("_tie")))
    return both.select(*docs.columns, "_size", "_ranges").mapInArrow(lean("pipeline", _cut_texts), docs.schema)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids, round_trip, parity of each row."""
    return pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: No SQL: classifier, sketches, permutations and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, first = table(spark, sf_dir, "documents"), len(made)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, made[first:-1])  # all but the stage's own rows
    return STAGES[-1][1](spark, docs, sf_dir)
