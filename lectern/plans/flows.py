"""Queries of sources, sinks, streams, scans and screens, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import tokens as K
from lectern.operators import instructions, ordered, smooth
from lectern.operators.keystore import KeyStore
from lectern.plans.catalogue import _KEYED, _LENGTHS, _VOCAB, _keyed, _lengths, _pairs
from lectern.session import materialise, scratch, ship, spread, table
from lectern.sources import manifest_source, readers

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _md5(c):
    return F.md5(c.cast("binary"))


# ---- shards and epochs --------------------------------------------------------------------------

#: Shards that documents are dealt to by their number, and lines of a chunk.
_SHARDS, _CHUNK = 8, 100


def _sharded(spark: SparkSession, d: str) -> str:
    """Documents as shards with a manifest, in order of their numbers within each."""
    ship(spark).dataSource.register(manifest_source.ManifestSource)
    path = scratch(spark, "manifest").removeprefix("file:")
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    dealt = docs.repartitionById(_SHARDS, F.pmod("doc_id", F.lit(_SHARDS)).cast("int")).sortWithinPartitions("doc_id")
    dealt.select("value").write.format(manifest_source.NAME).options(path=path, chunk=_CHUNK, shard_bytes=1 << 40).mode("overwrite").save()
    return path


_PLACED = "s AS (SELECT doc_id, text, doc_id % 8 AS shard, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS line FROM documents)"


@query(f"WITH {_PLACED} SELECT doc_id, shard, line, md5(text) AS text_md5 FROM s WHERE shard > 2")
def manifest_source_scan(spark, d):
    """Shards written by the data source and read by it, but for the first three, which the condition leaves unopened."""
    path = _sharded(spark, d)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(manifest_source.NAME).option("path", path).load().filter("shard > 2")
    return rows.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("shard").cast("long").alias("shard"), "line", _md5(readers.text_of(F.col("value"))).alias("text_md5"))


@query(
    f"WITH {_PLACED}, c AS (SELECT *, (line - 1) // 100 AS chunk, (line - 1) % 100 + 1 AS nth, epoch FROM s, (SELECT range AS epoch FROM range(2))), "
    "o AS (SELECT *, md5((5 + epoch) || ':' || shard) AS drawn FROM c) "
    "SELECT epoch, dense_rank() OVER (PARTITION BY epoch ORDER BY drawn, shard, chunk) - 1 AS place, row_number() OVER (PARTITION BY epoch, shard, chunk ORDER BY md5((5 + epoch) || ':' || shard || ':' || chunk || ':' || nth), nth) - 1 AS turn, doc_id FROM o"
)
def epoch_stream(spark, d):
    """Two epochs as a stream that stops after its first chunks and goes on from its checkpoint, a few chunks at a time."""
    path, out, state = _sharded(spark, d), scratch(spark, "epochs"), scratch(spark, "state")
    stream = spark.readStream.format(manifest_source.NAME).options(path=path, streaming="true", epochs=2, seed=5, admit=80).load()
    write = manifest_source.read_chunks(stream, path, 5).writeStream.format("parquet").option("checkpointLocation", state)
    write.trigger(availableNow=True).start(out).awaitTermination()  # ends after its first chunks
    rest = write.trigger(processingTime="0 seconds").start(out)
    try:
        rest.processAllAvailable()  # batch after batch up to the last epoch's end
    finally:
        rest.stop()
    found = spark.read.schema("epoch int, place long, turn int, shard int, line long, value string").parquet(out)
    return found.select(F.col("epoch").cast("long").alias("epoch"), "place", F.col("turn").cast("long").alias("turn"), F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query(f"WITH {_KEYED} SELECT DISTINCT key FROM q")
def stateful_samples(spark, d):
    """Samples that arrive three times as a stream, suppressed by the keys in its state."""
    from lectern.streaming.keyed import append_first

    source, out, state = (scratch(spark, n) for n in ("in", "out", "state"))
    pairs = _pairs(spark, d).select(F.col("prompt").alias("instruction"), F.col("answer").alias("output"))
    for _ in range(3):
        pairs.write.mode("append").parquet(source)
        append_first(spark.readStream.schema(pairs.schema).parquet(source), out, state).awaitTermination()
    return spark.read.parquet(out).select("key")


@query(f"WITH {_KEYED} SELECT ord, key FROM q WHERE key NOT IN (SELECT key FROM q WHERE ord % 3 = 0)")
def existing_screened(spark, d):
    """Samples whose key isn't in a store, which is looked at by its filters first."""
    q = materialise(_keyed(spark, d).select("ord", "key"), "keyed")
    store = KeyStore(spark, scratch(spark, "store"), buckets=16)
    store.append(q.filter("ord % 3 = 0").dropDuplicates(["key"]))
    return store.new(q)


# ---- scans, blocks, mixing, vocabularies --------------------------------------------------------


@query(
    "SELECT event_id, least(min(value) OVER w, value) AS best, coalesce(value < min(value) OVER w, true) AS improved, max(value) OVER w AS most, last_value(event_type IGNORE NULLS) OVER w AS kind, coalesce(round(sum(value) OVER w, 4), 0) AS total, arg_min(event_id, value) OVER w AS at FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def running_log(spark, d):
    """Merges of a whole log up to each step, in two levels."""
    log = table(spark, d, "events").select("event_id", "value", "event_type")
    best = instructions.best_so_far(log, "event_id", "value")
    of = F.struct("value", F.col("event_id").alias("of"))
    out = ordered.running(best, {"most": ("max", "value"), "kind": ("last", "event_type"), "total": ("sum", "value"), "at": ("argmin", of)}, "event_id")
    return out.select("event_id", "best", "improved", "most", "kind", F.round("total", 4).alias("total"), "at")


@query(f"WITH {_LENGTHS}, m AS (SELECT g // 384 - s AS block_id, g, x FROM w, range(2) r(s)) SELECT block_id, md5(string_agg(x, ',' ORDER BY g)) AS block_md5 FROM m WHERE block_id BETWEEN 40 AND 239 AND g >= block_id * 384 AND g < block_id * 384 + 512 GROUP BY block_id HAVING count(*) = 512")
def block_range(spark, d):
    """Blocks 40 to 239 of all strided ones, looked up by a map that holds no tokens."""
    rows = _lengths(spark, d)
    made = ordered.block_map(rows, "doc_id", F.size("ids"), 512, 384)
    blocks = made.read(rows, ["ids"], first=40, last=240)
    return blocks.select("block_id", _md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("block_md5"))


_PI = smooth.whole_weights([math.pi, 1.0])


@query(
    f"WITH RECURSIVE p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS s FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY s) AS n FROM p), "
    f"st AS (SELECT -1 AS step, 0::HUGEINT AS a, 0::HUGEINT AS b, -1 AS s, 0 AS na, 0 AS nb UNION ALL SELECT step + 1, a + {_PI[0]} - CASE WHEN a + {_PI[0]} >= b + {_PI[1]} THEN {sum(_PI)} ELSE 0 END, b + {_PI[1]} - CASE WHEN a + {_PI[0]} >= b + {_PI[1]} THEN 0 ELSE {sum(_PI)} END, "
    f"CASE WHEN a + {_PI[0]} >= b + {_PI[1]} THEN 0 ELSE 1 END, na + CASE WHEN s = 0 THEN 1 ELSE 0 END, nb + CASE WHEN s = 1 THEN 1 ELSE 0 END FROM st WHERE step + 1 < (SELECT count(*) FROM documents)) "
    "SELECT step, s, doc_id FROM st JOIN r USING (s) WHERE (CASE WHEN s = 0 THEN na ELSE nb END) % n = k"
)
def smooth_mix_any(spark, d):
    """A mix with weights pi and 1, whose schedule never repeats."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).alias("s"))
    return ordered.mix_streams(docs, "s", "doc_id", [math.pi, 1.0], docs.count()).select("step", "s", "doc_id")


@query(f"WITH {_VOCAB} SELECT token, token_id FROM voc")
def vocab_by_summaries(spark, d):
    """The vocabulary from bounded summaries and an exact count of what they leave."""
    return materialise(K.train_vocabulary_by_summaries(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id", 1000), "vocabulary")


#: Lines that parsers read differently, made of documents: no number, text after, a field twice, a leading zero, deep nesting, a constant, a blank text, an array.
_TRICKY = "CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN to_json({'text': text}) || ' x' WHEN 2 THEN text WHEN 3 THEN '{\"n\":0' || doc_id || ',\"text\":' || to_json(text) || '}' WHEN 4 THEN text WHEN 5 THEN '-' || doc_id || 'x' WHEN 6 THEN ' ' ELSE '' END"


@query(f"SELECT doc_id, md5({_TRICKY}) AS text_md5 FROM documents WHERE {_TRICKY} <> ''")
def tolerant_lines(spark, d):
    """Texts of such lines as Python's parser tells them."""
    t, k, i = F.col("text"), F.pmod("doc_id", F.lit(8)), F.col("doc_id").cast("string")
    said = F.regexp_extract(F.to_json(F.struct(t.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    line = F.when(k == 0, F.concat(F.lit('{"n":NaN,"text":'), said, F.lit("}"))).when(k == 1, F.concat(F.lit('{"text":'), said, F.lit("} x"))).when(k == 2, F.concat(F.lit('{"text":"first","text":'), said, F.lit("}")))
    line = line.when(k == 3, F.concat(F.lit('{"n":0'), i, F.lit(',"text":'), said, F.lit("}"))).when(k == 4, F.concat(F.lit('{"d":' + "[" * 40 + "]" * 40 + ',"text":'), said, F.lit("}")))
    line = line.when(k == 5, F.concat(F.lit(" -"), i, F.lit("x\t"))).when(k == 6, F.lit('{"text":" "}')).otherwise(F.concat(F.lit("["), said, F.lit("]")))
    rows = spread(table(spark, d, "documents")).select("doc_id", readers.text_of(line).alias("t")).filter("t != ''")
    return rows.select("doc_id", _md5(F.col("t")).alias("text_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
