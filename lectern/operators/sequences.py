"""Rows of training text as aligned sequences: ids, labels, depths, states and their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import structure as S
from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators.ordered import chunks, dense_rank_of, shuffled

#: Fixed value: the label that a loss leaves out. The sequences of a row.
IGNORE = -100
SEQUENCES = ("input_ids", "labels", "depth_ids", "state_ids", "depth_targets", "state_targets")
_FIELDS = ("raw", "prompt", "answer", "instruction", "input", "output", "text", "content")


def encode_rows(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key and SEQUENCES of rows as `training_rows` gives them.

    A pair's prompt, with the begin token, is masked in labels and targets; other rows are texts and have no mask. Each sequence is shifted:
    input, depth and state without the last element, labels and targets without the first. Rows of blank text are
    left out. A pair whose parts don't tokenise as its whole does raises. Columns that are missing count as null.
    """
    c = {f: F.col(f) if f in rows.columns else F.lit(None).cast("string") for f in _FIELDS}
    pair = T.prompt_of(c["prompt"], c["answer"], c["instruction"], c["input"], c["output"])
    d = rows.select(F.col(key), F.when(c["raw"].isNull(), pair).alias("pair"), T.training_text(c["raw"], pair, c["text"], c["content"]).alias("whole"))
    d = d.filter(F.col("pair").isNotNull() | (T.strip(F.col("whole")) != ""))
    d = d.select(key, K.tokenise(F.col("whole")).alias("tokens"), F.when(F.col("pair").isNotNull(), F.size(K.tokenise(T.question_part(F.col("pair.prompt"))))).alias("asked"), F.size(K.tokenise(T.answer_part(F.col("pair.answer")))).alias("answered"))
    aligned = F.col("asked").isNull() | (F.col("asked") + F.col("answered") == F.size("tokens"))
    d = d.withColumn("tokens", F.when(aligned, F.col("tokens")).otherwise(F.raise_error(F.lit("a pair's parts don't tokenise as its whole")).cast("array<string>")))
    d = d.withColumn("said", S.annotations("tokens"))
    return _shifted(_with_ids(d, vocabulary, key), key)


def _with_ids(d: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """The rows with their tokens' ids beside them."""
    packed = d.select(F.struct(F.col(key).alias("key"), "asked", "said").alias("row"), "tokens")
    return K.encode(packed, vocabulary, "row").select(F.col("row.key").alias(key), "row.asked", "row.said", "ids")


def _shifted(d: DataFrame, key: str) -> DataFrame:
    n = F.size("ids")
    zero = F.array(F.lit(0))
    depth, state = F.concat(zero, F.col("said.depth"), zero), F.concat(zero, F.col("said.state"), zero)
    head = lambda x: F.slice(x, F.lit(1), n - 1)
    tail = lambda x: F.transform(F.slice(x, F.lit(2), n - 1), lambda v, i: F.when(i < F.coalesce("asked", F.lit(0)), F.lit(IGNORE)).otherwise(v))
    made = (head(F.col("ids")), tail(F.col("ids")), head(depth), head(state), tail(depth), tail(state))
    return d.select(key, *[x.alias(n) for x, n in zip(made, SEQUENCES, strict=True)])


def blocks(encoded: DataFrame, order: str, block: int, stride: int | None = None, n_workers: int = 1) -> DataFrame:
    """worker, block_id and SEQUENCES in blocks: each worker packs the rows whose place in the order is its own modulo `n_workers`."""
    if n_workers > 1:
        return chunks(encoded, order, list(SEQUENCES), block, stride, n_workers=n_workers)
    return chunks(encoded.withColumn("worker", F.lit(0).cast("long")), order, list(SEQUENCES), block, stride, ["worker"])


def dense_blocks(encoded: DataFrame, order: str, block: int) -> DataFrame:
    """block_id and SEQUENCES of every stride-1 window; fewer elements than a block raise."""
    found = chunks(encoded, order, list(SEQUENCES), block, 1)
    total = F.coalesce(F.sum(F.size("input_ids")), F.lit(0))
    if encoded.agg(total).first()[0] < block:
        raise ValueError(f"fewer than {block} elements")
    return found


def manifest_blocks(rows: DataFrame, vocabulary: DataFrame, shard: str, order: str, block: int, epoch: int = 0, seed: int = 0, buffer: int = 4096, n_workers: int = 1) -> DataFrame:
    """worker, block_id and SEQUENCES of one epoch over the rows of a manifest's shards.

    Shards come in hash order of (seed + epoch, shard); their rows, by `order`, are shuffled within buffers of `buffer` rows.
    """
    shards = shuffled(rows.select(shard).distinct(), shard, seed + epoch)
    placed = shards.withColumn("__shard", F.xxhash64(F.lit(seed + epoch), F.col(shard)))
    d = rows.join(placed, shard)  # a row a shard: small ones are broadcast by their size
    # a total order: shards by hash, their rows by place
    d = dense_rank_of(d.withColumn("__key", F.struct("__shard", shard, order)), "__key", "__place")
    d = dense_rank_of(d.withColumn("__mixed", F.struct(F.floor(F.col("__place") / buffer), F.xxhash64(F.lit(seed + epoch), "__place"), F.col("__place"))), "__mixed", "__turn")
    encoded = encode_rows(d.drop("__key", "__mixed", "__place", "__shard"), vocabulary, "__turn")
    return blocks(encoded, "__turn", block, n_workers=n_workers)
