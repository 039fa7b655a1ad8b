"""Mixing sources to target weights: token blocks, slots, permutations.

A source's words, document after document, are cut into blocks of BLOCK words (the last one
may be shorter). The mix is a sequence of slots of one block each, dealt over output shards. How many slots each
source fills follows from its target: whole passes over its blocks, and a partial pass whose last
slot is cut so that the source gives its target of words, rounded. Shards draw their source counts as
multinomials conditioned on these totals (the multivariate hypergeometric law: what independent multinomial
draws of equal odds follow once their totals are known), so targets hold at every size and not only on
average. The draws split totals over a binary tree of shards, seeded by node, so any task computes
the counts of its shards alone. A source's k-th slot takes pass k // blocks and, in that pass,
the block that a keyed permutation of the source gives for k % blocks. Blocks join slots by (source, block).

A source's target is at most `most` times its size and each pass uses a block once, so no
document gives more than `most` times its words.

Words' places come from two levels of sums (documents of a hash bucket, buckets of a source), so a source that
holds most rows is spread over many tasks. Sources themselves are few: at most MAX_SOURCES, which is
checked, and only then are their totals known to the driver.

Defined cases: null text is empty (size 0); a null source is a source, last in order; documents without words
give none; rows that repeat an id are separate documents; with no words at all targets are 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shingles import mix
from lectern.llm.worker import lean
from lectern.session import materialise, ship

#: Words of a block, slots of an output shard, hash buckets of a source, and sources at most.
BLOCK, SHARD, BUCKETS, MAX_SOURCES = 256, 4096, 512, 100_000
#: Java's \s in ASCII mode plus \x0B, and nothing else, ends a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """src, source_size, target for rows src, source_size, a row each source (null last, others by code point).

    Water filling: a source is capped where `most` * size / weight is below the level at which the
    others share the rest by weight. With caps in ascending order of that ratio, the level after the first
    i caps is (total - their sum) / (weights of the rest), and a source is capped if the level before
    it reaches its ratio. After the first that isn't capped this level only falls: the highest one holds.
    """
    order = W.orderBy(F.col("src").isNull(), F.col("src").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    x = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    every = W.partitionBy()
    before = W.orderBy("ratio", F.col("src").isNull(), F.col("src").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("w").over(every))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    x = x.withColumn("capped", F.col("level") >= F.col("ratio"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return x.select("src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * free).alias("target"))


def _network(n: int, seed: tuple[int, ...]) -> tuple[np.uint64, np.uint64, np.uint64]:
    """Bits of a half, their mask, and the key of the network that permutes 0 .. n-1."""
    half, salt = max(1, (max(1, int(n) - 1).bit_length() + 1) // 2), 0
    for s in seed:
        salt = int(mix(np.array([salt ^ (s & 0xFFFFFFFFFFFFFFFF)], np.uint64), 5)[0])
    return np.uint64(half), np.uint64((1 << half) - 1), np.uint64(salt)


def permuted(k: np.ndarray, n: int, *seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 at `k` (or, `back`, where it gives `k`): a balanced Feistel network that walks its cycle until below n."""
    half, low, salt = _network(n, seed)
    out = np.asarray(k, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> half, x & low
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                a, b = b ^ (mix(a ^ salt, r) & low), a
            else:
                a, b = b, a ^ (mix(b ^ salt, r) & low)
        x = a << half | b
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def quotas(size: int, target: float, block: int, seed: int, source: int, most: int) -> tuple[int, int, int]:
    """Blocks of a source, slots that it fills, and words that its last slot is short of its block."""
    blocks, words = -(-size // block), min(int(round(target)), most * size)
    if not words:
        return blocks, 0, 0
    passes, rest = divmod(words, size)
    if not rest:
        return blocks, passes * blocks, 0
    # the pass in which rest words are taken: the short block lies at one known place
    short = block * blocks - size
    place = int(permuted(np.array([blocks - 1]), blocks, seed, source, passes, back=True)[0])
    k = -(-rest // block)
    given = k * block
    if place < k:
        k = -(-(rest + short) // block)
        given = k * block - short
        if place >= k:
            k = place + 1
            given = k * block - short
    return blocks, passes * blocks + k, given - rest


def shard_counts(totals: np.ndarray, shards: int, shard: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For one shard: each source's slots in it, and in the shards before it."""
    lo, hi, here, before = 0, shards, totals.astype(np.int64), np.zeros(len(totals), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(here, min((mid - lo) * per_shard, int(here.sum())), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, here = mid, left
        else:
            lo, here, before = mid, here - left, before + left
    return here, before


def hypergeometric(r: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from good + bad are good. numpy's sampler, which takes up to 10**9, and beyond it the ratio of uniforms of Stadlober (1989): the same law."""
    if max(good, bad) < 10**9:
        return int(r.hypergeometric(good, bad, draws))
    few, many, all_ = min(good, bad), max(good, bad), good + bad
    m = min(draws, all_ - draws)
    if not m:
        return 0 if not draws else good
    log_ways = lambda z: math.lgamma(z + 1) + math.lgamma(few - z + 1) + math.lgamma(m - z + 1) + math.lgamma(many - m + z + 1)
    p = few / all_
    middle, spread = m * p + 0.5, math.sqrt((all_ - m) * m * p * (1 - p) / (all_ - 1) + 0.5)
    wide = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = log_ways(int((m + 1) * (few + 1) / (all_ + 2)))
    end = min(min(m, few) + 1, int(middle + 16 * spread))
    while True:
        u, v = 1 - r.random(), r.random()
        w = middle + wide * (v - 0.5) / u
        if 0 <= w < end and 2 * math.log(u) <= top - log_ways(int(w)):
            break
    x = int(w) if good <= bad else m - int(w)
    return x if m == draws else good - x


def _split(totals: np.ndarray, draws: int, r: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw, source after source."""
    out, rest = np.zeros(len(totals), np.int64), int(totals.sum())
    for i, n in enumerate(totals):
        rest -= int(n)
        if not draws:
            break
        if rest and n:
            x = hypergeometric(r, int(n), rest, draws)
        else:
            x = min(int(n), draws)
        out[i] = x
        draws -= x
    return out


class Mix:
    """The layout of documents in blocks, and the slots that use them.

    `pieces`: id, row, src, block, at (first word in its document), off (first word in its block), words.
    `slots`: shard, slot, src_no, src, turn, block, words; together they're the mix.
    """

    def __init__(self, docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: int = 1, block: int = BLOCK, per_shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = ship(docs.sparkSession)
        plain = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))
        self.docs = materialise(plain.withColumn("bucket", F.pmod(F.hash("id", "tie"), F.lit(BUCKETS))).withColumn("row", F.monotonically_increasing_id()), "sizes")
        per_bucket = self.docs.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
        per_source = materialise(per_bucket.groupBy("src").agg(F.sum("words").alias("source_size")), "sources")
        if per_source.count() > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.targets = materialise(targets(per_source, weights, most), "targets")
        known = sorted(self.targets.collect(), key=lambda r: (r.src is None, (r.src or "").encode()))
        sizes = [quotas(r.source_size, r.target, block, seed, i, most) if r.source_size else (0, 0, 0) for i, r in enumerate(known)]
        names = [r.src for r in known]
        lengths = [r.source_size for r in known]
        self.slots = self._slots(spark, names, lengths, sizes, seed, block, per_shard)
        starts = per_bucket.withColumn("bucket_start", F.sum("words").over(W.partitionBy("src").orderBy("bucket")) - F.col("words")).select(F.col("src").alias("s"), F.col("bucket").alias("b"), "bucket_start")
        inside = W.partitionBy("src", "bucket").orderBy("id", "tie", "row").rowsBetween(W.unboundedPreceding, -1)
        placed = self.docs.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, F.col("src").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        placed = placed.withColumn("start", F.col("bucket_start") + F.col("inner")).filter("size > 0")
        first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
        cut = placed.withColumn("block", F.explode(F.sequence(first, last))).withColumn("from", F.greatest("start", F.col("block") * block)).withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
        self.pieces = cut.select("id", "row", "src", "block", (F.col("from") - F.col("start")).alias("at"), (F.col("from") - F.col("block") * block).alias("off"), (F.col("to") - F.col("from")).alias("words"))

    @staticmethod
    def _slots(spark, names, lengths, sizes, seed, block, per_shard) -> DataFrame:
        totals = np.array([s[1] for s in sizes], np.int64)
        shards = max(1, -(-int(totals.sum()) // per_shard)) if len(totals) else 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"]:
                    here, before = shard_counts(totals, shards, int(shard), per_shard, seed)
                    src = np.repeat(np.arange(len(here)), here)
                    k = np.concatenate([np.arange(b, b + n) for b, n in zip(before, here, strict=True)]) if len(here) else np.empty(0, np.int64)
                    if not len(k):
                        continue
                    at, words, turn = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                    for s in np.unique(src):
                        blocks, slots, cut = sizes[s]
                        mine = np.flatnonzero(src == s)
                        turn[mine] = k[mine] // blocks
                        for t in np.unique(turn[mine]):
                            of = mine[turn[mine] == t]
                            at[of] = permuted(k[of] % blocks, blocks, seed, int(s), int(t))
                        words[mine] = np.minimum(block, lengths[s] - at[mine] * block)
                        words[mine[k[mine] == slots - 1]] -= cut
                    where = np.argsort(permuted(np.arange(len(k)), len(k), seed, int(shard), 77))
                    yield pd.DataFrame({"shard": shard, "slot": where, "src_no": src.astype(np.int32), "src": [names[i] for i in src], "turn": turn, "block": at, "words": words})

        return spark.range(shards, numPartitions=max(1, min(shards, 4096))).mapInPandas(lean("mixing", run), "shard long, slot long, src_no int, src string, turn long, block long, words long")

    def taken(self) -> DataFrame:
        """id, row, words: what the mix takes of each document that it takes from, over all its slots."""
        # slots of a block are whole but for at most one that is cut: whole uses and the cut one's words
        used = self.slots.groupBy("src", "block").agg(F.collect_list("words").alias("uses")).select(F.col("src").alias("s"), F.col("block").alias("k"), "uses")
        # the planner takes slots, made from a range of shards, for a few bytes and would broadcast them: they grow with the mix
        met = self.pieces.join(used.hint("merge"), F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
        got = F.aggregate("uses", F.lit(0).cast("long"), lambda acc, w: acc + F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), w - F.col("off"))))
        return met.select("id", "row", got.alias("got")).groupBy("id", "row").agg(F.sum("got").alias("taken"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per row: id_col, size, source_size, target, taken."""
    m = Mix(docs, id_col=id_col, **kw)
    t = m.targets.select(F.col("src").alias("s"), "source_size", "target")
    out = m.docs.join(t, F.col("src").eqNullSafe(F.col("s"))).join(m.taken().select("row", "taken"), "row", "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
