"""Exact duplicates of an incoming batch, screened by binary fuse filters of an immutable snapshot.

The snapshot is a folder of two tables: `groups` (a row for each distinct digest, dealt into
buckets by the digest) and `filters` (for each bucket one static 3-wise binary fuse filter with
16-bit fingerprints over its digests; about 18 bits a digest, one false positive in 65,536).
Neither changes after it's written. Digests of a batch first meet the filter of their bucket. What
it lets through is joined with the exact bucket; what it screens out can't be in the snapshot
and is grouped within the batch alone. Digests only propose: every row of a group is compared
byte by byte with the row that stays, and where a digest has come to stand for different texts, its
rows are grouped by the texts themselves.

Digests are reduced to one row for each distinct value before any exchange, so a group of copies
that holds a third of all rows is one row for the filter and the buckets.

Defined cases: null text is the empty text; a null id sorts below all others; rows that repeat an
id and its text are copies of each other, and one of them stays; an empty table gives no rows; input
columns other than the id and the text are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialise, scratch

#: Digests that one filter covers, on average; a filter of this size takes about 0.5 MB.
DIGESTS_A_FILTER = 200_000
#: Digests of a batch that meet a filter in one task, on average; a bucket with more of them is dealt to several, each with the filter.
DIGESTS_A_TASK = 1_000_000
#: Groups of copies (48 bytes each) that are broadcast at most; with more of them the join shuffles.
BROADCAST_GROUPS = 200_000


# ---- binary fuse filter -------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on all input bits and the seed."""
    x = x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A static set of 64-bit keys: no false negatives, one false positive in 65,536."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        return segment, max(1, -(-int(n * factor) // segment) - 2)

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in neighbouring segments, and the fingerprint, of each key."""
        h = _mix(keys, self.seed)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64) * self.segment
        g, low = _mix(h, 0x9E3779B97F4A7C15), np.uint64(self.segment - 1)
        slots = np.stack([first + k * self.segment + (g >> np.uint64(20 * k) & low).astype(np.int64) for k in range(3)])
        return slots, (h & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        segment, segments = cls._shape(len(keys))
        for seed in range(1, 200):
            out = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint16))
            if out._fill(keys):
                return out
            if seed % 10 == 0:  # crowded by bad luck: a little more room
                segments += max(1, segments // 20)
        raise RuntimeError("no seed gives a filter for these keys")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel keys that own a slot, all of a round at once; then give prints to the rounds in reverse.

        A slot that one round's key owns is used by no other key left in that round, so the
        keys of a round don't touch each other's prints.
        """
        slots, prints = self._slots(keys)
        size, left = len(self.prints), np.arange(len(keys))
        users = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, left)
        rounds, alive = [], np.ones(len(keys), bool)
        ready = np.flatnonzero(users == 1)
        while len(ready):
            who, first = np.unique(owner[ready], return_index=True)
            where = ready[first]
            rounds.append((who, where))
            alive[who] = False
            for row in slots[:, who]:
                np.subtract.at(users, row, 1)
                np.bitwise_xor.at(owner, row, who)
            touched = np.unique(slots[:, who])
            ready = touched[users[touched] == 1]
        if alive.any():
            return False
        for who, where in reversed(rounds):
            self.prints[where] = 0
            a, b, c = slots[:, who]
            self.prints[where] = prints[who] ^ self.prints[a] ^ self.prints[b] ^ self.prints[c]
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(keys.astype(np.uint64))
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == prints


# ---- snapshot -----------------------------------------------------------------------------------


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod(F.hash("digest"), F.lit(buckets)).cast("int"))


def _filter_of(bucket: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(bucket["key"].to_numpy().astype(np.uint64))
    return pd.DataFrame({"bucket": bucket["bucket"].iloc[:1], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})


def _screen(filters: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    if not len(batch):
        return pd.DataFrame({"digest": [], "maybe": []})
    if not len(filters):
        return pd.DataFrame({"digest": batch["digest"], "maybe": False})
    x = filters.iloc[0]
    f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["prints"], np.uint16))
    return pd.DataFrame({"digest": batch["digest"], "maybe": f.holds(batch["key"].to_numpy().astype(np.uint64))})


class Snapshot:
    """An immutable set of digests: exact buckets and their filters below `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        self.groups = spark.read.schema("digest binary, n long, top long, key long, bucket int").parquet(f"{path}/groups")
        self.filters = spark.read.schema("bucket int, seed long, segment long, segments long, prints binary").parquet(f"{path}/filters")

    @classmethod
    def write(cls, groups: DataFrame, path: str, digests_a_filter: int = DIGESTS_A_FILTER) -> Snapshot:
        """`groups`: digest, n, top (the largest id), one row for each distinct digest."""
        buckets = max(16, -(-groups.count() // digests_a_filter))
        _bucketed(groups, buckets).write.parquet(f"{path}/groups")
        made = groups.sparkSession.read.schema("digest binary, n long, top long, key long, bucket int").parquet(f"{path}/groups")
        made.select("bucket", "key").groupBy("bucket").applyInPandas(_filter_of, "bucket int, seed long, segment long, segments long, prints binary").write.parquet(f"{path}/filters")
        return cls(groups.sparkSession, path, buckets)

    def screen(self, groups: DataFrame, digests_a_task: int = DIGESTS_A_TASK) -> DataFrame:
        """digest and whether the snapshot may hold it, for the digests of a batch (a written table). A batch that is large for the snapshot has its buckets dealt by a salt, and each part gets the bucket's filter."""
        salts = max(1, -(-groups.count() // (self.buckets * digests_a_task)))
        batch = _bucketed(groups, self.buckets).select("bucket", F.pmod(F.hash("digest", F.lit(7)), F.lit(salts)).alias("salt"), "digest", "key")
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return filters.groupBy("bucket", "salt").cogroup(batch.groupBy("bucket", "salt")).applyInPandas(_screen, "digest binary, maybe boolean")


# ---- operator -----------------------------------------------------------------------------------


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.sum("n").alias("n"), F.max("id").alias("top"))


def merge_batch(snapshot: Snapshot, batch: DataFrame, digests_a_task: int = DIGESTS_A_TASK) -> DataFrame:
    """digest, n, top over snapshot and batch together; `batch`: digest, n, top, a written table."""
    held = materialise(snapshot.screen(batch, digests_a_task).filter("maybe").select("digest"), "held")
    met = batch.join(held, "digest", "left_semi").join(snapshot.groups.select("digest", F.col("n").alias("n0"), F.col("top").alias("top0")), "digest", "full")
    # full: groups of the snapshot that the batch doesn't meet stay as they are
    met = met.select("digest", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("top", "top0").alias("top"))
    return met.unionByName(batch.join(held, "digest", "left_anti").select("digest", "n", "top"))


def exact_dedup(
    docs: DataFrame,
    in_snapshot: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Per row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    Rows where `in_snapshot` (an expression over the id column) holds make the snapshot, the others
    the incoming batch. Of rows with equal texts, the one with the largest id stays. `digest` may be
    any function of the text: a weak one costs time, not results.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    rows = materialise(plain.select("id", "old", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha")).groupBy("id", "old", "digest", "sha").agg(F.count("*").alias("n")), "digests")
    snapshot = Snapshot.write(_groups(rows.filter("old")), scratch(spark, "snapshot"))
    groups = materialise(merge_batch(snapshot, materialise(_groups(rows.filter("NOT old")), "batch")), "groups")

    # byte checks: each row of a group against the text of the row that stays
    several = groups.filter("n > 1").select("digest", "top")
    few = several.count() <= broadcast_groups
    texts = plain.select("id", "text", digest(F.col("text")).alias("digest"))
    texts = texts.join(F.broadcast(several) if few else several, "digest")
    # written first: then both sides of the join are plain exchanges, and a hot group's texts can be split over tasks
    first = materialise(texts.filter(F.col("id").eqNullSafe(F.col("top"))).groupBy("digest").agg(F.min("text").alias("model")), "models")
    # made distinct after it's written: an aggregate by the same key would keep a hot group's join in one task
    unlike = materialise(texts.join(first, "digest").filter("text != model").select("digest"), "collisions").distinct()

    rows = rows.withColumnRenamed("n", "rows")
    out = rows.join(groups.select("digest", "top", F.col("n").alias("group_size")), "digest")
    if not unlike.isEmpty():
        apart = texts.join(unlike, "digest", "left_semi").groupBy("digest", "text").agg(F.max("id").alias("top"), F.count("*").alias("group_size"))
        apart = apart.select("digest", sha256(F.col("text")).alias("sha"), "top", "group_size")
        mended = rows.join(apart, ["digest", "sha"])
        out = out.join(unlike, "digest", "left_anti").unionByName(mended.select(*out.columns))
    # rows that repeat id and text: one stays, the others are copies
    out = out.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        F.col("id").alias(id_col),
        F.col("top").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("top")) & (F.col("at") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def in_first_half(id_col: str = "doc_id") -> Column:
    """The split of the query and the pipeline: about half of the ids are the earlier snapshot."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
