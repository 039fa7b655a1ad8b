"""A store of samples by key that new samples are screened against without reading it.

The store is a folder of Parquet files by bucket (of the key's hash), and beside it a Bloom filter of each bucket as rows of 64-bit words. All of it is
made of column expressions: a key sets PROBES bits, bits of a word meet by `bit_or`, and appended words meet those that are there when they're read.

New keys are first looked up in the filters (a few bytes a stored key). Keys that lack a bit are surely new. The rest are joined with the store's keys
exactly, in the buckets that they fall in and no others: buckets that can't hold any of them aren't read. A filter never lacks a stored key, so nothing
is told apart wrongly; a false hit only costs a look.

Null keys are a key. Rows of one key within a batch are for the caller to merge.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialise

#: Bits of a filter, and how many of them a key sets: with 100,000 keys a bucket one new key in 3,000 looks like a stored one.
BITS, PROBES = 1 << 21, 7
#: Buckets that a single plan names one by one.
NAMED = 1000


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("v"), key.cast("string")), F.lit("-")))


class KeyStore:
    """Samples at `path` in `buckets` buckets; as many as keep a bucket at about 100,000 keys."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(_hash(F.col(self.key), 1), F.lit(self.buckets)).cast("int"))

    def _probes(self, df: DataFrame) -> DataFrame:
        """Rows (__bucket, ..., word, mask): the bits that each key sets, by word."""
        # two hashes make all probes
        a, b = F.pmod(_hash(F.col(self.key), 2), F.lit(BITS)), F.pmod(_hash(F.col(self.key), 3), F.lit(BITS - 1)) + 1
        at = F.explode(F.array(*[F.pmod(a + k * b, F.lit(BITS)) for k in range(PROBES)])).alias("__at")
        met = df.select("*", at)
        return met.withColumn("word", F.floor(F.col("__at") / 64).cast("int")).withColumn("mask", F.expr("shiftleft(1L, cast(__at % 64 AS int))")).drop("__at")

    def append(self, rows: DataFrame) -> None:
        """Add samples; the filters first, so that no stored key is ever without its bits."""
        dealt = materialise(self._bucketed(rows), "samples")
        words = self._probes(dealt.select("__bucket", self.key)).groupBy("__bucket", "word").agg(F.bit_or("mask").alias("mask"))
        words.repartition("__bucket").sortWithinPartitions("__bucket", "word").write.mode("append").partitionBy("__bucket").parquet(f"{self.path}/filters")
        dealt.repartition("__bucket").write.mode("append").partitionBy("__bucket").parquet(f"{self.path}/samples")

    def _there(self, what: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/_SUCCESS")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def samples(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/samples") if self._there("samples") else None

    def maybe(self, rows: DataFrame) -> DataFrame:
        """`key`, `__bucket`: keys of `rows`, once each, that the filters don't rule out."""
        keys = self._bucketed(rows.select(self.key).distinct())
        if not self._there("filters"):
            return keys.limit(0)
        stored = self.spark.read.parquet(f"{self.path}/filters").groupBy("__bucket", "word").agg(F.bit_or("mask").alias("stored"))
        met = self._probes(keys).join(stored, ["__bucket", "word"])
        hits = met.groupBy("__bucket", self.key).agg(F.count_if(F.col("mask").bitwiseAND(F.col("stored")) == F.col("mask")).alias("n"))
        return hits.filter(F.col("n") == PROBES).select(self.key, "__bucket")

    def new(self, rows: DataFrame) -> DataFrame:
        """The rows whose key isn't stored."""
        maybe = materialise(self.maybe(rows), "maybe")
        buckets = [r[0] for r in maybe.select("__bucket").distinct().orderBy("__bucket").limit(NAMED + 1).collect()]
        stored = self.samples()
        if not buckets or stored is None:
            return rows
        if len(buckets) <= NAMED:  # their folders are the only ones that are read
            stored = stored.filter(F.col("__bucket").isin(buckets))
        same = maybe[self.key].eqNullSafe(stored[self.key]) & (maybe["__bucket"] == stored["__bucket"])
        known = materialise(maybe.join(stored, same, "left_semi").select(F.col(self.key).alias("__known")), "known")
        return rows.join(known, rows[self.key].eqNullSafe(known["__known"]), "left_anti")


def add_new(store: KeyStore, rows: DataFrame, order: str | None = None) -> int:
    """Append the rows whose key isn't stored, one for each key (the first by `order`, else any), and tell how many."""
    fresh = store.new(rows)
    others = [c for c in rows.columns if c != store.key]
    pick = F.min_by(F.struct(*others), order) if order else F.first(F.struct(*others))
    one = materialise(fresh.groupBy(store.key).agg(pick.alias("__row")).select(store.key, *[F.col("__row")[c].alias(c) for c in others]), "fresh")
    n = one.count()
    if n:
        store.append(one)
    return n


