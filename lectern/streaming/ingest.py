"""Resumable ingestion: new samples append, those that are there already don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import sample_key
from lectern.operators.keystore import KeyStore, add_new


def append_new(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append samples (instruction, output, ...) of a stream to Parquet at `path` unless their key is there; a batch that runs again appends nothing new."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("key", sample_key(F.col("instruction"), F.col("output"))).dropDuplicates(["key"])
        try:
            there = spark.read.parquet(path).select("key")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            there = spark.createDataFrame([], "key string")
        keyed.join(there, "key", "left_anti").write.mode("append").parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_to_store(stream: DataFrame, store: KeyStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append samples (instruction, output, ...) of a stream to a key store unless their key is there. A batch looks at the filters and at the buckets that may hold one of its keys, not at the whole store; one that runs again finds its keys stored and appends nothing."""

    def write(batch: DataFrame, _: int) -> None:
        mine = KeyStore(batch.sparkSession, store.path, store.key, store.buckets)
        add_new(mine, batch.withColumn(store.key, sample_key(F.col("instruction"), F.col("output"))))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
