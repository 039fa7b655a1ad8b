"""Suppression of repeated samples by keys in the state of a stream.

Each key has an entry in the state store, which lives beside the checkpoint and is dealt by key: a batch reads and writes the entries of its own
keys alone, however many samples were appended before. With `keep`, entries expire as the watermark of the samples' own time
passes them by that long: what is remembered stays bounded. Defined cases: of equal keys in a batch one stays; a repeat
within `keep` of the first one is dropped; a later repeat counts as new; a sample that comes later than the watermark is dropped, as
it can't be told whether its key was there. Without `keep` no key is ever forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import sample_key


def first_of_keys(stream: DataFrame, key: str, time: str | None = None, keep: str | None = None) -> DataFrame:
    """The stream with one row of each key, or of each key within `keep` (such as `1 day`) of the `time` column."""
    if keep is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def append_first(stream: DataFrame, path: str, checkpoint: str, time: str | None = None, keep: str | None = None, once: bool = True) -> StreamingQuery:
    """Append a stream's samples (instruction, output, ...) to Parquet at `path`, each key once. What a batch writes is committed with its offsets, so a batch that runs again adds nothing twice."""
    keyed = stream.withColumn("key", sample_key(F.col("instruction"), F.col("output")))
    writer = first_of_keys(keyed, "key", time, keep).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
