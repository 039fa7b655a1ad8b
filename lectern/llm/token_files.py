"""Token ids in seekable zstandard files.

Layout of a file: for each document, in order, one independent zstandard frame of its ids as
little-endian unsigned 32-bit integers; one frame with the index (for each document: 8 bytes of id, 1 byte
that is 1 where the id is null, 8 bytes of token count, column after column); last a skippable frame with the seek
table of the public seekable format: for each frame compressed size, content size and the low 32 bits of the
content's xxh64, then the number of frames, a descriptor byte and the magic number 0x8F92EAB1. A
reader takes the table from the file's end, the index, and then only the frames of the documents asked for.

Files are written by Spark's own text writer, one row a file: the writers of PySpark that reach any file system that
Spark knows and commit tasks, so that a lost one leaves nothing half-written, are those of its formats, and text is
the one that adds no bytes but a separator of choice. It neither checks nor changes the bytes of a string. That writer ends each row with a separator: here the
last three bytes of the magic number, EA 92 8F, which are U+A48F in UTF-8.

Documents lie in ascending order of id (nulls first; ties by the text's hash), within files and over
files in order of their names. Defined cases: null text is empty and has the end id alone; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.encode import WordEncoder, lists_of
from lectern.llm.shingles import chunks
from lectern.llm.worker import lean, once
from lectern.session import materialise, ship

#: Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_SEPARATOR = b"\xea\x92\x8f".decode()
#: Compressed bytes after which a file is closed, and bytes of texts that are encoded together (a longer text alone).
FILE_BYTES, TOGETHER = 8 << 20, 4 << 20


def pack(ids: list[bytes], doc_ids: list[int | None], level: int = 3) -> bytes:
    """A whole file."""
    c = zstandard.ZstdCompressor(level=level, write_checksum=False)
    index = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], "u1").tobytes() + np.array([len(x) // 4 for x in ids], "<i8").tobytes()
    frames, table = [], []
    for content in [*ids, index]:
        frames.append(c.compress(content))
        table.append(struct.pack("<III", len(frames[-1]), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
    tail = b"".join(table) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(tail)) + tail


class TokenFile:
    """Reads documents of one file through a seekable binary file object."""

    def __init__(self, f: BinaryIO):
        self.f = f
        size = f.seek(0, io.SEEK_END)
        f.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        f.seek(size - 9 - 12 * count - 8)
        if struct.unpack("<II", f.read(8)) != (SKIPPABLE, 12 * count + 9):
            raise ValueError("the seek table doesn't fit its frame")
        self.table = np.frombuffer(f.read(12 * count), "<u4").reshape(count, 3)
        self.starts = np.r_[0, np.cumsum(self.table[:, 0].astype(np.int64))]
        index, n = self.frame(count - 1), count - 1
        ids, null = np.frombuffer(index[: 8 * n], "<i8"), np.frombuffer(index[8 * n : 9 * n], "u1")
        self.doc_ids: list[int | None] = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(index[9 * n :], "<i8")

    def frame(self, k: int) -> bytes:
        self.f.seek(int(self.starts[k]))
        _, size, check = map(int, self.table[k])
        content = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.starts[k + 1] - self.starts[k])), max_output_size=size) if size else b""
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return np.frombuffer(self.frame(k), "<u4")


def _packed(spec, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("token_files", crc32(spec.value.encode())), lambda: WordEncoder(spec.value))
        end = np.array([end_id], "<u4").tobytes()
        ids, docs, held = [], [], 0
        for batch in batches:
            texts, names = batch.column("text"), batch.column("id").to_pylist()
            for part in chunks(texts.cast("binary").to_pylist(), TOGETHER):
                for i, x in zip(part, lists_of(*encoder.encode_all(texts.slice(part.start, len(part)))), strict=True):
                    ids.append(x + end)
                    docs.append(names[i])
                    held += len(ids[-1])
                    if held > 2 * file_bytes:  # ids shrink to about half
                        yield pa.RecordBatch.from_arrays([pa.array([pack(ids, docs)[:-3]], pa.binary())], names=["content"])
                        ids, docs, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack(ids, docs)[:-3]], pa.binary())], names=["content"])

    return lean("token_files", run)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode whole texts, append `end_id` to each, and write the files below `path` in ascending order of id."""
    spark = ship(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one tokenizer file: a few MB whatever the input
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = plain.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = plain.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    files = dealt.select("id", "text").mapInArrow(_packed(spec, end_id, file_bytes), "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", _SEPARATOR).option("compression", "none").text(path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            f = TokenFile(io.BytesIO(content))
            n, crcs = [], []
            for k in range(len(f.doc_ids)):
                x = f.frame(k)
                n.append(len(x) // 4)
                crcs.append(crc32(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(n)), pa.array(range(len(n)), pa.int32()), pa.array(f.doc_ids, pa.int64()), pa.array(np.cumsum([0, *n])[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())],
                names=["file", "frame", "id", "before", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id_col, start, n_tokens, ids_crc32, file, frame."""
    ship(spark)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("path", "content").mapInArrow(lean("token_files", _unpacked), "file string, frame int, id long, before long, n_tokens long, ids_crc32 long")
    at = F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)", 1).cast("long"), F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)", 2).cast("long")
    # files are read once: their frames' figures are written, and the totals come from there
    rows = materialise(rows.withColumns({"part": at[0], "nth": at[1], "file": F.element_at(F.split("file", "/"), -1)}), "frames")
    # one row a file from here on: at most one for each FILE_BYTES and partition
    totals = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("part", "nth", (F.sum("total").over(W.orderBy("part", "nth")) - F.col("total")).alias("file_start"))
    out = rows.join(starts, ["part", "nth"])
    return out.select(F.col("id").alias(id_col), (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "frame")
