"""Best-fit decreasing packing of documents into sequences of bounded length.

Documents become ids; longer ones than a sequence are cut into whole sequences and one shorter piece before them.
Best fit decreasing takes pieces from the longest to the shortest and puts each into the tightest open sequence that still
holds it. What it does depends on the number of pieces of each length alone, and lengths end at the sequence's:
so the plan is made from one count a length, however many documents there are. A segment tree over remaining
capacities (a leaf for each capacity, with the number of open sequences that have it) finds the tightest one in
logarithmic time; all sequences of one capacity are alike, so a run of equal pieces that meets a run of equal
sequences is placed at once. The result is that of placing all pieces of the whole input one by one, not that of packing
parts of it.

The plan is a list of such runs: (length, first piece, pieces, first sequence, pieces a sequence, offset). Its
size is bounded by the square of the sequence's length, not by the input. Each piece is numbered among those of its length (by task,
then within it, in two levels), and the number finds its run.

Defined cases: null text is empty and has the end id alone; a null id stays null; rows of one id are documents of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.encode import ByteEncoder
from lectern.llm.shingles import chunks
from lectern.llm.worker import lean, once
from lectern.session import materialise, ship

#: Bytes of texts that are encoded together (a longer text alone).
TOGETHER = 4 << 20


# ---- the plan -----------------------------------------------------------------------------------


class Capacities:
    """A segment tree over 0 .. most: how many open sequences have each remaining capacity."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        k = self.width + capacity
        while k:
            self.counts[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that an open sequence has."""
        k = self.width + need
        if self.counts[k]:
            return need
        while k > 1:  # up to where something lies to the right, then down to its leftmost leaf
            if not k & 1 and self.counts[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.counts[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def best_fit(counts: dict[int, int], block: int) -> np.ndarray:
    """Runs of best fit decreasing, a row each: length, first piece, pieces, first sequence, pieces a sequence, offset."""
    tree, open_, runs, made = Capacities(block), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (block // length))
                put(block, made, n)
                made, room = made + n, block
            first, n = open_[room].pop()
            tree.add(room, -n)
            # once a piece is in, its sequence is the tightest one as long as another fits
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, done, full * each, first, each, block - room))
                put(room - each * length, first, full)
                done, left, first, n = done + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                runs.append((length, done, left, first, each, block - room))
                put(room - left * length, first, 1)
                done, left, first, n = done + left, 0, first + 1, n - 1
            put(room, first, n)
    return np.array(runs, np.int64).reshape(-1, 6)


# ---- pieces and their places --------------------------------------------------------------------


def _cut(spec, end_id: int, block: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("packing", crc32(spec.value.encode())), lambda: ByteEncoder(spec.value))
        seen = np.zeros(block + 1, np.int64)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, names = batch.column("text"), batch.column("id").to_pylist()
            for part in chunks(texts.cast("binary").to_pylist(), TOGETHER):
                flat, offsets = encoder.encode_all(texts.slice(part.start, len(part)))
                raw = memoryview(flat.astype("<u4", copy=False).tobytes())
                rows = []
                for i, a, b in zip(part, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n = b - a + 1
                    first = n % block or block
                    for k, (x, y) in enumerate(zip([0, *range(first, n, block)], range(first, n + 1, block), strict=True)):
                        ids = raw[4 * (a + x) : 4 * (a + min(y, n - 1))]
                        check = crc32(ids) if y < n else crc32(end, crc32(ids))
                        rows.append((names[i], k, x, y - x, check, seen[y - x], bytes(ids) + (end if y == n else b"") if with_ids else None))
                        seen[y - x] += 1
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows), task, np.int32))], names=["id", "piece", "start", "length", "ids_crc32", "nth", "ids", "task"])

    return lean("packing", run)


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        lengths, starts = runs[:, 0], runs[:, 1]
        low = {int(n): (int(a), int(b)) for n, a, b in zip(*(lambda u: (u[0], u[1], u[1] + u[2]))(np.unique(lengths, return_index=True, return_counts=True)), strict=True)}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                a, b = low[int(n)]
                mine = length == n
                at[mine] = a + np.searchsorted(starts[a:b], rank[mine], "right") - 1
            _, first, _, sequence, each, offset = runs[at].T
            j = rank - first
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence + j // each), pa.array(offset + j % each * length)], names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_file: str, block: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, and the ids (little-endian unsigned 32-bit) where asked for."""
    spark = ship(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one tokenizer file: a few MB whatever the input
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, nth long, ids binary, task int"
    pieces = materialise(plain.mapInArrow(_cut(spec, end_id, block, with_ids), schema), "pieces")
    counts = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    plan = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, block)  # at most `block` rows
    base = counts.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    named = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(base, ["length", "task"]).select(*named, (F.col("base") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(plan)), f"id long, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if with_ids else ''}sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, from `pack` with ids: a sequence gathers its own pieces, `block` ids at most."""
    met = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids")))["ids"].alias("parts"))
    return met.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x)).alias("ids"))
