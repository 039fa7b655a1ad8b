"""Shards with a manifest as a Spark data source, for batches and for streams of epochs.

    spark.dataSource.register(ManifestSource)
    df.write.format("lectern_shards").option("path", folder).mode("overwrite").save()
    spark.read.format("lectern_shards").option("path", folder).load()          # shard, line, value
    spark.readStream.format("lectern_shards").option("path", folder).load()    # chunks of epochs; `read_chunks` gives their lines

A folder holds `manifest.json` and the shards that it names: files of JSON lines of at most `shard_bytes` (a longer line has one
of its own). For each shard the manifest has path, bytes, samples, and where its chunks of `chunk` lines begin.

Writing: tasks write files of names of their own and report their shards' figures in the commit message; the driver
numbers the shards by task and place and writes the manifest last, in one rename. Files of lost or repeated attempts are in no manifest. Until
then a reader sees what was there before; an aborted job takes its files away again.

Reading: partitions are planned from the manifest alone. Conditions on `shard` leave other shards unopened where Spark pushes
filters to Python sources (spark.sql.python.filterPushdown.enabled).

Files are reached through pyarrow's file systems, so the path may be local or of any store that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader, WriterCommitMessage

NAME, MANIFEST = "lectern_shards", "manifest.json"
#: Bytes of small shards that one partition reads.
PARTITION_BYTES = 64 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return system, inner.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


def load_manifest(path: str) -> dict | None:
    """The manifest of a folder; None where there's none yet."""
    system, inner = _place(path)
    if system.get_file_info(f"{inner}/{MANIFEST}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{inner}/{MANIFEST}") as f:
        return json.loads(f.read())


# ---- batches ------------------------------------------------------------------------------------


@dataclass
class Shards(InputPartition):
    """(number, path, bytes) of the shards that one task reads."""

    shards: list[tuple[int, str, int]]


#: What a pushed condition says of a shard's number.
_TESTS = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class ManifestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("shard",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        manifest = load_manifest(self.path)
        if manifest is None or not manifest["shards"]:
            raise FileNotFoundError(f"no shards in {self.path}")
        wanted = [(k, s["path"], s["bytes"]) for k, s in enumerate(manifest["shards"]) if all(_TESTS[t](k, v) for t, v in self.tests)]
        system, inner = _place(self.path)
        found = {i.path: i.type for i in system.get_file_info([f"{inner}/{p}" for _, p, _ in wanted])}
        if missing := [p for _, p, _ in wanted if found[f"{inner}/{p}"] != fs.FileType.File]:
            raise FileNotFoundError(f"missing shards: {missing[:3]}")
        parts, held = [], 0
        for s in wanted:
            if not parts or held + s[2] > PARTITION_BYTES:
                parts.append(Shards([]))
                held = 0
            parts[-1].shards.append(s)
            held += s[2]
        return parts or [Shards([])]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        system, inner = _place(self.path)
        for k, name, _ in partition.shards:
            with system.open_input_stream(f"{inner}/{name}", buffer_size=1 << 20) as f:
                for first, lines in _batches(f):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(lines), pa.int32()), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["shard", "line", "value"])


def _batches(f, size: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Numbers (from 1) of first lines, and lines, about `size` bytes at a time."""
    rest, number = b"", 1
    while data := f.read(size):
        *whole, rest = (rest + data).split(b"\n")
        if whole:
            yield number, [x.decode("utf-8", "replace") for x in whole]
            number += len(whole)
    if rest:
        yield number, [rest.decode("utf-8", "replace")]


@dataclass
class Written(WriterCommitMessage):
    task: int
    folder: str
    shards: list[dict]


class ManifestWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, shard_bytes: int, chunk: int, notes: dict):
        self.path, self.overwrite, self.shard_bytes, self.chunk, self.notes = path, overwrite, shard_bytes, chunk, notes
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        system, inner = _place(self.path)
        task, attempt = TaskContext.get(), uuid.uuid4().hex[:8]
        folder = f"data-{self.job}"
        system.create_dir(f"{inner}/{folder}", recursive=True)
        out, f = [], None
        try:
            for row in iterator:
                line = row[0].encode() + b"\n"
                if f is None or out[-1]["bytes"] + len(line) > self.shard_bytes:
                    if f is not None:
                        f.close()
                    name = f"{folder}/part-{task.partitionId():05d}-{attempt}-{len(out):05d}.jsonl"
                    f = system.open_output_stream(f"{inner}/{name}")
                    out.append({"path": name, "bytes": 0, "samples": 0, "chunks": []})
                s = out[-1]
                if s["samples"] % self.chunk == 0:
                    s["chunks"].append(s["bytes"])
                f.write(line)
                s["bytes"], s["samples"] = s["bytes"] + len(line), s["samples"] + 1
        finally:
            if f is not None:
                f.close()
        return Written(task.partitionId(), folder, out)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _place(self.path)
        system.create_dir(inner, recursive=True)
        old = None if self.overwrite else load_manifest(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        new = [s for m in done for s in m.shards]
        kept = {s["path"] for s in new}
        folder = f"{inner}/data-{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:  # what attempts that didn't count left behind
            for i in system.get_file_info(fs.FileSelector(folder)):
                if f"data-{self.job}/{i.base_name}" not in kept:
                    system.delete_file(i.path)
        made = self.notes | {"version": 1, "format": {"type": "jsonl", "field": "text"}, "shard_bytes": self.shard_bytes, "chunk": self.chunk, "shards": (old["shards"] if old else []) + new}
        with system.open_output_stream(f"{inner}/.{MANIFEST}-{self.job}") as f:
            f.write(json.dumps(made, ensure_ascii=False).encode())
        system.move(f"{inner}/.{MANIFEST}-{self.job}", f"{inner}/{MANIFEST}")

    def abort(self, messages) -> None:
        system, inner = _place(self.path)
        if system.get_file_info(f"{inner}/data-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/data-{self.job}")


# ---- epochs -------------------------------------------------------------------------------------


def _draw(*on) -> str:
    return md5(":".join(map(str, on)).encode()).hexdigest()


def epoch_order(shards: list[dict], epoch: int, seed: int) -> list[tuple[int, int]]:
    """(shard, chunk) of an epoch: shards by the md5 of `seed + epoch:shard`, their chunks in order."""
    return [(s, c) for s in sorted(range(len(shards)), key=lambda s: (_draw(seed + epoch, s), s)) for c in range(len(shards[s]["chunks"]))]


class EpochStream(SimpleDataSourceStreamReader):
    """Rows name chunks: epoch, place in it, shard, chunk, path, first byte, number of bytes. At most `admit` chunks come at a time; after the last chunk the next epoch begins, up to `epochs` (0: without end).

    The offset is (epoch, place), so what a checkpoint holds tells the rest: a restarted stream goes on where it was. Only names pass through the
    driver; `read_chunks` opens the files in tasks.
    """

    def __init__(self, path: str, seed: int, epochs: int, admit: int):
        self.path, self.seed, self.epochs, self.admit = path, seed, epochs, admit

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": 0, "place": 0}

    def _from(self, start: dict) -> Iterator[tuple[dict, tuple]]:
        """Rows from an offset on, each with the offset after it."""
        shards = load_manifest(self.path)["shards"]
        epoch, place = start["epoch"], start["place"]
        while not self.epochs or epoch < self.epochs:
            order = epoch_order(shards, epoch, self.seed)
            if not order:
                return
            for at in range(place, len(order)):
                s, c = order[at]
                starts = shards[s]["chunks"]
                end = starts[c + 1] if c + 1 < len(starts) else shards[s]["bytes"]
                after = {"epoch": epoch, "place": at + 1} if at + 1 < len(order) else {"epoch": epoch + 1, "place": 0}
                yield after, (epoch, at, s, c, shards[s]["path"], starts[c], end - starts[c])
            epoch, place = epoch + 1, 0

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for end, row in self._from(start):
            rows.append(row)
            if len(rows) == self.admit:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        if start == end:
            return
        for after, row in self._from(start):
            yield row
            if after == end:
                return

    def commit(self, end: dict) -> None:
        """Nothing is kept that could be let go."""


def read_chunks(chunks: DataFrame, path: str, seed: int = 0) -> DataFrame:
    """epoch, place, turn, shard, line (from 1 in the chunk), value: the lines of an epoch stream's chunks, shuffled within each chunk by the md5 of `seed + epoch:shard:chunk:line`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _place(path)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{inner}/{r['path']}") as f:
                    lines = f.read_at(r["bytes"], r["first"]).decode("utf-8", "replace").split("\n")[:-1]
                order = sorted(range(len(lines)), key=lambda i: (_draw(seed + r["epoch"], r["shard"], r["chunk"], i + 1), i))
                n = len(lines)
                cols = [pa.array([r["epoch"]] * n, pa.int32()), pa.array([r["place"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([r["shard"]] * n, pa.int32()), pa.array([i + 1 for i in order], pa.int64()), pa.array([lines[i] for i in order], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["epoch", "place", "turn", "shard", "line", "value"])

    # a simple source hands its rows over as one partition; they name chunks, which all cores read
    dealt = chunks.repartition(chunks.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "epoch int, place long, turn int, shard int, line long, value string")


class ManifestSource(DataSource):
    """Options: path; for writing shard_bytes (256 MB), chunk (lines, 4096) and description; for streams seed, epochs, admit and streaming=true, which gives the stream's schema."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        if self.options.get("streaming", "false").lower() == "true":
            return "epoch int, place long, shard int, chunk int, path string, first long, bytes long"
        return "shard int, line long, value string"

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ManifestWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("one string column of lines is written")
        notes = {"description": self.options.get("description", "")}
        return ManifestWriter(self.options["path"], overwrite, int(self.options.get("shard_bytes", 256 << 20)), int(self.options.get("chunk", 4096)), notes)

    def simpleStreamReader(self, schema) -> EpochStream:  # noqa: N802
        o = self.options
        return EpochStream(o["path"], int(o.get("seed", 0)), int(o.get("epochs", 0)), int(o.get("admit", 64)))
