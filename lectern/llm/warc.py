"""Not-modified revisits of web archives: as-of joins by canonical URL.

A revisit record of the server-not-modified profile stands for a 304 answer: no body, some headers. It's resolved to
the latest full response (status 200) of the same canonical URL with a strictly earlier date, if every
validator that the revisit carries (ETag by weak comparison, Last-Modified) equals that response's. The
resolved record has the response's payload and its headers, updated by those headers of the
revisit that a 304 answer may change.

The as-of join runs in two levels: per URL and slice of time the last response, a running last over the slices
that have records, and a window inside each slice. A URL that holds most records is spread over its slices.

Outcomes: resolved; no_earlier (no full response before it); no_validator (the revisit carries none);
mismatch. Only resolved revisits have refers_to, payload and merged headers.

Defined cases: records with a null url or date never match (no_earlier for revisits); null headers are empty; of responses
with one date the one with the largest id counts; rows that repeat an id are resolved one by one; header
names count without case, and of names that differ in case alone the first in order of code points counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.worker import lean
from lectern.session import materialise, ship

#: Headers that a 304 answer may change in a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Microseconds of a slice.
SLICE = 3_600_000_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slash and .html, query sorted and without utm_ and ref; scheme, user and fragment don't count."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", ""), r"\.html$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)="))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def resolve_revisits(records: DataFrame, payload: bool = False) -> DataFrame:
    """Per revisit of `records`: record_id, url_key, outcome, refers_to, digest, length, headers, and with `payload` the body.

    `records`: record_id, type (response or revisit), url, micros (date, microseconds), status, headers (map of
    strings), digest, length, and with `payload` also body.
    """
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    named = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value"))))
    first = lambda es: F.filter(es, lambda e, i: (i == 0) | (F.get(es, i - 1)["name"] != e["name"]))
    lower = F.map_from_entries(F.transform(F.element_at(F.transform(F.array(named), first), 1), lambda e: F.struct(e["name"], e["value"])))
    r = records.select("record_id", "type", canonical_url(F.col("url")).alias("url_key"), F.col("micros").cast("long").alias("micros"), "status", lower.alias("h"), "digest", "length")
    r = r.withColumn("etag", _weak(_header(F.col("h"), "etag"))).withColumn("modified", F.trim(_header(F.col("h"), "last-modified")))
    r = r.withColumn("slice", F.floor(F.col("micros") / SLICE))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    r = r.withColumn("held", F.when(full, F.struct("micros", "record_id", "etag", "modified", "digest", "length", F.to_json("h").alias("headers"))))
    # records that match nothing stay out of the windows: there might be many of them
    r, lost = r.filter("url_key IS NOT NULL AND micros IS NOT NULL"), r.filter("type = 'revisit' AND (url_key IS NULL OR micros IS NULL)")
    slices = r.groupBy("url_key", "slice").agg(F.max("held").alias("last"))
    before = W.partitionBy("url_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.max("last").over(before).alias("carried"))
    inside = W.partitionBy("url_key", "slice").orderBy("micros").rangeBetween(W.unboundedPreceding, -1)
    seen = r.withColumn("here", F.max("held").over(inside))
    out = seen.filter(F.col("type") == "revisit").join(carried, ["url_key", "slice"], "left").withColumn("to", F.coalesce("here", "carried"))
    out = out.unionByName(lost, allowMissingColumns=True)
    none = F.col("etag").isNull() & F.col("modified").isNull()
    equal = (F.col("etag").isNull() | (F.col("etag") == F.col("to.etag"))) & (F.col("modified").isNull() | (F.col("modified") == F.col("to.modified")))
    outcome = F.when(F.col("to").isNull(), "no_earlier").when(none, "no_validator").when(F.coalesce(equal, F.lit(False)), "resolved").otherwise("mismatch")
    out = out.withColumn("outcome", outcome).withColumn("ok", F.col("outcome") == "resolved")
    new = F.map_filter("h", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.from_json(F.col("to.headers"), "map<string,string>")
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    only = lambda c: F.when(F.col("ok"), c)
    out = out.select("record_id", "url_key", "outcome", only(F.col("to.record_id")).alias("refers_to"), only(F.col("to.digest")).alias("digest"), only(F.col("to.length")).alias("length"), only(merged).alias("headers"))
    if payload:
        bodies = records.filter(full).select(F.col("record_id").alias("refers_to"), "body").dropDuplicates(["refers_to"])
        out = out.join(bodies, "refers_to", "left")
    return out


# ---- files --------------------------------------------------------------------------------------


def parse_warc(raw: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped by record, read one by one; what lies between records and is none is skipped, and one that is cut off ends the file."""
    return _records(io.BufferedReader(_Members(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))


class _Members(io.RawIOBase):
    """What the members of a gzip file hold, piece by piece, up to where it's cut off or goes on as something else."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.one = memoryview(raw), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        out = b""
        while not out:
            if self.one.eof:
                self.at -= len(self.one.unused_data)
                self.one = zlib.decompressobj(31)
            more = self.one.unconsumed_tail or self.raw[self.at : self.at + 65536]
            if not len(more):
                break
            if not self.one.unconsumed_tail:
                self.at += len(more)
            try:
                out = self.one.decompress(more, len(into))
            except zlib.error:
                return 0
        into[: len(out)] = out
        return len(out)


def _records(f) -> Iterator[dict]:
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        own = _lines(f)
        said = own.get("content-length", "0").strip()
        size = int(said) if said.isdigit() else 0
        block = f.read(size)
        if len(block) < size:
            return
        status, headers, body = None, {}, block
        if own.get("content-type", "").replace(" ", "").startswith("application/http") and own.get("warc-type") in ("response", "revisit"):
            b = io.BytesIO(block)
            first = b.readline().split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            headers, body = _lines(b), b.read()
        yield {"record_id": own.get("warc-record-id"), "type": own.get("warc-type"), "url": own.get("warc-target-uri", "").strip("<>") or None, "date": own.get("warc-date"), "status": status, "headers": headers, "digest": own.get("warc-payload-digest"), "length": len(body), "body": body}


def _lines(f: io.BytesIO) -> dict[str, str]:
    """Header lines up to an empty one; the first of a name counts, folded lines go on."""
    out: dict[str, str] = {}
    last = None
    while (line := f.readline()) and line.strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        if last in out:
            last = None
        else:
            out[last] = value.strip()
    return out


_RECORD = "record_id string, type string, url string, date string, status int, headers map<string,string>, digest string, length long, body binary"
#: What stands before a record's first line, and a record's first line up to where that was cut off; files whose names a plan lists one by one.
_BETWEEN, _FIRST, _NAMED = "\r\nWARC/1.", b"WARC/1.", 1000


def _parsed(column: str, whole: bool):
    """Records of whole files, or of chunks of one record."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("length", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for raw in batch.column(column).to_pylist():
                for x in parse_warc(raw) if whole else _records(io.BytesIO(_headed(raw))):
                    rows.append(x | {"headers": list(x["headers"].items())})
                    held += x["length"]
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0

    return lean("warc", run)


def _headed(chunk: bytes) -> bytes:
    return chunk if chunk.startswith(_FIRST) or not chunk[:1].isdigit() else _FIRST + chunk


def _cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with a chunk that ends before its record does."""
    for batch in batches:
        found = set()
        for name, chunk in zip(batch.column("file").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            raw = _headed(chunk)
            if name not in found and _FIRST in raw and next(_records(io.BytesIO(raw)), None) is None:
                found.add(name)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["file"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at `path`, as `resolve_revisits` takes them.

    Spark's text reader cuts files before each record's first line: a large plain file is read by its splits, a gzipped one as a stream, and what a
    task holds at once is a record. Where a chunk ends before the length that its record tells (a payload holds such a line, or
    the file is cut off), the file is parsed whole, a file a task, below 2 GB.
    """
    ship(spark)
    text = spark.read.option("lineSep", _BETWEEN).option("ignoreCorruptFiles", "true").text(path)
    chunks = text.select(F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("file"))
    odd = materialise(chunks.mapInArrow(lean("warc", _cut_off), "file string").distinct(), "odd")
    names = [r.file for r in odd.orderBy("file").limit(_NAMED + 1).collect()]
    if names:
        files = spark.read.format("binaryFile").load(path).select("content", F.col("_metadata.file_path").alias("file"))
        few = len(names) <= _NAMED
        chunks, files = (chunks.filter(~F.col("file").isin(names)), files.filter(F.col("file").isin(names))) if few else (chunks.join(odd, "file", "left_anti"), files.join(odd, "file", "left_semi"))
    out = chunks.select("chunk").mapInArrow(_parsed("chunk", False), _RECORD)
    if names:
        out = out.unionByName(files.select("content").mapInArrow(_parsed("content", True), _RECORD))
    return out.withColumn("micros", F.unix_micros(F.try_to_timestamp("date"))).drop("date")


def captures(pages: DataFrame) -> DataFrame:
    """Each page as two captures: a full response, and a later (for each tenth page an earlier) not-modified answer to it."""
    base = F.lit(1_700_000_000_000_000)
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    at = base + F.col("page_id") * 60_000_000
    later = at + F.when(F.pmod("page_id", F.lit(10)) == 9, F.lit(-30_000_000)).otherwise(F.pmod("page_id", F.lit(7)) * 3_600_000_000 + 90_000_000)
    shared = [F.col("url"), F.col("page_id")]
    response = pages.select(*shared, F.lit("response").alias("type"), at.alias("micros"), F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), tag.alias("digest"), F.length("html").cast("long").alias("length"))
    revisit = pages.select(*shared, F.lit("revisit").alias("type"), later.alias("micros"), F.lit(304).alias("status"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=3600"), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), later.cast("string")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("length"))
    return response.unionByName(revisit).withColumnRenamed("page_id", "record_id")
