"""Writers: JSON lines, shards with a manifest, rejects, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import json_row


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines: `overwrite`, `append`, `ignore` what exists, or `errorifexists`."""
    rows.write.mode(mode).json(path)


def write_texts(rows: DataFrame, path: str, text: str = "text", mode: str = "overwrite", keep: list[str] = ()) -> None:
    """Texts as compact JSON lines, with the columns to `keep` before them."""
    line = F.to_json(F.struct(*keep, F.col(text).alias("text"))) if keep else json_row(F.col(text))
    rows.select(line.alias("value")).write.mode(mode).text(path)


def write_shards(sharded: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """Texts by shard_id, each shard's rows in order, in folders shard_id=N."""
    rows = sharded.select("shard_id", *order, json_row(F.col(text)).alias("value")).repartition("shard_id").sortWithinPartitions("shard_id", *order)
    rows.select("shard_id", "value").write.mode("overwrite").partitionBy("shard_id").text(path)


def manifest(sharded: DataFrame, stats: dict[str, int], category_bytes: dict[str, int], sources: list[tuple[str, str]], target: int, least: int, limit: int, valid_path: str, description: str = "") -> dict:
    """What describes written shards: one row a shard reaches the driver."""
    found = sharded.groupBy("shard_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("samples")).orderBy("shard_id").collect()
    return {
        "version": 1,
        "description": description,
        "format": {"type": "jsonl", "field": "text"},
        "target_bytes": target,
        "min_required_bytes": least,
        "shard_bytes": limit,
        "shards": [{"path": f"shard_{r.shard_id:04d}.jsonl", "bytes": r.bytes, "samples": r.samples} for r in found],
        "valid_path": valid_path,
        "stats": stats,
        "category_bytes": category_bytes,
        "sources": [{"category": c, "path": p} for c, p in sources],
    }


def write_valid(split: DataFrame, path: str, valid: str = "valid", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """Texts of the rows marked valid as compact JSON lines; the other rows go on."""
    write_texts(split.filter(F.col(valid)), path, text, keep=keep)
    return split.filter(~F.coalesce(F.col(valid), F.lit(False)))


def write_vocabulary(vocabulary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A vocabulary as one JSON object; `load_vocabulary` reads it."""
    from lectern.functions.tokens import vocabulary_map

    vocabulary_map(vocabulary).coalesce(1).write.mode(mode).text(path)


def write_guarded(rows: DataFrame, path: str, sources: list[str] = (), force: bool = False) -> None:
    """Texts of `value` to a path that is none of the sources and holds nothing yet, unless forced."""
    if path.rstrip("/") in {s.rstrip("/") for s in sources}:
        raise ValueError("the output must not be an input")
    rows.select("value").write.mode("overwrite" if force else "errorifexists").text(path)


def split_rejects(checked: DataFrame, reason: str = "reason", good: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with reject_reason."""
    return checked.filter(F.col(reason) == good).drop(reason), checked.filter(F.coalesce(F.col(reason) != good, F.lit(True))).withColumnRenamed(reason, "reject_reason")


def report(profile: dict, samples: list[str], title: str = "Corpus quality") -> str:
    """A Markdown report of a profile's row and sample texts."""
    rows = "\n".join(f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v:,} |" for k, v in profile.items())
    shown = "\n".join(f"- {s[:300]!r}" for s in samples)
    return f"# {title}\n\n| figure | value |\n|---|---|\n{rows}\n\n## Samples\n\n{shown}\n"


def summary_json(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True)


def file_manifest(files: DataFrame, release: str) -> dict:
    """Path, size and digest of files read as binaryFile (which leaves out empty ones), and their totals: one row a file reaches the driver."""
    found = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    return {"release": release, "file_count": len(found), "total_size": sum(r["size"] for r in found), "files": [r.asDict() for r in found]}
