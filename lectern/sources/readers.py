"""Readers of JSON lines and of what describes them. Lines are read as text, so one bad line costs one line."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import jsonlines
from lectern.functions.text import SPACE, once, strip

#: Fields that may hold a text, best first.
FIELDS = ("text", "content", "passage", "document")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file, line: lines with their 1-based number in the file, blank ones counted.

    A file's lines are numbered within the file alone, from the sizes of its splits' rows: a file is the unit
    of work only for files that Spark doesn't split.
    """
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("start")) - F.col("n")).select("file", "start", "before")
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("file", "start").orderBy("at")))
    return numbered.join(before, ["file", "start"]).select("value", "file", (F.col("before") + F.col("nth")).alias("line"))


def text_of(value: Column) -> Column:
    """The text of a line: a JSON string, the first field that is a string, prompt and answer, or the line itself, stripped, if it's no JSON to Python; empty if there's none."""

    def said(r: Column) -> Column:
        fields = F.coalesce(*[r[f] for f in FIELDS], F.concat(r["prompt"], F.lit("\n"), r["answer"]), F.lit(""))
        return F.when(r["error"].isNotNull(), strip(value)).when(r["kind"] == "string", r["whole"]).when(r["kind"] == "object", fields).otherwise("")

    return once(jsonlines.read(strip(value)), said)


def corpus(spark: SparkSession, sources: Iterable[tuple[str, str]]) -> DataFrame:
    """category, src_ord, file, line, text of all sources in order: tolerant of bad lines, without empty texts."""
    parts = [lines(spark, path).select(F.lit(c).alias("category"), F.lit(i).alias("src_ord"), "file", "line", text_of(F.col("value")).alias("text")) for i, (c, path) in enumerate(sources)]
    if not parts:
        raise ValueError("no sources")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("text != ''")


def profile_texts(values: DataFrame) -> DataFrame:
    """text of JSON objects (text, or content where it's empty) and strings; other lines are skipped."""
    d = values.select(jsonlines.read(F.col("value")).alias("r"))
    text = F.coalesce(F.when(F.col("r.kind") == "string", F.col("r.whole")), F.when(F.col("r.text") != "", F.col("r.text")), F.col("r.content"))
    return d.select(text.alias("text")).filter("text IS NOT NULL")


def validated(values: DataFrame, *keep: str) -> DataFrame:
    """The rows of `value` with `load_error` (null where it's a JSON object to Python) and `fields`, its strings by name; blank lines go."""
    rows = values.filter(strip(F.col("value")) != "").select(*keep, "value", jsonlines.read(F.col("value")).alias("fields"))
    error = F.coalesce(F.col("fields.error"), F.when(F.col("fields.kind") != "object", "JSON line is not an object"))
    return rows.withColumn("load_error", error)


def fail_fast(values: DataFrame) -> DataFrame:
    """`validated` that raises at the first bad line."""
    rows = validated(values)
    return rows.withColumn("value", F.when(F.col("load_error").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("load_error"))).cast("string"))).drop("load_error")


def skip_bad(values: DataFrame) -> DataFrame:
    """`validated` without bad lines."""
    return validated(values).filter("load_error IS NULL").drop("load_error")


def training_rows(values: DataFrame, *keep: str) -> DataFrame:
    """Rows as a wide union: raw text of lines that are no JSON to Python, what isn't an object as Python writes it, or the string fields of objects."""
    rows = validated(values, *keep)
    names = ("prompt", "answer", "instruction", "input", "output", "text", "content")
    raw = F.when(F.col("fields.error").isNotNull(), F.col("value")).otherwise(F.col("fields.whole"))
    return rows.select(*keep, raw.alias("raw"), *[F.col(f"fields.{n}").alias(n) for n in names])


def count_rows(values: DataFrame) -> DataFrame:
    """n: lines that aren't blank."""
    return values.agg(F.count_if(F.regexp_count("value", F.lit(f"[^{SPACE}]")) > 0).alias("n"))


def parse_sources(named: list[str], exists=lambda path: True) -> list[tuple[str, str]]:
    """(category, path) of `category:path` entries; without a category it's general; missing files are left out; none left is an error."""
    out = [tuple(x.split(":", 1)) if ":" in x else ("general", x) for x in named]
    out = [(c, p) for c, p in out if exists(p)]
    if not out:
        raise FileNotFoundError("none of the sources exists")
    return out


def load_config(text: str, strict: bool = True) -> dict:
    """A mapping from JSON, or YAML where that library is at hand; what is no mapping raises, or is empty."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if isinstance(found, dict):
        return found
    if strict:
        raise ValueError("a configuration must be a mapping")
    return {}


def manifest_texts(spark: SparkSession, manifest: dict, exists=lambda path: True) -> DataFrame:
    """Lines of a manifest's shards; no shards, or missing ones, raise."""
    paths = [s["path"] for s in manifest.get("shards", [])]
    if not paths:
        raise ValueError("the manifest names no shards")
    if missing := [p for p in paths if not exists(p)]:
        raise FileNotFoundError(f"missing shards: {missing[:3]}")
    return spark.read.text(paths)


def responses(raw: DataFrame, column: str = "raw_response", *keep: str) -> DataFrame:
    """keep, v: each object of the list `samples` in JSON responses. No network: the responses are rows."""
    each = raw.select(*keep, F.explode_outer(F.try_variant_get(F.try_parse_json(column), "$.samples", "array<variant>")).alias("v"))
    return each.filter(F.schema_of_variant("v").startswith("OBJECT"))


def sample_texts(values: DataFrame) -> DataFrame:
    """text of each line: prompt and answer under headings, text, content, or the line itself where it's no JSON; JSON strings are texts, other JSON that is no object is its own text, and blank texts go."""
    from lectern.functions.text import instruction_text

    rows = values.filter(F.col("value") != "").select("value", jsonlines.read(F.col("value")).alias("r"))
    fields = F.coalesce(instruction_text(F.col("r.prompt"), F.col("r.answer")), F.col("r.text"), F.col("r.content"))
    text = F.when(F.col("r.error").isNotNull(), F.col("value")).when(F.col("r.kind") == "object", fields).when(F.col("r.kind") == "string", F.col("r.whole")).otherwise(F.col("value"))
    return rows.select(text.alias("text")).filter(strip(F.coalesce("text", F.lit(""))) != "")


def resolve_weighted_sources(sources: list, key: str, exists=lambda path: True) -> list[dict]:
    """Weighted sources with a path each; what is no mapping, lacks a path, weighs nothing or doesn't exist raises, named by `key` and place."""
    for i, s in enumerate(sources):
        if not isinstance(s, dict) or "path" not in s:
            raise ValueError(f"{key}[{i}] must be a mapping with a path")
        if float(s.get("weight", 1.0)) <= 0:
            raise ValueError(f"{key}[{i}] must weigh more than nothing")
        if not exists(s["path"]):
            raise FileNotFoundError(f"{key}[{i}]: {s['path']}")
    return [dict(s) for s in sources]


def should_stream(config: dict, key: str, size: int | None) -> bool:
    """Whether a file is to be streamed: as the configuration says, else by its size (None: there's no file)."""
    if key in config:
        return bool(config[key])
    return size is not None and size >= int(config.get("auto_streaming_min_bytes", 256 << 20))


#: Weights of the template source's kinds, and their parts: a text is built of parts of one kind and more. {a} to {c} are numbers, {u} to {w} words.
TEMPLATES = (
    (20, '{{"id": {a}, "name": "{u}", "tags": ["{v}", "{w}{b}"], "nested": {{"ok": true, "count": {c}, "note": "a \\"{u}\\" of {v}"}}}}'),
    (20, "# {u} {a}\n\n- {v} and {w}\n- {b} of them\n\n| {u} | {v} |\n|---|---|\n| {a} | {b} |\n\n> {w} {u}"),
    (12, "{u}:\n  name: {v}{a}\n  replicas: {b}\n  labels:\n    kind: {w}\n  ports:\n    - {c}"),
    (16, "def {u}_{a}(x, {v}={b}):\n    if x > {v}:\n        return [x, {c}, '{w}']\n    return {{'{w}': x}}"),
    (16, "function {u}{a}(x) {{\n  const {v} = {{ {w}: {b} }};\n  return x.map((y) => y + {v}.{w}).filter((y) => y !== {c});\n}}"),
    (10, '````markdown\n```json\n{{"{u}": {a}, "{v}": [{b}]}}\n```\n{w} text {c}\n````'),
    (6, '{u} = "C:\\\\{v}\\\\n{b}" and a line\\n of \\"{w}\\" ends at {c}'),
)


def synthetic(rows: DataFrame, id_col: str, words: Column, seed: int = 42, least: int = 1800, most: int = 4200) -> DataFrame:
    """id_col, text: a structured text for each row, from templates drawn by hash and the row's own words (plain ones are used; without any it's `item`); a text ends with the part that reaches its own drawn length."""
    bounds, total = [], 0
    for w, _ in TEMPLATES:
        total += w
        bounds.append(total)

    def drawn(*on: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("__id"), *on)), 1, 8), 16, 10).cast("long")

    def part(i: Column) -> Column:
        return once(F.pmod(drawn(i, F.lit("kind")), F.lit(total)), lambda pick: of_kind(i, pick))

    def of_kind(i: Column, pick: Column) -> Column:
        out = F.lit("")
        for (_, t), top in reversed(list(zip(TEMPLATES, bounds, strict=True))):
            pieces = re.split(r"(\{[abcuvw]\})", t.replace("{{", "\x01").replace("}}", "\x02"))
            said = []
            for p in pieces:
                if re.fullmatch(r"\{[abc]\}", p):
                    said.append(F.pmod(drawn(i, F.lit(p[1])), F.lit(1000)).cast("string"))
                elif re.fullmatch(r"\{[uvw]\}", p):
                    said.append(F.get(F.col("__words"), F.pmod(drawn(i, F.lit(p[1])), F.size("__words")).cast("int")))
                elif p:
                    said.append(F.lit(p.replace("\x01", "{").replace("\x02", "}")))
            out = F.when(pick < top, F.concat(*said)).otherwise(out)
        return out

    plain = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda x: x.rlike("^[A-Za-z]{2,20}$"))
    d = rows.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("__id"), plain.alias("__words"))
    d = d.withColumn("__words", F.when(F.size("__words") > 0, F.col("__words")).otherwise(F.array(F.lit("item"))))
    d = d.withColumn("__end", least + F.pmod(drawn(F.lit("length")), F.lit(most - least + 1)))
    # a part is made when it's joined: those after the text's end never are
    more = lambda acc, i: F.when(F.length(acc) >= F.col("__end"), acc).otherwise(F.concat(acc, F.when(acc == "", "").otherwise("\n\n"), part(i)))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(most // 40)), F.lit(""), more)
    return d.select(id_col, grown.alias("text"))
