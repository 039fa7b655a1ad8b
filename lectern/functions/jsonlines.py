"""JSON lines with the acceptance of Python's parser, mostly natively.

Spark's parser and Python's differ: one takes text after a value, the other takes NaN, repeated keys (the last counts) and
lone surrogates. `alike` tells of which lines both make the same: it takes a line apart as an automaton with a bounded stack, all in
column expressions: escapes become a character, strings a mark, numbers and literals another, and then the
innermost objects and arrays become values, LEVELS times. What ends as one value is plain JSON to both. All other
lines (and values that are no object or string, which are rendered as Python writes them) go to Python, once.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lectern.functions.text import once

#: Levels of nesting that are told natively.
LEVELS = 5
#: Fields that are read where they are strings.
NAMES = ("text", "content", "passage", "document", "prompt", "answer", "instruction", "input", "output")
_SCHEMA = Y.StructType([Y.StructField(n, Y.StringType()) for n in ("kind", "error", "whole", *NAMES)])
_NUMBER = r"-?(?:0|[1-9][0-9]{0,30})(?:\.[0-9]{1,30})?(?:[eE][+-]?[0-9]{1,3})?"
_VALUE, _PAIR = "[\x01\x02]", "\x01:[\x01\x02]"
_INNERMOST = rf"\{{(?:{_PAIR}(?:,{_PAIR})*+)?+\}}|\[(?:{_VALUE}(?:,{_VALUE})*+)?+\]"


def alike(line: Column) -> Column:
    """Whether Spark's parser and Python's surely read a line alike."""
    c = F.regexp_replace(line, r'\\["\\/bfnrt]', "_")
    c = F.regexp_replace(c, r"\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}", "_")
    c = F.regexp_replace(c, r'"[^"\\\x00-\x1f]*+"', "\x01")
    c = F.regexp_replace(c, rf"(?<![^ \t\r\n\[:,])(?:{_NUMBER}|true|false|null)(?![^ \t\r\n\],}}])", "\x02")
    c = F.regexp_replace(c, r"[ \t\r\n]+", "")
    for _ in range(LEVELS):
        c = F.regexp_replace(c, _INNERMOST, "\x02")
    return ~line.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") & c.isin("\x01", "\x02")


def read_one(text: str) -> dict:
    """What Python makes of a line: kind and strings, or the parser's message. `whole` is a string, or what isn't an object as Python writes it."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        return {"error": str(e) or type(e).__name__}
    if isinstance(value, dict):
        return {"kind": "object"} | {n: value[n] for n in NAMES if isinstance(value.get(n), str)}
    kind = "string" if isinstance(value, str) else "array" if isinstance(value, list) else "scalar"
    return {"kind": kind, "whole": str(value)}


@F.arrow_udf(_SCHEMA)
def _by_python(lines: pa.Array) -> pa.Array:
    rows = [{} if t is None else read_one(t) for t in lines.to_pylist()]
    # lone surrogates have no UTF-8: they become the replacement character
    clean = lambda s: s if s is None else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return pa.StructArray.from_arrays([pa.array([clean(r.get(n)) for r in rows], pa.string()) for n in _SCHEMA.names], _SCHEMA.names)


def typed(v: Column, field: str) -> Column:
    """A field that is a string, of a variant."""
    got = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def read(line: Column) -> Column:
    """struct(kind, error, whole, and NAMES): kind is object, string, array or scalar, or null with Python's error; `whole` is what isn't an object, as text. Null gives nulls."""
    v = F.try_parse_json(line)
    shape = F.schema_of_variant(v)
    native = alike(line) & (shape.startswith("OBJECT") | (shape == "STRING"))
    other = _by_python(F.when(~F.coalesce(native, F.lit(False)), line))

    def mine(v: Column) -> Column:
        string = F.schema_of_variant(v) == "STRING"
        fields = {"kind": F.when(string, "string").when(v.isNotNull(), "object"), "error": F.lit(None).cast("string"), "whole": F.when(string, F.try_variant_get(v, "$", "string"))}
        return F.struct(*[c.alias(n) for n, c in (fields | {n: typed(v, n) for n in NAMES}).items()])

    return F.when(other["kind"].isNull() & other["error"].isNull(), once(v, mine)).otherwise(other)
