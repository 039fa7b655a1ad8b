"""Functions of JSON and Markdown structure. Where they need Python, they're Arrow-batched pandas functions.

Three dialects of fences live side by side and stay apart: `line` (a closing line is exactly the opening
run), `stack` (a run at least as long closes, whatever follows it), and that of the annotator.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lectern.functions.annotate import annotate_lists
from lectern.functions.jsonlines import read_one

_OUTER = ("", "markdown", "md", "text", "txt")
_RUN = re.compile(r"(`{3,}|~{3,})(.*)", re.S)
_STACK = re.compile(r"\s*(`{3,}|~{3,})[^`~]*\s*", re.S)


def json_error(text: str | None) -> str | None:
    """None for what Python's parser takes, else its message."""
    try:
        json.loads(text if text is not None else "")
    except (ValueError, RecursionError) as e:
        return str(e) or type(e).__name__
    return None


def fence(line: str) -> tuple[str, int, str] | None:
    """Character, length and rest of a line that begins with a run of three or more."""
    m = _RUN.match(line.strip())
    return (m[1][0], len(m[1]), m[2].strip()) if m else None


def _closes(line: str, char: str, n: int) -> bool:
    return line.strip() == char * n


def markdown_reason(text: str) -> str:
    """`ok`, or what is wrong with a fenced answer (dialect `line`)."""
    lines = text.splitlines()
    if len(lines) < 2:
        return "markdown_too_short"
    filled = [i for i, x in enumerate(lines) if x.strip()]
    head = fence(lines[filled[0]]) if filled else None
    if not head:
        return "missing_outer_opening_fence"
    char, n, rest = head
    if rest.lower() not in _OUTER:
        return f"unexpected_outer_fence_suffix: {rest}"
    if not _closes(lines[filled[-1]], char, n):
        return "missing_or_wrong_outer_closing_fence"
    inner = [(i + 1, lines[i]) for i in range(filled[0] + 1, filled[-1])]
    early = next((i for i, x in inner if _closes(x, char, n)), None)
    if early:
        return f"early_outer_fence_close_at_line_{early}"
    clash = next((i for i, x in inner if (f := fence(x)) and f[0] == char and f[1] >= n), None)
    return f"inner_fence_can_conflict_with_outer_at_line_{clash}" if clash else "ok"


def json_blocks(text: str) -> list[str]:
    """Contents of fenced blocks marked json that are closed."""
    found, held, by = [], None, ("", 0)
    for line in text.splitlines():
        if held is None:
            f = fence(line)
            if f and f[2].lower() == "json":
                held, by = [], f[:2]
        elif _closes(line, *by):
            found.append("\n".join(held).strip())
            held = None
        else:
            held.append(line)
    return found


def mixed_reason(text: str) -> str:
    reason = markdown_reason(text)
    if reason != "ok":
        return "mixed_markdown_failed: " + reason
    blocks = json_blocks(text)
    if not blocks:
        return "mixed_no_json_block_found"
    return next((f"mixed_inner_json_invalid_block_{i}: {e}" for i, b in enumerate(blocks) if (e := json_error(b))), "ok")


def balanced(text: str) -> bool:
    """Whether fences close (dialect `stack`)."""
    open_: list[str] = []
    for line in (text or "").splitlines():
        m = _STACK.fullmatch(line)
        if not m:
            continue
        if open_ and m[1][0] == open_[-1][0] and len(m[1]) >= len(open_[-1]):
            open_.pop()
        else:
            open_.append(m[1])
    return not open_


def repaired(text: str) -> str:
    """The reading of a text among its encodings read wrongly that is most CJK; the text itself on a tie."""
    def worth(t: str) -> tuple[float, int]:
        n = sum("一" <= ch <= "鿿" for ch in t)
        return n / max(len(t), 1) - 0.01 * (t.count("�") + t.count("?")), n

    best, most = text, worth(text)
    for name in ("gbk", "cp936", "latin1"):
        try:
            t = text.encode(name).decode("utf-8")
        except UnicodeError:
            continue
        if worth(t) > most:
            best, most = t, worth(t)
    return best


# ---- columns ------------------------------------------------------------------------------------


def _string(f):
    @F.pandas_udf(Y.StringType())
    def column(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else f(t))

    return column


mojibake = _string(repaired)
markdown_check = _string(markdown_reason)
mixed_check = _string(mixed_reason)
json_check = _string(lambda t: "ok" if (e := json_error(t)) is None else f"invalid_json: {e}")


@F.pandas_udf(Y.BooleanType())
def fences_balanced(x: pd.Series) -> pd.Series:
    return x.map(lambda t: balanced(t or "")).astype(bool)


@F.pandas_udf(Y.StructType().add("kind", Y.StringType()).add("error", Y.StringType()))
def json_kind(x: pd.Series) -> pd.DataFrame:
    """object, array or scalar of a valid JSON text, else the parser's message."""
    found = [read_one(t if t is not None else "") for t in x]
    kinds = {"object": "object", "array": "array", "string": "scalar", "scalar": "scalar"}
    return pd.DataFrame([(kinds.get(r.get("kind")), r.get("error")) for r in found], columns=["kind", "error"], dtype=object)


def _replaced(value, table: tuple) -> tuple[object, int]:
    """A JSON value with its strings (not keys) replaced, and how many changed."""
    if isinstance(value, str):
        new = value
        for a, b in table:
            new = new.replace(a, b)
        return new, int(new != value)
    if isinstance(value, dict):
        parts = {k: _replaced(v, table) for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, sum(n for _, n in parts.values())
    if isinstance(value, list):
        items = [_replaced(v, table) for v in value]
        return [v for v, _ in items], sum(n for _, n in items)
    return value, 0


@F.pandas_udf(Y.StructType().add("value", Y.StringType()).add("changed", Y.IntegerType()))
def normalise_json(x: pd.Series) -> pd.DataFrame:
    """JSON lines with the spellings of units replaced in all their strings, however deep, and the number of strings changed; bad JSON raises, blank lines are null."""
    from lectern.functions.text import REPLACEMENTS

    rows = []
    for t in x:
        if t is None or not t.strip():
            rows.append((None, 0))
            continue
        value, n = _replaced(json.loads(t.strip()), REPLACEMENTS)
        rows.append((json.dumps(value, ensure_ascii=False), n))
    return pd.DataFrame(rows, columns=["value", "changed"])


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def json_blocks_of(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [] if t is None else json_blocks(t))


@F.arrow_udf(Y.StructType().add("depth", Y.ArrayType(Y.IntegerType())).add("state", Y.ArrayType(Y.IntegerType())))
def annotations(x: pa.Array) -> pa.Array:
    """Depth and state of each token of token arrays."""
    return pa.StructArray.from_arrays(annotate_lists(x), ["depth", "state"])
