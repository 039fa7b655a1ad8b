"""Scalar text functions as columns. Null text gives null unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: White space as Python's str methods and Unicode patterns know it; Java's and DuckDB's \s are narrower.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The CJK range that counts, and literals of command-line text.
CJK = "\\u4e00-\\u9fff"
COMMANDS = ("--checkpoint", "--config", "--device", "init-from-checkpoint", "Traceback", "python train", "pip install", "conda install", "usage:", "README")
#: Replacements of a unit's spellings, in order.
REPLACEMENTS = (("100°C", "100 摄氏度"), ("100 °C", "100 摄氏度"), ("100℃", "100 摄氏度"), ("100 ℃", "100 摄氏度"))
#: Markers at which a generated text ends; the first six also tell that it has run over.
STOPS = ("\n问题：", "\n回答：", "\nPrompt:", "\nAnswer:", "用户：", "助手：", "User ＞", "Model ＞")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often it's named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(c: Column) -> Column:
    """Runs of what isn't white space; none of a null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def script_count(c: Column, script: str = CJK) -> Column:
    """Characters of a class, CJK by default, told by how much shorter a text is without them: `regexp_count` lists each of them as a string first."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{script}]+", ""))


def script_ratio(c: Column, script: str = CJK) -> Column:
    return script_count(c, script) / F.greatest(F.length(c), F.lit(1))


def symbol_density(c: Column) -> Column:
    """Share of characters that are no letter, digit or white space; 1 for an empty text."""
    # the commonest classes go first, so that the many tests of white space meet only what's left
    rest = F.regexp_replace(c, r"[a-zA-Z0-9 \p{L}\p{N}]+", "")
    symbols = F.length(F.regexp_replace(rest, f"[{SPACE}]+", ""))
    return F.when(F.length(c) == 0, 1.0).otherwise(symbols / F.length(c))


def command_text(c: Column) -> Column:
    """Whether a text holds command-line talk, case aside."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in COMMANDS])


def repeated_ngrams(c: Column, n: int = 4, max_chars: int = 4000) -> Column:
    """Share of character n-grams that repeat earlier ones, in the first `max_chars` characters without white space."""

    @F.arrow_udf(Y.DoubleType())
    def share(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _repeated(t, n) for t in texts.to_pylist()], pa.float64())

    return share(F.substring(c, 1, max_chars))


def _repeated(text: str, n: int) -> float:
    """Share of n-grams of a text without white space that repeat earlier ones."""
    s = "".join(text.split())  # white space of str.split is SPACE
    if len(s) < n * 4:
        return 0.0
    signs = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    if n > 4 or int(signs.max()) >> 16:
        return 1 - len({s[i : i + n] for i in range(len(s) - n + 1)}) / (len(s) - n + 1)
    places, grams = len(s) - n + 1, np.zeros(len(s) - n + 1, np.uint64)
    for k in range(n):  # 16 bits a character
        grams = grams << np.uint64(16) | signs[k : k + places]
    grams.sort()
    return 1 - (1 + int(np.count_nonzero(grams[1:] != grams[:-1]))) / places


def normalise(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def dedup_key(c: Column) -> Column:
    """Digest of the text without white space."""
    return F.sha1(F.regexp_replace(c, f"[{SPACE}]+", ""))


def keep_reason(c: Column, least: int = 50, most_symbols: float = 0.35, most_repeats: float = 0.45, script: str = CJK) -> Column:
    """`kept` or the first reason against a text; the costly one is last."""
    reason = F.when(script_count(c, script) < least, "too_short").when(symbol_density(c) > most_symbols, "symbol_dense").when(command_text(c), "command_contaminated")
    if most_repeats < 1.0:
        reason = reason.when(repeated_ngrams(c) > most_repeats, "repeated_ngram")
    return reason.otherwise("kept")


def json_row(c: Column) -> Column:
    """A text as a compact JSON line without its line end."""
    return F.to_json(F.struct(c.alias("text")))


def row_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text's JSON line."""
    return (F.octet_length(json_row(F.coalesce(c, F.lit("")))) + 1).cast("long")


def replace_units(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), REPLACEMENTS, c)


def sample_key(instruction: Column, output: Column) -> Column:
    """Digest of what makes an instruction sample; its input doesn't."""
    return F.sha2(strip(F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n"), F.coalesce(output, F.lit("")))), 256)


def clean_generated(c: Column) -> Column:
    """A generated text up to the first of each stop marker in turn."""
    return strip(reduce(lambda x, m: F.substring_index(x, m, 1), STOPS, c))


def has_stop(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(m) for m in STOPS[:6]])


def cjk_spacing(c: Column) -> Column:
    """No white space between CJK characters, nor around CJK punctuation."""
    punct = "[\\u3001-\\u303f\\uff01-\\uff5e]"
    c = F.regexp_replace(c, f"(?<=[{CJK}])[{SPACE}]+(?=[{CJK}])", "")
    return F.regexp_replace(F.regexp_replace(c, f"[{SPACE}]+({punct})", "$1"), f"({punct})[{SPACE}]+", "$1")


def clamp_depth(c: Column, most: int = 32) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(most))


def preview(c: Column, chars: int = 300) -> Column:
    """A text's beginning on one line."""
    return F.replace(F.substring(c, 1, chars), F.lit("\n"), F.lit("\\n"))


# ---- prompts ------------------------------------------------------------------------------------


def instruction_text(prompt: Column, answer: Column) -> Column:
    """Instruction and response under headings."""
    return F.concat(F.lit("### Instruction:\n"), strip(prompt), F.lit("\n\n### Response:\n"), strip(answer), F.lit("\n"))


def instruction_prompt(prompt: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), strip(prompt), F.lit("\n\n### Response:\n"))


def question_part(prompt: Column) -> Column:
    return F.concat(F.lit("问题："), strip(prompt), F.lit("\n回答："))


def answer_part(answer: Column) -> Column:
    return F.concat(strip(answer), F.lit("\n"))


def prompt_of(prompt: Column, answer: Column, instruction: Column, input_: Column, output: Column) -> Column:
    """struct(prompt, answer): the pair itself, else instruction (and input below it) with output, else null."""
    said = lambda c: F.when(strip(c) != "", strip(c))
    more = F.concat_ws("\n", said(instruction), said(input_))
    return F.when(prompt.isNotNull() & answer.isNotNull(), F.struct(prompt.alias("prompt"), answer.alias("answer"))).when(instruction.isNotNull() & output.isNotNull(), F.struct(more.alias("prompt"), output.alias("answer")))


def training_text(raw: Column, pair: Column, text: Column, content: Column) -> Column:
    """A row's training text: raw text, the pair's parts, text, content, or empty."""
    joined = F.concat(question_part(pair["prompt"]), answer_part(pair["answer"]))
    return F.coalesce(raw, F.when(pair.isNotNull(), joined), text, content, F.lit(""))


def learning_rate(step: Column, max_lr: float, max_steps: int, warmup: int = 0, min_lr: float = 0.0, schedule: str = "cosine") -> Column:
    """Linear warm-up, then a cosine from `max_lr` to `min_lr`."""
    ratio = F.least(F.greatest((step - warmup) / max(1, max_steps - warmup), F.lit(0.0)), F.lit(1.0))
    later = F.lit(max_lr) if schedule != "cosine" else min_lr + 0.5 * (1 + F.cos(F.pi() * ratio)) * (max_lr - min_lr)
    return F.when((step <= warmup) & F.lit(warmup > 0), max_lr * step / max(1, warmup)).otherwise(later)


def _shown(form: Callable[[int], str]) -> Callable[[Column], Column]:
    """Figures as Python writes them: it rounds what the binary number really is, which Java's formats don't. For reports' few rows."""

    @F.pandas_udf(Y.StringType())
    def column(x: pd.Series) -> pd.Series:
        return x.map(lambda n: None if pd.isna(n) else form(int(n)))

    return column


pretty_bytes = _shown(lambda n: f"{n / (1 << 30):.2f} GB ({n / (1 << 20):.1f} MB)")
pretty_count = _shown(lambda n: f"{n:,} ({n / 1_000_000:.2f}M)")


# ---- logits -------------------------------------------------------------------------------------


def repetition_penalty(logits: Column, generated: Column, penalty: float) -> Column:
    """Logits (an array by token id) with those of generated tokens pushed down."""
    if penalty <= 1.0:
        return logits
    return once(generated, lambda seen: F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x)))


def no_repeat_ngram(logits: Column, generated: Column, n: int) -> Column:
    """Logits where a token that would repeat an n-gram of the generated ones is impossible; n of 1 and less changes nothing."""
    if n <= 1:
        return logits

    def banned(seen: Column) -> Column:
        size = F.size(seen)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: (i + n - 1 <= size) & (F.slice(seen, i, n - 1) == F.slice(seen, F.greatest(size - n + 2, F.lit(1)), n - 1)))
        return F.transform(starts, lambda i: F.element_at(seen, i + n - 1))

    cut = once(once(generated, banned), lambda no: F.transform(logits, lambda x, i: F.when(F.array_contains(no, i), F.lit(float("-inf"))).otherwise(x)))
    return F.when(F.size(generated) + 1 < n, logits).otherwise(cut)


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest are impossible; ties with it stay."""
    if k <= 0:
        return logits

    def cut(x: Column) -> Column:
        least = F.element_at(F.sort_array(x, False), F.least(F.lit(k), F.size(x)))
        return once(least, lambda low: F.transform(x, lambda v: F.when(v < low, F.lit(float("-inf"))).otherwise(v)))

    return once(logits, cut)


def top_p(logits: Column, p: float) -> Column:
    """Logits after the smallest set whose probability exceeds `p` are impossible; the largest always stays, and of equal ones the lower id is first."""
    if not 0.0 < p < 1.0:
        return logits

    @F.pandas_udf("array<double>")
    def cut(rows: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x):
                return x
            x = np.array(x, float)
            order = np.argsort(-x, kind="stable")
            e = np.exp(x[order] - x[order[0]])
            before = np.r_[0.0, np.cumsum(e / e.sum())[:-1]]
            x[order[before > p]] = -np.inf
            return x

        return rows.map(one)

    return cut(logits)
