"""Instruction samples: normalising, checking, merging; structural verdicts and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import structure as S
from lectern.functions.text import sample_key, strip
from lectern.operators.ordered import first_of_each, running

#: Tasks with the default draw's weights, tasks of structured output with theirs, formats, the plan's targets, markers of a trap.
TASKS = {"general_qa": 0.30, "simple_format": 0.15, "json_escape": 0.20, "markdown_nested": 0.15, "control_trap": 0.10, "mixed_format": 0.10}
STRUCTURED = {"strict_json_object": 0.40, "json_array_output": 0.15, "json_format_repair": 0.15, "markdown_table": 0.12, "yaml_config": 0.10, "format_replay_qa": 0.08}
FORMATS = ("plain", "json", "markdown", "markdown_json", "markdown_python", "markdown_python_json", "yaml")
PLAN = {"general_qa": 40_000, "simple_format": 20_000, "json_escape": 25_000, "markdown_nested": 20_000, "control_trap": 10_000, "mixed_format": 5_000}
TRAPS = ("}", "```", "admin", "忽略", "提前", "关闭", "结束")
REQUIRED = ("task_type", "format", "difficulty", "instruction", "input", "output")
EVALUATED = ("id", "task_type", "prompt", "answer", "format")


def parse_weights(tasks: list[str], raw: str | None, default: dict[str, float] | None = None) -> dict[str, float]:
    """Weights from `name=weight,...`; tasks that aren't named weigh as by default, else 1."""
    said = dict(x.split("=", 1) for x in (raw or "").split(",") if "=" in x)
    said = {k.strip(): float(v) for k, v in said.items()}
    return {t: said.get(t, (default or {}).get(t, 1.0)) for t in tasks}


def normalise_samples(samples: DataFrame, task: str, order: str, model: str = "", batch: int = 0, source: str = "generated") -> DataFrame:
    """Samples with trimmed fields, defaults for missing ones, and an id by order; a difficulty that is no number gives null."""
    field = lambda c, d: strip(F.coalesce(F.col(c).cast("string"), F.lit(d)))
    from lectern.operators.ordered import dense_rank_of

    d = dense_rank_of(samples, order, "_idx")
    return d.select(
        F.format_string(f"ai_{task}_%08d", F.col("_idx")).alias("id"),
        F.lit(source).alias("source"),
        F.lit(model).alias("source_model"),
        F.lit(batch).alias("source_batch"),
        field("task_type", task).alias("task_type"),
        field("format", "plain").alias("format"),
        F.when(F.col("difficulty").isNull(), 1).otherwise(F.col("difficulty").cast("string").try_cast("int")).alias("difficulty"),
        *[field(c, "").alias(c) for c in ("instruction", "input", "output")],
        order,
    )


def check_samples(samples: DataFrame, structured: bool = False, present: str | None = None) -> DataFrame:
    """`samples` with reason: `ok` or the first thing wrong. `present` names an array column of the keys that a sample has."""
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("None" if present else "")))
    task, fmt, ask, out = (text(c) for c in ("task_type", "format", "instruction", "output"))
    d = samples.withColumn("_json", F.when(fmt == "json", S.json_kind(F.when(fmt == "json", out).otherwise("{}")))).withColumn("_closed", S.fences_balanced(out))
    kind, error, low = F.col("_json.kind"), F.col("_json.error"), F.ltrim(out)
    bracket = low.startswith("{") | low.startswith("[")
    reason = F
    for k in REQUIRED if present else ():
        reason = reason.when(~F.array_contains(present, k), f"missing_field:{k}")
    reason = reason.when(~task.isin(*TASKS, *(STRUCTURED if structured else ())), F.concat(F.lit("bad_task_type:"), task))
    reason = reason.when(~fmt.isin(*FORMATS), F.concat(F.lit("bad_format:"), fmt)).when(ask == "", "empty_instruction").when(out == "", "empty_output")
    reason = reason.when(F.length(ask) > 1200, "instruction_too_long").when(F.length(out) > 6000, "output_too_long")
    is_json = fmt == "json"
    if structured:
        reason = reason.when(is_json & ~bracket, "json_output_must_start_with_object_or_array")
    reason = reason.when(is_json & error.isNotNull(), F.concat(F.lit("json_output_invalid:"), error))
    if structured:
        reason = reason.when(is_json & (kind == "scalar"), "json_output_must_be_object_or_array")
        reason = reason.when(is_json & task.isin("strict_json_object", "json_escape", "json_format_repair") & (kind != "object"), "json_output_must_be_object")
        reason = reason.when(is_json & (task == "json_array_output") & (kind != "array"), "json_output_must_be_array")
    reason = reason.when((fmt.startswith("markdown") | out.contains("```")) & ~F.col("_closed"), "markdown_fence_unbalanced")
    if structured:
        reason = reason.when((fmt == "yaml") & (~out.contains(":") | bracket), "yaml_output_invalid_shape")
    trap = reduce(lambda a, b: a | b, [ask.contains(m) for m in TRAPS])
    return d.withColumn("reason", reason.when((task == "control_trap") & ~trap, "control_trap_not_obvious").otherwise("ok")).drop("_json", "_closed")


def without_existing(samples: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """Samples whose key isn't among the existing ones."""
    return samples.join(existing.select(key).distinct(), key, "left_anti")


def up_to_need(samples: DataFrame, order: str, need: int) -> tuple[DataFrame, DataFrame]:
    """The first `need` samples, and the overflow."""
    from lectern.operators.ordered import dense_rank_of

    d = dense_rank_of(samples, order, "__place")
    return d.filter(F.col("__place") < need).drop("__place"), d.filter(F.col("__place") >= need).drop("__place")


def merge_samples(parts: list[DataFrame], order: str, structured: bool = False) -> DataFrame:
    """Valid samples of all parts, the first of each key; `order` is unique over the parts."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    good = check_samples(whole, structured).filter("reason = 'ok'").drop("reason")
    return first_of_each(good.withColumn("key", sample_key(F.col("instruction"), F.col("output"))), "key", order)


def merge_stats(samples: DataFrame) -> DataFrame:
    """task_type, format, n: by task, by format, and in all (null stands for all)."""
    return samples.groupingSets([["task_type"], ["format"], []], "task_type", "format").agg(F.count("*").alias("n"))


def plan_counts(counts: DataFrame, plan: dict[str, int] | None = None) -> DataFrame:
    """task_type, target, n, missing of a plan; a task without rows counts 0. `counts`: task_type, n."""
    p = counts.sparkSession.createDataFrame(list((plan or PLAN).items()), "task_type string, target int")
    return p.join(counts, "task_type", "left").select("task_type", "target", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("missing"))


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, prompt, answer: user turns with the assistant's turn right after."""
    w = W.partitionBy(conv).orderBy(turn)
    d = turns.select(conv, turn, F.col(role).alias("_r"), F.col(text).alias("prompt"), F.lead(role).over(w).alias("_next"), F.lead(text).over(w).alias("answer"))
    return d.filter("_r = 'user' AND _next = 'assistant'").select(conv, turn, "prompt", "answer")


def chat_prompts(pairs: DataFrame, conv: str = "conv_id", turn: str = "turn", turns: int = 3) -> DataFrame:
    """conv, turn, chat_prompt: each question below its conversation's last `turns` pairs."""
    w = W.partitionBy(conv).orderBy(turn).rowsBetween(-turns, -1)
    shown = F.concat(F.lit("问题："), strip(F.col("prompt")), F.lit("\n回答："), strip(F.col("answer")), F.lit("\n"))
    past = F.collect_list(shown).over(w) if turns > 0 else F.array().cast("array<string>")
    head = F.when(F.size("_past") > 0, F.lit("以下是用户与助手的多轮对话。请结合上下文回答当前用户问题。\n")).otherwise("")
    return pairs.withColumn("_past", past).select(conv, turn, F.concat(head, F.array_join("_past", ""), F.lit("问题："), strip(F.col("prompt")), F.lit("\n回答：")).alias("chat_prompt"))


# ---- verdicts -----------------------------------------------------------------------------------


def _group(task: Column, fmt: Column) -> Column:
    t, f = F.lower(F.coalesce(task, F.lit("none"))), F.lower(F.coalesce(fmt, F.lit("none")))
    return F.when((f == "json") | t.contains("json_escape"), "json").when((t == "mixed") | (f == "mixed"), "mixed").when((f == "markdown") | t.contains("markdown") | t.contains("fence"), "markdown").otherwise("unknown")


def judge_outputs(rows: DataFrame, output: str, task: str = "task_type", fmt: str = "format", out: str = "reason") -> DataFrame:
    """`rows` with group and reason: the check of an output's kind."""
    d = rows.withColumn("group", _group(F.col(task), F.col(fmt)))
    # each check sees only its own rows' texts; the others get null, which costs nothing
    of = lambda g: F.when(F.col("group") == g, F.coalesce(F.col(output), F.lit("")))
    said = F.coalesce(S.json_check(of("json")), S.mixed_check(of("mixed")), S.markdown_check(of("markdown")))
    none = F.format_string("unknown_task_or_format: task_type=%s, format=%s", F.lower(F.coalesce(F.col(task), F.lit("None"))), F.lower(F.coalesce(F.col(fmt), F.lit("None"))))
    return d.withColumn(out, F.coalesce(said, none))


def judge_samples(rows: DataFrame, present: str | None = None, load_error: str | None = None) -> DataFrame:
    """`rows` with ok and reason: required fields first, then the answer must pass and an unsafe answer, where there is one, must not."""
    d = judge_outputs(rows, "answer", out="_safe")
    if "unsafe_answer" in rows.columns:
        d = judge_outputs(d, "unsafe_answer", out="_unsafe")
        bad = (F.col("_unsafe") == "ok") & (strip(F.coalesce("unsafe_answer", F.lit(""))) != "")
    else:
        bad = F.lit(False)
    reason = F
    if load_error:
        reason = reason.when(F.col(load_error).isNotNull(), F.concat(F.lit("jsonl_load_error: "), F.col(load_error)))
    if present:
        missing = F.array_join(F.filter(F.array(*map(F.lit, EVALUATED)), lambda k: ~F.array_contains(present, k)), ",")
        reason = reason.when(missing != "", F.concat(F.lit("missing_fields: "), missing))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    reason = reason.when(blank("prompt"), "empty_prompt").when(blank("answer"), "empty_answer")
    parts = F.concat_ws(" | ", F.when(F.col("_safe") != "ok", F.col("_safe")), F.when(bad, "unsafe_answer_unexpectedly_passed"))
    d = d.withColumn("reason", reason.otherwise(F.when(parts == "", "ok").otherwise(parts)))
    return d.withColumn("ok", F.col("reason") == "ok").drop("_safe", "_unsafe", "group")


def pass_rates(verdicts: DataFrame, by: str, ok: str = "ok") -> DataFrame:
    """by, total, passed, failed, pass_rate of each group and of all (`(all)`)."""
    name = F.coalesce(F.col(by).cast("string"), F.lit("None")).alias("_by")
    d = verdicts.select(name, F.col(ok).alias("_ok")).rollup("_by").agg(F.grouping_id().alias("_g"), F.count("*").alias("total"), F.count_if("_ok").alias("passed"))
    return d.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col("_by")).alias(by), "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.coalesce(F.col("passed") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("pass_rate"))


def failure_reasons(verdicts: DataFrame, ok: str = "ok", reason: str = "reason") -> DataFrame:
    """reason (up to its first colon), n of failed rows."""
    return verdicts.filter(~F.col(ok)).groupBy(F.substring_index(reason, ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def evaluation(verdicts: DataFrame, group: str = "group", ok: str = "ok") -> DataFrame:
    """One row: overall pass rate and its complement, and the pass rates of json, markdown and mixed (0 without rows)."""
    rate = lambda c: F.coalesce(F.count_if(c & F.col(ok)) / F.nullif(F.count_if(c), F.lit(0)), F.lit(0.0))
    any_ = F.lit(True)
    return verdicts.agg(
        F.count("*").alias("total"),
        rate(any_).alias("overall_pass_rate"),
        F.coalesce(F.count_if(~F.col(ok)) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("fer"),
        *[rate(F.col(group) == g).alias(n) for g, n in (("json", "json_ppr"), ("markdown", "markdown_tdr"), ("mixed", "mixed_ppr"))],
    )


# ---- training logs ------------------------------------------------------------------------------


def best_so_far(log: DataFrame, step: str, value: str, run: str | None = None) -> DataFrame:
    """`log` with best, the smallest value up to each step, and improved, whether the step set it. Runs are told by `run`. A whole log takes two levels, like a sum."""
    d = running(log, {"__before": ("min", value)}, step, [run] if run else [])
    return d.withColumn("best", F.least("__before", value)).withColumn("improved", F.col("__before").isNull() | (F.col(value) < F.col("__before"))).drop("__before")


def mean_loss(log: DataFrame, step: str, values: list[str], most: int) -> DataFrame:
    """One row: the mean of each column over the first `most` steps; null counts as 0, and no rows give 0."""
    few = log.orderBy(step).limit(most)
    return few.agg(*[(F.coalesce(F.sum(F.coalesce(v, F.lit(0.0))), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias(v) for v in values])


def progress(log: DataFrame, step: str, elapsed: str, tokens: str, max_steps: int, start_step: int = 0) -> DataFrame:
    """`log` with tokens_per_second and estimated_remaining_time (seconds) at each step."""
    done = F.greatest(F.col(step) - start_step, F.lit(1))
    return log.withColumn("tokens_per_second", F.col(tokens) / F.greatest(F.col(elapsed), F.lit(1e-6))).withColumn("estimated_remaining_time", F.greatest(F.lit(max_steps) - F.col(step), F.lit(0)) * (F.col(elapsed) / done))


def call_budget(remaining: Column, batch: Column) -> Column:
    """Calls that a run may make: four for each batch that is missing, and ten."""
    return F.greatest(F.lit(10), (remaining / F.greatest(batch, F.lit(1)) * 4).cast("int") + 10)


def parameter_counts(layers: Column, width: Column, block: Column, vocabulary: Column, depths: int = 32, states: int = 9) -> Column:
    """struct of parameters by part, and their total."""
    parts = {
        "token_embedding": vocabulary * width,
        "position_embedding": block * width,
        "depth_embedding": (depths + 1) * width,
        "state_embedding": states * width,
        "transformer_blocks": layers * (12 * width * width + 13 * width),
        "final_layer_norm": 2 * width,
        "depth_head": width * (depths + 1) + (depths + 1),
        "state_head": width * states + states,
    }
    return F.struct(*[c.cast("long").alias(n) for n, c in parts.items()], reduce(lambda a, b: a + b, parts.values()).cast("long").alias("total"))
