"""Corpus preparation and profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ordered import first_of_each, under_quota, valid_split
from lectern.session import materialise, ship

#: Shares of the categories' bytes.
SHARES = {"general": 0.60, "education": 0.25, "technical": 0.10, "structured": 0.05}


def judged(docs: DataFrame, text: str = "text", fix: bool = False, **limits) -> DataFrame:
    """`docs` with clean (normalised text), reason, key and bytes; columns of these names are refused. A null text is empty (too_short)."""
    if taken := {"clean", "reason", "key", "bytes"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    ship(docs.sparkSession)
    source = F.col(text)
    if fix:
        from lectern.functions.structure import mojibake

        source = mojibake(source)
    d = docs.withColumn("clean", T.normalise(F.coalesce(source, F.lit(""))))
    # the key is `dedup_key` of a text whose only white space is single spaces
    return d.withColumn("reason", T.keep_reason(F.col("clean"), **limits)).withColumn("key", F.sha1(F.replace(F.col("clean"), F.lit(" "), F.lit("")))).withColumn("bytes", T.row_bytes(F.col("clean")))


def counters(judged_rows: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Seen, kept, duplicate and dropped rows by reason, and kept bytes: the first row of a key is kept."""
    by = by or []
    # one pass over the texts: rows of a key, reason and group meet as one, and only those are ranked
    few = judged_rows.groupBy(*by, "reason", "key").agg(F.count("*").alias("_n"), F.min(order).alias("_o"), F.min_by("bytes", order).alias("_b"))
    good = F.col("reason") == "kept"
    few = few.withColumn("_kept", good & (F.col("_o") == F.min("_o").over(W.partitionBy("reason", "key"))))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    reasons = [total(F.col("reason") == r).alias(r) for r in ("too_short", "symbol_dense", "command_contaminated", "repeated_ngram")]
    return few.groupBy(*by).agg(F.sum("_n").alias("seen"), F.count_if("_kept").alias("kept"), (total(good) - F.count_if("_kept")).alias("duplicate"), *reasons, F.coalesce(F.sum(F.when(F.col("_kept"), F.col("_b"))), F.lit(0)).alias("kept_bytes"))


def prepare(docs: DataFrame, order: str, category: str, target_bytes: int, shares: dict[str, float] | None = None, valid_rate: float = 0.002, valid_most: int = 10_000, seed: int = 0, **limits) -> DataFrame:
    """Kept rows with `valid`: filters, first-wins dedup, byte quotas by category, a global target.

    Deduplicates all rows before quotas. Reading in order and stopping at a quota differs where a later
    source repeats a text that was past an earlier source's stop; `prepare_in_order` gives that.
    """
    kept = first_of_each(materialise(judged(docs, **limits), "judged").filter("reason = 'kept'"), "key", order)
    kept = materialise(valid_split(kept, order, valid_rate, valid_most, seed), "kept")
    train, valid = kept.filter("NOT valid"), kept.filter("valid")
    quota = F.lit(target_bytes).cast("double")
    for name, share in (shares or SHARES).items():
        quota = F.when(F.col(category) == name, target_bytes * share).otherwise(quota)
    train = under_quota(train, "bytes", quota, order, [category])
    train = under_quota(train, "bytes", F.lit(target_bytes), order)
    return train.unionByName(valid)


def prepare_in_order(sources: list[DataFrame], order: str, quotas: list[int], **limits) -> DataFrame:
    """Kept rows of sources one after another: each leaves out keys that earlier ones kept, and stops at its quota of bytes."""
    taken: DataFrame | None = None
    for docs, quota in zip(sources, quotas, strict=True):
        kept = first_of_each(materialise(judged(docs, **limits), "judged").filter("reason = 'kept'"), "key", order)
        if taken is not None:
            kept = kept.join(taken.select("key"), "key", "left_anti")
        got = materialise(under_quota(kept, "bytes", F.lit(quota), order), "taken")
        taken = got if taken is None else taken.unionByName(got)
    return taken


def profile(docs: DataFrame, text: str = "text", least: int = 50, script: str = T.CJK) -> DataFrame:
    """One row: rows, mean length, share of script characters (a ratio of sums), shares of contaminated, duplicate and short texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.length(t).alias("n"), T.script_count(t, script).alias("c"), T.command_text(t).alias("bad"), T.dedup_key(t).alias("key"))
    keys = d.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.count_if("bad").alias("bad"), F.count_if(F.col("c") < least).alias("short"))
    total = F.greatest(F.sum("rows"), F.lit(1))
    return keys.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("n") / total, F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.sum("c") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("script_ratio"),
        F.coalesce(F.sum("bad") / total, F.lit(0.0)).alias("contaminated_ratio"),
        F.coalesce((F.sum("rows") - F.count("*")) / total, F.lit(0.0)).alias("duplicate_ratio"),
        F.coalesce(F.sum("short") / total, F.lit(0.0)).alias("too_short_ratio"),
    )


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row of an aggregate as ok and reason: the first check that fails."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return df.select(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))
