"""A pattern tokenizer, vocabularies, and encoding, as columns and joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import materialise, ship

#: Tokens of a vocabulary that goes to all executors at most (some 50 bytes each); a larger one is joined.
BROADCAST_TOKENS = 500_000

#: The token pattern's alternatives, longest structures first; special tokens; structural seeds.
PATTERN = "|".join(
    (
        "`{3,}[A-Za-z0-9_-]*",
        "~{3,}[A-Za-z0-9_-]*",
        r"\\\"",
        r"\\\\",
        r"\\n",
        r"\r\n|\n|\t",
        r"[ \f\x0B]+",
        "[A-Za-z_][A-Za-z_0-9]*",
        r"\p{Nd}+(?:\.\p{Nd}+)?",
        r"[一-鿿]",
        r"[^\t-\r\x1c-\x20\x85\xa0  -     　A-Za-z_0-9]",
    )
)
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
SEEDS = ("```", "````", "```markdown", "````markdown", "```json", "```kotlin", "```python", "~~~", "~~~markdown", "~~~json", '\\"', "\\\\", "\\n", "{", "}", "[", "]", ":", ",", '"', "`", "~")
PAD, UNK, BOS, EOS = range(4)


def tokenise(text: Column) -> Column:
    """Tokens in order; characters that nothing matches are dropped."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PATTERN})"), F.lit(1))


def train_vocabulary(texts: DataFrame, text: str, order: str, size: int, least: int = 1, candidates: DataFrame | None = None) -> DataFrame:
    """token, token_id: specials and seeds, then tokens by count, ties by first appearance (`order` of rows, then place). With `candidates` (a column token) only those are counted."""
    base = texts.sparkSession.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(SPECIALS + SEEDS))], "token string, token_id int").coalesce(1)
    n = len(dict.fromkeys(SPECIALS + SEEDS))
    split = lambda rows: rows.select(F.col(order).alias("ord"), tokenise(F.col(text)).alias("tokens"))
    # an inner explode infers a filter on its list, which tokenises all texts once more where they're read
    seen = split(texts).select("ord", F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    if candidates is not None:
        seen = seen.join(F.broadcast(candidates) if candidates.count() <= BROADCAST_TOKENS else candidates, "token", "left_semi")
    # counts and first rows are numbers that hash aggregation adds up in place (a struct with the place would be sorted token by token)
    counts = seen.groupBy("token").agg(F.count("*").alias("n"), F.when(F.count_if(F.col("ord").isNull()) == 0, F.min("ord")).alias("ord"))
    fresh = materialise(counts.filter(F.col("n") >= least).join(F.broadcast(base), "token", "left_anti"), "counts")  # 26 rows
    by_first = [F.desc("n"), F.asc_nulls_first("ord")]
    # the last count and row that make it: what's left is as many tokens, and those that first appear in that row as often
    last = fresh.orderBy(*by_first).limit(max(0, size - n)).orderBy("n", F.desc_nulls_last("ord")).limit(1).select(F.col("n").alias("_n"), F.col("ord").alias("_ord"))
    near = fresh.join(F.broadcast(last), (F.col("n") > F.col("_n")) | (F.col("n") == F.col("_n")) & (F.col("ord").isNull() | (F.col("ord") <= F.col("_ord")))).drop("_n", "_ord")
    near = materialise(near, "frequent")
    rows = near.select("ord").distinct()
    first = split(texts.join(rows, texts[order].eqNullSafe(rows["ord"]), "left_semi")).select("ord", F.posexplode_outer("tokens").alias("pos", "token"))
    met = near.select("token", "n", F.col("ord").alias("of")).join(first.withColumnRenamed("token", "_t"), (F.col("token") == F.col("_t")) & F.col("of").eqNullSafe(F.col("ord")))
    placed = met.groupBy("token", "n", "of").agg(F.min("pos").alias("pos"))
    best = [F.desc("n"), F.asc_nulls_first("of"), F.asc("pos")]
    top = placed.orderBy(*best).limit(max(0, size - n))
    ranked = top.withColumn("token_id", (F.row_number().over(W.orderBy(*best)) + n - 1).cast("int"))
    return base.unionByName(ranked.select("token", "token_id"))


def heavy_tokens(texts: DataFrame, text: str, most: int, counters: int | None = None) -> DataFrame | None:
    """token: candidates that surely hold the `most` most frequent tokens with all their ties; None if bounded summaries can't tell.

    Each task keeps `counters` counts at most (16 times `most`). When there are more, the next largest count is taken off all of
    them, and what isn't left above nothing goes: so a count is too low by at most what was taken off, and so is the
    count of a token that went. Summaries add up, and so do their errors. Tokens whose count plus the error falls short of the
    `most`-th count can't be among the most frequent ones. If the error itself reaches that count, tokens that no summary
    holds might be, and nothing can be told.
    """
    ship(texts.sparkSession)
    room = counters or 16 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = pa.table({"token": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        for batch in batches:
            met = pc.value_counts(batch.column(0).flatten())
            new = pa.table({"token": met.field(0), "n": met.field(1)})
            held = pa.concat_tables([held, new]).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
            if len(held) > room:
                n = held["n"].to_numpy()
                off = int(np.partition(n, len(n) - room - 1)[len(n) - room - 1])
                held, error = held.filter(pa.array(n > off)), error + off
                held = held.set_column(1, "n", pc.subtract(held["n"], off))
        yield from held.combine_chunks().to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([error], pa.int64())], names=["token", "n"])

    rows = texts.select(tokenise(F.col(text)).alias("tokens")).mapInArrow(run, "token string, n long")
    found = materialise(rows.groupBy("token").agg(F.sum("n").alias("n")), "summaries")
    error = found.filter("token IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = found.filter("token IS NOT NULL")
    # the seeds have ids of their own; they're counted like others, so as many places more are looked at
    place = most + len(dict.fromkeys(SPECIALS + SEEDS))
    best = counts.select("n").orderBy(F.desc("n")).limit(place).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    if best.k < place:
        return counts.select("token") if not error else None
    return counts.filter(F.col("n") + error >= best.n).select("token") if error < best.n else None


def train_vocabulary_by_summaries(texts: DataFrame, text: str, order: str, size: int, counters: int | None = None) -> DataFrame:
    """What `train_vocabulary` gives, ties included, with an exact count of candidates alone; of all tokens where summaries can't tell."""
    return train_vocabulary(texts, text, order, size, candidates=heavy_tokens(texts, text, max(1, size), counters))


def vocabulary_map(vocabulary: DataFrame) -> DataFrame:
    """One row: the vocabulary as a JSON object."""
    return vocabulary.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "token_id")))).alias("token_to_id"))).alias("value"))


def load_vocabulary(rows: DataFrame) -> DataFrame:
    """token, token_id of the JSON object in `value`."""
    return rows.select(F.explode(F.from_json("value", "token_to_id map<string,int>")["token_to_id"]).alias("token", "token_id"))


def _shared(vocabulary: DataFrame):
    """A vocabulary as arrays of tokens and ids on all executors; None where it's too large for that."""
    rows = vocabulary.select("token", "token_id").orderBy("token_id").limit(BROADCAST_TOKENS + 1).collect()
    if len(rows) > BROADCAST_TOKENS:
        return None
    return ship(vocabulary.sparkSession).sparkContext.broadcast(([r.token for r in rows], [r.token_id for r in rows]))


def encode(tokenised: DataFrame, vocabulary: DataFrame, key: str, tokens: str = "tokens", specials: bool = True, out: str = "ids") -> DataFrame:
    """key, ids of each row: unknown tokens to the unknown id. A null list is empty; keys may be null or repeat. Token by token in place, without a shuffle; for a vocabulary too large to send, by a join on the tokens of numbered rows."""
    filled = tokenised.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("_tokens"))
    shared = _shared(vocabulary)
    if shared is None:
        ids = _by_join(filled, vocabulary.select("token", F.col("token_id").alias("_found")), "_tokens", "token", F.lit(UNK)).select(key, F.col("_found").alias("_ids"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ids = (pa.array(x, t) for x, t in zip(shared.value, (pa.string(), pa.int32()), strict=True))
            for batch in batches:
                lists = batch.column(1)
                found = pc.fill_null(ids.take(pc.index_in(lists.flatten(), value_set=names)), UNK)
                yield pa.RecordBatch.from_arrays([batch.column(0), _in_lists(found, lists)], names=[key, "_ids"])

        ids = filled.mapInArrow(run, f"`{key}` {filled.schema[key].dataType.simpleString()}, _ids array<int>")
    whole = F.concat(F.array(F.lit(BOS)), F.col("_ids"), F.array(F.lit(EOS))) if specials else F.col("_ids")
    return ids.select(key, whole.alias(out))


def _by_join(rows: DataFrame, vocabulary: DataFrame, listed: str, on: str, missing: Column) -> DataFrame:
    """`rows` with `_found`: for each element of a list what the vocabulary has for it, else `missing`, in order. Rows are numbered and written first, so keys needn't tell them apart."""
    numbered = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    met = numbered.select("_row", F.posexplode(listed).alias("_pos", on)).join(vocabulary, on, "left")
    found = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_found", missing).alias("x"))))["x"].alias("_found"))
    return numbered.join(found, "_row", "left").withColumn("_found", F.coalesce("_found", F.array())).drop("_row")


def _in_lists(values: pa.Array, like: pa.ListArray) -> pa.ListArray:
    """Values laid out as the lists of another array without nulls."""
    counts = pc.list_value_length(like).to_numpy(zero_copy_only=False)
    offsets = [0, *counts.cumsum().tolist()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _named(encoded: DataFrame, vocabulary: DataFrame, key: str, ids: str) -> DataFrame:
    """key, _names: the token of each id, the unknown token where there's none. A null list is empty."""
    filled = encoded.select(key, F.coalesce(ids, F.array().cast("array<int>")).cast("array<int>").alias("_ids"))
    shared = _shared(vocabulary)
    if shared is None:
        return _by_join(filled, vocabulary.select(F.col("token").alias("_found"), "token_id"), "_ids", "token_id", F.lit(SPECIALS[UNK])).select(key, F.col("_found").alias("_names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = (pa.array(x, t) for x, t in zip(shared.value, (pa.string(), pa.int32()), strict=True))
        for batch in batches:
            lists = batch.column(1)
            said = pc.fill_null(names.take(pc.index_in(lists.flatten(), value_set=numbers)), SPECIALS[UNK])
            yield pa.RecordBatch.from_arrays([batch.column(0), _in_lists(said, lists)], names=[key, "_names"])

    return filled.mapInArrow(run, f"`{key}` {filled.schema[key].dataType.simpleString()}, _names array<string>")


def decode(encoded: DataFrame, vocabulary: DataFrame, key: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """key, text of each row: tokens joined; padding, begin and end are left out, the unknown token isn't, and stands for unknown ids. A null list is empty; keys may be null or repeat."""
    silent = (SPECIALS[PAD], SPECIALS[BOS], SPECIALS[EOS])
    return _named(encoded, vocabulary, key, ids).select(key, F.array_join(F.filter("_names", lambda t: ~t.isin(*silent)), "").alias(out))


def annotate_ids(encoded: DataFrame, vocabulary: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """key, depth_ids, state_ids of id lists: specials are depth 0 and plain, and the annotator doesn't see them; unknown ids are the unknown token, a special one. Keys may be null or repeat."""
    from lectern.functions.annotate import PLAIN, annotate_lists

    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            seen = pc.invert(pc.is_in(flat, value_set=pa.array(SPECIALS))).to_numpy(zero_copy_only=False)
            offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            kept = np.r_[0, np.cumsum(seen)][offsets]
            made = annotate_lists(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(seen))))
            out = []
            for values, special in zip(made, (0, PLAIN), strict=True):
                whole = np.full(len(flat), special, np.int32)
                whole[seen] = values.values.to_numpy()
                out.append(_in_lists(pa.array(whole), lists))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[key, "depth_ids", "state_ids"])

    rows = _named(encoded, vocabulary, key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, depth_ids array<int>, state_ids array<int>")


def special_id(named: dict[str, int | None], name: str) -> int:
    """A special id by name, with what stands in for it where it's missing."""
    order = {"bos": ("bos", "cls", "eos", "sep", "pad"), "eos": ("eos", "sep", "pad"), "unk": ("unk", "pad"), "pad": ("pad",)}[name]
    return next((named[k] for k in order if named.get(k) is not None), 0)
