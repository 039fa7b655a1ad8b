"""Operators over a total order: running sums, quotas, splits, shards, blocks.

A running sum over all rows takes two levels: rows are dealt to ranges of the order, each range is
summed, the ranges' sums (few) are accumulated, and each range runs on from there. No range
holds more than its share of the rows.

Columns that these operators add for themselves begin with two underscores; a table's own must not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import nextfit
from lectern.operators.smooth import schedule
from lectern.session import materialise, ship


def _same(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of one name where nulls equal each other; `b`'s are dropped."""
    right = b.withColumnsRenamed({n: f"__right_{n}" for n in names})
    on = reduce(lambda x, y: x & y, [a[n].eqNullSafe(right[f"__right_{n}"]) for n in names])
    joined = a.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__right_{n}" for n in names])


def running_before(df: DataFrame, value: str, order: str, by: list[str] | None = None, out: str = "before", total: str | None = None) -> DataFrame:
    """`df` with the sum of `value` over the rows before each in its group, and the group's sum as `total`. `order` is unique within a group.

    Rows are dealt to ranges of (by, order), as many as the session has shuffle partitions, and written there, so a group that
    holds most rows has many ranges. Defined cases: nulls of `order` come first and of `by` are a group; null values
    add nothing; rows of equal order follow each other in some order; an empty table gives no rows.
    """
    by = by or []
    cut = materialise(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy(*by, "__part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    starts = sums.withColumn("__start", F.sum("__sum").over(W.partitionBy(*by).orderBy("__part")) - F.col("__sum"))
    if total:
        starts = starts.withColumn(total, F.sum("__sum").over(W.partitionBy(*by)))
    starts = starts.drop("__sum")
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*by, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _same(cut.withColumn("__inner", inner), starts, [*by, "__part"]).withColumn(out, F.col("__start") + F.col("__inner")).drop("__part", "__start", "__inner")


#: How values merge: over rows, and what came before with what a range holds.
_MERGES = {
    "sum": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, here: F.coalesce(here, before)),
}


def running(df: DataFrame, outs: dict[str, tuple[str, str | Column]], order: str, by: list[str] | None = None) -> DataFrame:
    """`df` with what the rows before each in its group merge to: for each name (merge, column).

    Merges are sum, min, max, last (the last value that isn't null), and argmin and argmax of a struct(value, of): the `of` of the smallest
    or largest number, of equal ones the earliest. Any associative merge takes the same two levels: ranges of the order are merged, the
    ranges before each are merged (a row a range), and each range goes on from there. Null where nothing came before (sum: 0); null values
    are passed over. `order` is unique within a group; nulls of it come first and of `by` are a group.
    """
    by, merges, values = by or [], {}, {}
    for name, (merge, column) in outs.items():
        c = F.col(column) if isinstance(column, str) else column
        if merge in ("argmin", "argmax"):
            v = c.getField("value") if merge == "argmin" else -c.getField("value")
            c = F.when(v.isNotNull(), F.struct(v.alias("value"), F.col(order).alias("order"), c.getField("of").alias("of")))  # of equal values the earliest
        merges[name], values[f"__v_{name}"] = _MERGES["min" if merge.startswith("arg") else merge], c
    cut = materialise(df.withColumns(values).repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy(*by, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(order))).alias(n) if outs[n][0] == "last" else m(F.col(f"__v_{n}")).alias(n) for n, (m, _) in merges.items()]
    ranges = cut.groupBy(*by, "__part").agg(*whole)
    before = ranges.select(*by, "__part", *[m(F.col(n)).over(along).alias(f"__b_{n}") for n, (m, _) in merges.items()])
    met = _same(cut.withColumns({f"__i_{n}": m(F.col(f"__v_{n}")).over(inside) for n, (m, _) in merges.items()}), before, [*by, "__part"])
    made = {n: join(F.col(f"__b_{n}"), F.col(f"__i_{n}")) for n, (_, join) in merges.items()}
    return met.select(*df.columns, *[(c["of"] if outs[n][0].startswith("arg") else c).alias(n) for n, c in made.items()])


def dense_rank_of(df: DataFrame, order: str, out: str = "rank", by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """`df` with the 0-based place of each row in the order, and the number of the group's rows as `total`."""
    return running_before(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, by, out, total).drop("__one")


def under_quota(df: DataFrame, size: str, quota: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """Rows that come before their group's quota is used up; the row that crosses it is the last one in."""
    return running_before(df, size, order, by, "__before").filter(F.col("__before") < quota).drop("__before")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; null is a key. Keys meet as (order, key) minima before the join, so no hot key gathers its rows. Rows that are equal in both stay together: `order` tells rows of a key apart."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return _same(df, first, [key, order], "left_semi")


def hashed(on: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from an md5 of seed and key: the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), on.cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)


def valid_split(df: DataFrame, key: str, rate: float = 0.002, most: int = 10_000, seed: int = 0) -> DataFrame:
    """`df` with `valid`: rows whose key's hash is below `rate`, from the smallest on, `most` of them at most.

    As many rows come out as go in. Rows of one key (null is a key) go the same way, so copies never stand on both sides: the
    cut lies before the first hash whose rows would exceed `most`. Only hashes of drawn rows are ordered, in two levels.
    """
    h = F.coalesce(hashed(F.col(key), seed), hashed(F.lit("null"), seed))
    drawn = df.select(h.alias("__h")).filter(F.col("__h") < rate).groupBy("__h").agg(F.count("*").alias("__n"))
    cut = rate
    if (drawn.agg(F.sum("__n")).first()[0] or 0) > most:
        cut = running_before(drawn, "__n", "__h", out="__before").filter(F.col("__before") + F.col("__n") > most).agg(F.min("__h")).first()[0]
    return df.withColumn("valid", h < cut)


def ratio_split(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.95, 0.03, 0.02), seed: int = 0) -> DataFrame:
    """`df` with `split`: train, val and test by hash order (null keys first); cuts are floors, the rest is test. Rows of one key follow each other, and a cut may lie between them."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    placed = dense_rank_of(df.withColumn("_h", (hashed(F.col(key), seed) * 2**48).cast("long")), "_h", "__place")
    n = df.count()
    a, b = int(n * ratios[0]), int(n * ratios[0]) + int(n * ratios[1])
    return placed.withColumn("split", F.when(F.col("__place") < a, "train").when(F.col("__place") < b, "val").otherwise("test")).drop("_h", "__place")


#: Rows that a task holds at most to find the smallest of all.
HELD = 100_000


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows drawn evenly: those of the smallest hashes, null keys first. Up to HELD rows each task keeps the smallest; more are told by their place in the order."""
    drawn = df.withColumn("__h", F.struct(hashed(F.col(key), seed).alias("h"), F.col(key).alias("key")))
    if n <= HELD:
        return drawn.orderBy("__h").limit(n).drop("__h")
    return dense_rank_of(drawn, "__h", "__place").filter(F.col("__place") < n).drop("__h", "__place")


def shuffled(df: DataFrame, key: str, seed: int = 0, buffer: int | None = None, order: str | None = None) -> DataFrame:
    """Rows in hash order, over all or within consecutive buffers of `buffer` rows of `order`."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    if buffer is None:
        return df.withColumn("_h", h).orderBy("_h", key).drop("_h")
    placed = dense_rank_of(df, order, "__place").withColumn("__buffer", F.floor(F.col("__place") / buffer))
    return placed.withColumn("_h", h).orderBy("__buffer", "_h", key).drop("__place", "__buffer", "_h")


def weighted_choice(on: Column, weights: dict[str, float], seed: int = 0) -> Column:
    """One of the names, drawn by hash in proportion to the weights."""
    total, acc, out = sum(weights.values()), 0.0, F.lit(list(weights)[-1])
    bounds = []
    for name, w in weights.items():
        acc += w / total
        bounds.append((name, acc))
    for name, top in reversed(bounds[:-1]):
        out = F.when(hashed(on, seed) < top, name).otherwise(out)
    return out


# ---- shards -------------------------------------------------------------------------------------


#: Ranges whose functions are composed in one task.
TOGETHER = 32


def assign_shards(df: DataFrame, size: str, limit: int, order: str) -> DataFrame:
    """`df` with shard_id (int) by next fit in order: a shard is closed before the row that would overfill it.

    Ranges of the order are summed up, followed and numbered in parallel (see `nextfit`); what is sequential is one function for each
    TOGETHER ranges. As many rows come out as go in: rows of equal order follow each other as they stand in `df`, nulls of
    `order` come first, null and negative sizes count 0, and a row that is larger than a shard has one of its own.
    """
    dealt = df.withColumn("__nth", F.monotonically_increasing_id()).repartitionByRange(order, "__nth").sortWithinPartitions(order, "__nth")
    # in a sorted partition this id is the partition's number and the row's place in it
    cut = materialise(dealt.withColumn("__row", F.monotonically_increasing_id()).drop("__nth"), "ranges")
    spark, part = ship(df.sparkSession), F.shiftright("__row", 33)
    rows = cut.select(part.alias("part"), F.col("__row").alias("row"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0)).alias("n")).repartition("part").sortWithinPartitions("part", "row")
    ranges = lambda batches: _by_part(batches, ("row", "n"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (_, sizes) in ranges(batches):
            yield _function_row(k, nextfit.steps_of(sizes, limit))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for k, f in _functions(batches):
            if at is not None and k // TOGETHER != at:
                yield _function_row(at, held)
                held = None
            held, at = f if held is None else held.then(f, limit), k // TOGETHER
        if at is not None:
            yield _function_row(at, held)

    def follow(groups: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, at, out = nextfit.NOTHING, None, []
            for k, f in _functions(batches):
                if groups is not None and k // TOGETHER != at:
                    at = k // TOGETHER
                    state = entries.value[at]
                out.append((k, *state))
                state = f.enter(limit, *state)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["part", "shards", "fill"])

        return run

    entry, function = "part long, shards long, fill long", "part long, steps binary, whole long"
    each = materialise(rows.mapInArrow(sum_up, function), "functions")
    groups = materialise(each.withColumn("up", F.floor(F.col("part") / TOGETHER)).repartition("up").sortWithinPartitions("up", "part").drop("up").mapInArrow(compose, function), "functions")
    # a row for each TOGETHER ranges, one after another
    first = {r.part: (r.shards, r.fill) for r in groups.coalesce(1).sortWithinPartitions("part").mapInArrow(follow(None), entry).collect()}
    entries = spark.sparkContext.broadcast(first)
    entered = each.withColumn("up", F.floor(F.col("part") / TOGETHER)).repartition("up").sortWithinPartitions("up", "part").drop("up").mapInArrow(follow(list(first)), entry)
    states = spark.sparkContext.broadcast({r.part: (r.shards, r.fill) for r in entered.collect()})  # a row a range

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (ids, sizes) in ranges(batches):
            found = list(nextfit.starts_of(sizes, limit, *states.value[k]))
            at, shard = (np.array(c, np.int64) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(shard)], names=["__row", "__shard"])

    starts = materialise(rows.mapInArrow(begin, "__row long, __shard long"), "starts")  # a row a shard and range
    w = W.partitionBy(part).orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    return cut.join(starts, "__row", "left").withColumn("shard_id", F.last("__shard", ignorenulls=True).over(w).cast("int")).select(*df.columns, "shard_id")


def _by_part(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each part, from batches sorted by `part`: a range of the order is what a task holds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            parts = batch.column("part").to_numpy()
            if held and parts[0] != (at := held[0].column("part")[0].as_py()):
                yield at, [np.concatenate([b.column(c).to_numpy() for b in held]) for c in columns]
                held = []
            n = int(np.searchsorted(parts, parts[0], "right"))
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
    if held:
        yield held[0].column("part")[0].as_py(), [np.concatenate([b.column(c).to_numpy() for b in held]) for c in columns]


def _function_row(k: int, f: nextfit.Steps) -> pa.RecordBatch:
    raw, whole = nextfit.pack(f)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([raw], pa.binary()), pa.array([whole], pa.int64())], names=["part", "steps", "whole"])


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, nextfit.Steps]]:
    for batch in batches:
        for k, raw, whole in zip(*(batch.column(c).to_pylist() for c in ("part", "steps", "whole")), strict=True):
            yield k, nextfit.unpack(raw, whole)


# ---- sequences ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class BlockMap:
    """Where the blocks of a sequence of lists lie: `rows` (by, order, at, n) tells where each row's elements stand among all, in order. A block is at block_id times `stride`; so a map is a row a list, whatever the stride, and blocks are cut from the lists only when they're read."""

    rows: DataFrame
    order: str
    block: int
    stride: int
    by: list[str]

    def counts(self) -> DataFrame:
        """by, blocks: whole blocks of each group."""
        total = F.coalesce(F.max(F.col("at") + F.col("n")), F.lit(0))
        return self.rows.groupBy(*self.by).agg(F.greatest(F.floor((total - self.block) / self.stride) + 1, F.lit(0)).cast("long").alias("blocks"))

    def read(self, df: DataFrame, lists: list[str], names: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """by, block_id, and the blocks first .. last (excluding it; all without them) of `df`'s lists: only rows that they touch are looked up."""
        rows = self.rows
        if first is not None:
            rows = rows.filter(F.col("at") + F.col("n") > first * self.stride)
        if last is not None:
            rows = rows.filter(F.col("at") < (last - 1) * self.stride + self.block)
        placed = _same(df.select(*self.by, self.order, *lists), rows.withColumnsRenamed({"at": "__at", "n": "__n"}), [*self.by, self.order])
        return _sliced(placed, lists, names or lists, self.block, self.stride, self.by, first or 0, last)


def block_map(df: DataFrame, order: str, length: Column, block: int, stride: int | None = None, by: list[str] | None = None) -> BlockMap:
    """The map of lists of these lengths, made from lengths alone. Needs 0 < stride <= block, and an `order` that is unique within a group. Null lengths count 0."""
    stride = stride or block
    if not 0 < stride <= block:
        raise ValueError("stride must be in 1 .. block")
    by = by or []
    sized = df.select(*by, order, F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    placed = running_before(sized, "n", order, by, "at").filter("n > 0")
    return BlockMap(materialise(placed.select(*by, order, "at", "n").sortWithinPartitions(*by, "at"), "blocks"), order, block, stride, by)


def chunks(df: DataFrame, order: str, ids: str | list[str], block: int, stride: int | None = None, by: list[str] | None = None, n_workers: int | None = None) -> DataFrame:
    """by, block_id, and blocks of `block` elements of the rows' lists one after another, every `stride` elements; the tail that fills none is dropped.

    One list column gives input_ids; several of equal lengths give a column each under their own names. Needs
    0 < stride <= block. A row gives each block that it overlaps one slice, and a block joins its few slices.
    Null and empty lists give nothing. With `n_workers` rows are dealt as `workers` deals them, and `worker` is a group. Where blocks overlap twice and more, only those that span lists are shuffled.
    """
    stride = stride or block
    if not 0 < stride <= block:
        raise ValueError("stride must be in 1 .. block")
    by, lists = by or [], [ids] if isinstance(ids, str) else ids
    names = ["input_ids"] if isinstance(ids, str) else lists
    # the lists are written once, with a number for each row; places are told from their lengths alone
    slim = df.select(*by, order, *lists).withColumn("__n", F.greatest(F.size(lists[0]), F.lit(0)).cast("long"))
    held = materialise(slim.withColumn("__id", F.monotonically_increasing_id()), "lists")
    lengths, dealt = held.select(*by, order, "__id", "__n"), ["worker"] if n_workers else []
    if n_workers:
        lengths, by = dense_rank_of(lengths, order, "__place").withColumn("worker", F.pmod("__place", F.lit(n_workers))).drop("__place"), [*by, "worker"]
    places = running_before(lengths, "__n", order, by, "__at").filter("__n > 0").select("__id", "__at", *dealt)
    # the side of places is built, so lists aren't sorted
    whole = held.join(places.hint("shuffle_hash"), "__id")
    if block < 2 * stride:
        return _sliced(whole, lists, names, block, stride, by)
    return _within(whole, lists, names, block, stride, by).unionByName(_across(held, places, lists, names, block, stride, by))


def _within(placed: DataFrame, lists: list[str], names: list[str], block: int, stride: int, by: list[str]) -> DataFrame:
    """Blocks that lie in one list, cut where they are: nothing is shuffled for them."""
    at, end = F.col("__at"), F.col("__at") + F.col("__n")
    first, last = F.ceil(at / stride).cast("long"), F.floor((end - block) / stride).cast("long")
    met = placed.filter(first <= last).withColumn("block_id", F.explode(F.sequence(first, last)))
    begin = (F.col("block_id") * stride - at + 1).cast("int")
    return met.select(*by, "block_id", *[F.slice(c, begin, F.lit(block)).alias(n) for c, n in zip(lists, names, strict=True)])


def _across(held: DataFrame, places: DataFrame, lists: list[str], names: list[str], block: int, stride: int, by: list[str]) -> DataFrame:
    """Blocks that span lists, joined of the lists' ends: of each list its first and last block - 1 elements at most are shuffled."""
    edge = F.least(F.col("__n"), F.lit(block - 1)).cast("int")
    ends = lambda left: F.struct(F.lit(left).alias("left"), (F.lit(0).cast("long") if left else F.col("__n") - edge).alias("off"), *[F.slice(c, F.lit(1) if left else F.size(c) - edge + 1, edge).alias(c) for c in lists])
    own = [c for c in by if c in held.columns]
    cut = held.filter("__n > 0").select(*own, "__id", "__n", F.explode(F.array(ends(True), ends(False))).alias("__e")).select(*own, "__id", "__n", "__e.left", "__e.off", *[F.col("__e")[c].alias(c) for c in lists])
    placed, at, end = cut.join(places, "__id"), F.col("__at"), F.col("__at") + F.col("__n")
    inner = F.ceil(at / stride)  # the first block that begins in the list
    lowest = F.when(F.col("left"), F.greatest(F.floor((at - block) / stride) + 1, F.lit(0))).otherwise(F.greatest(inner, F.floor((end - block) / stride) + 1)).cast("long")
    highest = F.when(F.col("left"), inner - 1).otherwise(F.floor((end - 1) / stride)).cast("long")
    met = placed.filter(lowest <= highest).withColumn("block_id", F.explode(F.sequence(lowest, highest)))
    here = at + F.col("off")
    begin = F.greatest(here, F.col("block_id") * stride)
    length = F.least(here + F.size(lists[0]), F.col("block_id") * stride + block) - begin
    return _joined(met, lists, names, block, by, begin, begin - here + 1, length)


def _sliced(placed: DataFrame, lists: list[str], names: list[str], block: int, stride: int, by: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """Blocks first .. last (excluding it) of lists that stand at __at and have __n elements."""
    at, end = F.col("__at"), F.col("__at") + F.col("__n")
    lowest = F.greatest(F.floor((at - block) / stride) + 1, F.lit(first)).cast("long")
    highest = F.floor((end - 1) / stride).cast("long")
    highest = highest if last is None else F.least(highest, F.lit(last - 1))
    met = placed.filter(lowest <= highest).withColumn("block_id", F.explode(F.sequence(lowest, highest)))
    begin = F.greatest(at, F.col("block_id") * stride)
    length = F.least(end, F.col("block_id") * stride + block) - begin
    return _joined(met, lists, names, block, by, begin, begin - at + 1, length)


def _joined(met: DataFrame, lists: list[str], names: list[str], block: int, by: list[str], begin: Column, start: Column, length: Column) -> DataFrame:
    """Whole blocks of slices: each is `length` elements from `start` on in its row's lists, and stands at `begin` among all."""
    part = F.struct(begin.alias("at"), *[F.slice(c, start.cast("int"), length.cast("int")).alias(n) for c, n in zip(lists, names, strict=True)])
    packed = met.filter(length > 0).select(*by, "block_id", part.alias("part")).groupBy(*by, "block_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = packed.select(*by, "block_id", *[F.flatten(F.col("parts")[n]).alias(n) for n in names])
    return whole.filter(F.size(names[0]) == block)


def dense_windows(df: DataFrame, order: str, ids: str, block: int) -> DataFrame:
    """block_id, x, y: each stride-1 window of block + 1 tokens as inputs and next tokens."""
    w = chunks(df, order, ids, block + 1, 1)
    return w.select("block_id", F.slice("input_ids", 1, block).alias("x"), F.slice("input_ids", 2, block).alias("y"))


def workers(df: DataFrame, order: str, n: int, out: str = "worker") -> DataFrame:
    """`df` with the worker of each row: its place in the order modulo `n`. Blocks are packed by worker."""
    return dense_rank_of(df, order, "__place").withColumn(out, F.pmod("__place", F.lit(n))).drop("__place")


def masked(prompt_ids: Column, answer_ids: Column, bos: int = 2, eos: int = 3, ignore: int = -100) -> Column:
    """struct(input_ids, labels): shifted by one, the prompt's labels masked."""
    full = F.concat(F.array(F.lit(bos)), prompt_ids, answer_ids, F.array(F.lit(eos)))
    n = F.size(full)
    labels = F.transform(F.slice(full, F.lit(2), n - 1), lambda t, i: F.when(i < F.size(prompt_ids), F.lit(ignore)).otherwise(t))
    return F.struct(F.slice(full, F.lit(1), n - 1).alias("input_ids"), labels.alias("labels"))


def batches(df: DataFrame, order: str, size: int, drop_last: bool = False) -> DataFrame:
    """`df` with batch_id."""
    placed = dense_rank_of(df, order, "__place").withColumn("batch_id", F.floor(F.col("__place") / size))
    if drop_last:
        n = df.count()
        placed = placed.filter(F.col("batch_id") < n // size)
    return placed.drop("__place")


def smooth_schedule(weights: list[float], steps: int) -> list[int]:
    """Sources of a smooth weighted round robin; ties go to the first."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    credit, out = [0.0] * len(weights), []
    for _ in range(steps):
        credit = [c + w for c, w in zip(credit, weights, strict=True)]
        k = max(range(len(weights)), key=lambda i: (credit[i], -i))
        credit[k] -= sum(weights)
        out.append(k)
    return out


def mix_streams(df: DataFrame, source: str, order: str, weights: list[float], steps: int) -> DataFrame:
    """`df`'s rows dealt by the smooth schedule of any positive weights, exhausted sources starting over: step and the row. Sources are numbered 0 ...

    Rows of no numbered source take no part; a source without rows gives its steps none.
    """
    deal = schedule(df.sparkSession, weights, steps)
    placed = dense_rank_of(df.filter(F.col(source).between(0, len(weights) - 1)), order, "__place", [source], total="__size")
    sizes = materialise(placed.groupBy(F.col(source).alias("__of")).agg(F.first("__size").alias("__size")), "sizes")
    want = deal.join(F.broadcast(sizes), F.col("source") == F.col("__of"))  # a row a source
    want = want.select("step", F.col("__of"), F.pmod("nth", F.col("__size")).alias("__want"))
    return want.join(placed.drop("__size"), (F.col("__of") == F.col(source)) & (F.col("__want") == F.col("__place"))).drop("__of", "__want", "__place")
