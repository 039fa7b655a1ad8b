"""Links: connected components, and comparisons of hot groups in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of `edges` (a long, b long) but the roots: root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes: about log(nodes) rounds, each
    of partial minima and joins over the edges, written to the shared folder. No component is
    gathered anywhere.
    """
    e = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: then both sides of the joins are plain exchanges, and a hub's edges can be split over tasks
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "minima")
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.distinct(), "edges")


def in_blocks(rows: DataFrame, key: str, node: str, limit: int) -> DataFrame:
    """The rows of each group of two or more, dealt for comparison: each pair of a group meets in exactly one (key, i, j).

    A group of more than `limit` rows is cut in blocks of about that many by the node's hash, and every two
    blocks meet in a task's run of their own; `block` tells which of i and j a row is of.
    """
    # written first: then both sides of the join are plain exchanges, and a hot group's rows can be split over tasks
    sizes = materialise(rows.select(key).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1"), "sizes")
    cut = rows.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_n") / limit).cast("int")).withColumn("block", F.pmod(F.hash(F.col(node), F.lit(17)), F.col("_blocks")))
    met = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumn("i", F.least("block", "_with")).withColumn("j", F.greatest("block", "_with")).drop("_n", "_blocks", "_with")
    return met.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by `keys` (longs or ints), with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        cols = [table[k].to_numpy() for k in keys]
        new = np.zeros(len(table), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.r_[0, np.flatnonzero(new)] if len(table) else np.empty(0, np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        bounds = cut(table)
        if len(bounds) > 1:
            yield table.slice(0, bounds[-1]), bounds
            held = table.slice(bounds[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.r_[cut(table), len(table)]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n-1 linked by pairs a, b: the smallest node that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
