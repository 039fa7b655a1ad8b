"""Near-duplicate vectors by p-stable hashing and exact cosines.

Vectors are normalised. Each of TABLES tables hashes a vector with HASHES quantised random projections,
floor((a . x + b) / WIDTH) with Gaussian a, and buckets it by (table, group, all its cells). Only
vectors of one group (label and dimension) can meet. Equal vectors of a group are a class
that counts its rows, so copies never meet in a bucket. The classes of a bucket are compared by
blocks with exact double-precision cosines. A pair that meets in several tables counts in the first one
alone, which both sides' cells tell, so no list of pairs is sorted or made distinct: a block gives
each vector's number of new links and a spanning forest of them.

At cosine 0.93 (distance 0.374) a projection agrees with probability 0.85, a table with 0.28, and all
28 tables miss a pair with probability 1e-4; at 0.96 with 1e-6. Unrelated vectors share a table with
probability 0.003.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label, link with nothing; so do rows with a null id (component_id null, kept true); rows that
share an id are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import components, forest, in_blocks, whole_groups
from lectern.llm.shingles import mix
from lectern.llm.worker import lean
from lectern.session import materialise, ship

TABLES, HASHES, WIDTH = 28, 8, 2.0
#: Classes of a block.
BLOCK = 1500


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([7, dim])
    return r.standard_normal((dim, TABLES * HASHES)), r.random(TABLES * HASHES) * WIDTH


def _cells(unit: np.ndarray) -> np.ndarray:
    """A 64-bit cell of each vector in each table."""
    a, b = _projections(unit.shape[1])
    q = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), TABLES, HASHES)
    h = np.broadcast_to(np.arange(TABLES, dtype=np.uint64), (len(unit), TABLES)).copy()
    for k in range(HASHES):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) ^ q[:, :, k], k)
    return h.view(np.int64)


def _unit(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, grp, vector as bytes of doubles (null where it links with nothing)."""
    for batch in batches:
        out = []
        for x in batch.column("vector").to_pylist():
            v = np.array([np.nan if c is None else c for c in x], np.float64) if x else np.empty(0)
            v = v + 0.0  # -0.0 and 0.0 are one value
            most = np.abs(v).max(initial=0.0)
            if np.isfinite(most) and most and not 1e-100 < most < 1e100:  # squares of extreme lengths leave the range of doubles
                v = v / most
            out.append(v.astype("<f8").tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], names=["id", "label", "vector"])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and table: the bucket is a hash of group, table and cells."""
    for batch in batches:
        lengths = np.array([len(v) for v in batch.column("vector").to_pylist()])
        for n in np.unique(lengths):
            for part in np.array_split(np.flatnonzero(lengths == n), max(1, np.count_nonzero(lengths == n) // 1000)):
                rows = batch.take(pa.array(part))
                group = rows.column("grp").to_numpy().view(np.uint64)
                cells = mix(_cells(_unit(rows.column("vector"))).view(np.uint64) ^ mix(group)[:, None], 3)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[:, t].view(np.int64)), pa.array(np.full(len(part), t, np.int32)), rows.column("grp"), rows.column("node"), rows.column("n"), rows.column("vector")],
                        names=["bucket", "tbl", "grp", "node", "n", "vector"],
                    )


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["bucket", "i", "j"]):
            i, j, block, tbl, node, n = (table[c].to_numpy() for c in ("i", "j", "block", "tbl", "node", "n"))
            grp = table["grp"].to_numpy()
            nodes, links, tos = [], [], []
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                if last - first < 2:
                    continue
                at = np.arange(first, last)
                unit = _unit(table["vector"].slice(first, last - first))
                left = at if i[first] == j[first] else at[block[at] == i[first]]
                right = at if i[first] == j[first] else at[block[at] == j[first]]
                if not len(left) or not len(right):
                    continue
                near = (unit[left - first] @ unit[right - first].T) >= least
                if i[first] == j[first]:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                a, b = left[a], right[b]
                ok = (grp[a] == grp[b]) & (node[a] != node[b])
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                cells = _cells(unit)
                new = np.ones(len(a), bool)
                for t in range(tbl[first]):  # they met in an earlier table
                    new &= cells[a - first, t] != cells[b - first, t]
                a, b = a[new], b[new]
                if not len(a):
                    continue
                count = np.zeros(last - first, np.int64)
                np.add.at(count, a - first, n[b])
                np.add.at(count, b - first, n[a])
                root = forest(a - first, b - first, last - first)
                hit = np.flatnonzero(count)
                nodes.append(node[hit + first])
                links.append(count[hit])
                tos.append(node[root[hit] + first])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, tos)], names=["node", "links", "to"])

    return run


def embedding_dedup(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """Per row: id_col, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = materialise(plain.mapInArrow(lean("embedding_dedup", _usable), "id long, label string, vector binary"), "vectors")
    can = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    keyed = rows.withColumn("k1", F.when(can, F.xxhash64("label", "vector"))).withColumn("k2", F.when(can, F.xxhash64(F.lit(1), "vector", "label")))
    groups = keyed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("vector").alias("vector"))
    classes = materialise(groups.withColumn("grp", F.xxhash64("label", F.length("vector"))), "classes")
    met = in_blocks(classes.select("grp", "node", "n", "vector").mapInArrow(lean("embedding_dedup", _bucketed), "bucket long, tbl int, grp long, node long, n long, vector binary"), "bucket", "node", block)
    found = materialise(met.select("bucket", "i", "j", "block", "tbl", "grp", "node", "n", "vector").mapInArrow(lean("embedding_dedup", _linked(least)), "node long, links long, to long"), "links")
    same_id = keyed.filter("k1 IS NOT NULL").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("nodes")).filter("a != b").select("a", F.explode("nodes").alias("b")).filter("a != b")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")).unionByName(same_id))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "n", "node").join(links, "node", "left").join(roots, "node", "left")
    named = named.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    out = keyed.select("id", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
