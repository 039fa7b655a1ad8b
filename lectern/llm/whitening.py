"""Whitening of embeddings by merged singular value decompositions.

Each partition keeps a summary of its vectors: their number, exact sums, and the singular values and right singular vectors
of the vectors less their mean, all of them. Two summaries merge by stacking both (values times vectors), appending one row that corrects
for the distance of their means, sqrt(n1 n2 / (n1 + n2)) (m1 - m2), and decomposing the stack again: the
result is the decomposition of all their vectors together, with nothing left out. Partitions merge within
tasks batch by batch, then in groups of FANIN, level by level, each level written; a summary is as large as the
square of the dimension, whatever the number of vectors. Covariances are never formed from raw squares.

Entries are taken as integers, floor(scale * entry) + shift, so sums are exact, and means are told from them.

The whitened vectors' own covariance is summed up the same way (number, mean and centred products of partitions, merged
pairwise), as a check that reads all vectors again.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or entries beyond 2**40 / scale, are left out, and so are
vectors of another length than most have (of equally frequent ones the longest stays); components without variance (singular value below the longest's
rounding error) aren't returned, so equal vectors or a single one give no rows; ids may be null or repeat; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.worker import lean
from lectern.session import materialise, ship

#: Summaries that merge in one task, vectors of a block that is decomposed, and the largest absolute entry.
FANIN, BLOCK, LARGEST = 16, 4096, 2.0**40
_ROW = "at long, n long, sums array<long>, part binary"


def integers(vectors: pa.Array, dim: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be used, and those as integers."""
    lists = vectors.cast(pa.list_(pa.float64()))
    sized = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim
    at = np.flatnonzero(sized)
    flat = lists.take(pa.array(at)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    good = (np.abs(flat) <= LARGEST / scale).all(axis=1)  # not a number compares as false
    return at[good], np.floor(scale * flat[good]).astype(np.int64) + shift


# ---- summaries ----------------------------------------------------------------------------------

#: number, exact sums, and singular values times right singular vectors of what is centred
Summary = tuple[int, np.ndarray, np.ndarray]


def _again(rows: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _mean_gap(a: int, sums_a: np.ndarray, b: int, sums_b: np.ndarray) -> np.ndarray:
    """mean(a) - mean(b); whole parts first, so long sums lose nothing."""
    qa, ra = np.divmod(sums_a, a)
    qb, rb = np.divmod(sums_b, b)
    return (qa - qb) + (ra / a - rb / b)


def summary(x: np.ndarray) -> Summary:
    """Of integer vectors, a row each."""
    n, sums = len(x), x.sum(axis=0)
    q, r = np.divmod(sums, n)
    return n, sums, _again((x - q) - r / n)


def merged(a: Summary, b: Summary) -> Summary:
    n = a[0] + b[0]
    gap = np.sqrt(a[0] * (b[0] / n)) * _mean_gap(a[0], a[1], b[0], b[1])
    return n, a[1] + b[1], _again(np.vstack([a[2], b[2], gap]))


def _row(at: int, s: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([s[0]]), pa.array([s[1].tolist()], pa.list_(pa.int64())), pa.array([s[2].astype("<f8").tobytes()], pa.binary())], names=["at", "n", "sums", "part"])


def _unrow(batch: pa.RecordBatch) -> Iterator[tuple[int, Summary]]:
    for at, n, sums, part in zip(*(batch.column(c).to_pylist() for c in ("at", "n", "sums", "part")), strict=True):
        yield at, (n, np.array(sums, np.int64), np.frombuffer(part, "<f8").reshape(-1, len(sums)))


def _merge_all(rows: DataFrame, merge: Callable[[Summary, Summary], Summary]) -> Summary | None:
    """The summary of all rows (at, n, sums, part): groups of FANIN neighbours merge, level by level, until one is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, -1
        for batch in batches:
            for k, s in _unrow(batch):
                if k // FANIN != at and held is not None:
                    yield _row(at, held)
                    held = None
                held, at = s if held is None else merge(held, s), k // FANIN
        if held is not None:
            yield _row(at, held)

    rows = materialise(rows, "summaries")
    while (most := rows.agg(F.max("at")).first()[0] or 0) > 0:
        groups = rows.withColumn("up", F.floor(F.col("at") / FANIN)).repartition(-(-(most + 1) // FANIN), "up").sortWithinPartitions("at").drop("up")
        rows = materialise(groups.mapInArrow(lean("whitening", run), _ROW), "summaries")
    found = rows.first()
    return None if found is None else (found["n"], np.array(found["sums"], np.int64), np.frombuffer(bytes(found["part"]), "<f8").reshape(-1, len(found["sums"])))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: float, shift: int, column: str = "vector") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            at, x = integers(part.column(column), dim, scale, shift)
            if len(at):
                yield part, at, x


# ---- whitening ----------------------------------------------------------------------------------


class Whitening:
    """n, sums, mean, and the components: rows of `axes`, by falling `variance`; `share` of all variance."""

    def __init__(self, fit: Summary, scale: float, shift: int, most: int | None = None):
        self.n, self.sums, rows = fit
        self.scale, self.shift = scale, shift
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        variance = s**2 / self.n
        kept = s > s.max(initial=0.0) * max(len(self.sums), 2) * np.finfo(float).eps * 8
        kept = np.flatnonzero(kept)[:most]
        self.axes, self.variance, self.share = v[kept], variance[kept], variance[kept] / variance.sum() if len(kept) else variance[kept]

    def _centred(self, x: np.ndarray) -> np.ndarray:
        q, r = np.divmod(self.sums, self.n)
        return (x - q) - r / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors."""
        return self._centred(x) @ self.axes.T / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - sums)**2) of each vector, exactly; null beyond 63 bits."""
        far = int(np.abs(x).max()) * self.n + int(np.abs(self.sums).max())
        if far < 2**62:
            d = self.n * x - self.sums
            if int(np.abs(d).max()) ** 2 * d.shape[1] < 2**63:
                return (d * d).sum(axis=1).tolist()
        wide = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return [w if w < 2**63 else None for w in wide]


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, components: int | None = None) -> Whitening | None:
    """Fit on all usable vectors; None where there are none."""
    ship(vectors.sparkSession)
    sizes = vectors.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).filter("dim > 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim = sizes.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (summary(x) for _, _, x in _blocks(batches, dim, scale, shift))
        whole = reduce(lambda a, b: b if a is None else merged(a, b), parts, None)
        if whole is not None:
            yield _row(TaskContext.get().partitionId(), whole)

    found = _merge_all(vectors.select(F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(lean("whitening", run), _ROW), merged)
    return None if found is None else Whitening(found, scale, shift, components)


def _products(a: Summary, b: Summary) -> Summary:
    """Summaries whose part holds the mean and the centred products: both merged."""
    n = a[0] + b[0]
    gap = b[2][0] - a[2][0]
    return n, a[1], np.vstack([a[2][0] + gap * (b[0] / n), a[2][1:] + b[2][1:] + np.outer(gap, gap) * (a[0] * (b[0] / n))])


def identity_error(vectors: DataFrame, w: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, from the vectors themselves."""
    shared = ship(vectors.sparkSession).sparkContext.broadcast(w)  # at most dimension x components
    dim = len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for _, _, x in _blocks(batches, dim, shared.value.scale, shared.value.shift):
            y = shared.value.apply(x)
            mean = y.mean(axis=0)
            part = len(y), np.zeros(y.shape[1], np.int64), np.vstack([mean, (y - mean).T @ (y - mean)])
            whole = part if whole is None else _products(whole, part)
        if whole is not None:
            yield _row(TaskContext.get().partitionId(), whole)

    n, _, part = _merge_all(vectors.select(F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(lean("whitening", run), _ROW), _products)
    return float(np.abs(part[1:] / n - np.eye(part.shape[1])).max())


def whitened(vectors: DataFrame, w: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, deviation, whitened (array) of each usable row."""
    spark: SparkSession = ship(vectors.sparkSession)
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = "id long, deviation long, whitened array<double>"
    if w is None or not len(w.axes):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(w)  # at most dimension x components
    dim = len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, at, x in _blocks(batches, dim, m.scale, m.shift):
            y = m.apply(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(m.deviation(x), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return plain.mapInArrow(lean("whitening", run), schema).withColumnRenamed("id", id_col)


def report(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error."""
    w = fit(vectors, vector_col, components=components)
    out = whitened(vectors, w, id_col, vector_col)
    error = identity_error(vectors, w, vector_col) if w is not None and len(w.axes) else 0.0
    shares = F.array(*[F.lit(float(s)) for s in (w.share if w else ())]).cast("array<double>")
    each = out.select(id_col, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(id_col, (F.col("k") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
