"""Smooth weighted round robin for any weights, in parallel.

Each step adds every source's weight to its credit, takes the source of most credit (the first of equal ones), and takes the sum of
all weights off it. Credits are integers here: weights are taken as the exact fractions that they are, so nothing drifts. After
t steps a source's credit is t times its weight less its uses times the sum; the uses are the whole state.

Stretches of steps are run side by side. Where a stretch begins, the uses are guessed in proportion to the weights, WARM steps earlier;
runs from near states soon go the same way. Then every seam is checked: the uses at which a stretch began must be
those at which the one before it ended, and the first stretch begins at nothing. Stretches that began elsewhere run again from
there, until all seams hold; so the result is exact for any weights, whatever the guesses were worth.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import materialise, ship

#: Steps of a stretch, and steps before it from which its state is guessed.
STRETCH, WARM = 200_000, 2_000


def whole_weights(weights: list[float]) -> list[int]:
    """The weights as integers in exactly the same proportion."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(f.denominator for f in exact))
    out = [int(f * scale) for f in exact]
    common = gcd(*out)
    return [w // common for w in out]


def guess(weights: list[int], step: int) -> list[int]:
    """Uses after so many steps, in proportion; they add up to the steps."""
    total = sum(weights)
    uses = [step * w // total for w in weights]
    behind = sorted(range(len(weights)), key=lambda i: (-(step * weights[i] % total), i))
    for i in behind[: step - sum(uses)]:
        uses[i] += 1
    return uses


def run(weights: list[int], uses: list[int], step: int, n: int) -> Iterator[int]:
    """The sources of `n` steps after `step`, from the uses until then, which are counted on in place."""
    total = sum(weights)
    credit = [step * w - total * u for w, u in zip(weights, uses, strict=True)]
    places = range(len(weights))
    for _ in range(n):
        best = most = None
        for i in places:
            c = credit[i] = credit[i] + weights[i]
            if most is None or c > most:
                best, most = i, c
        credit[best] -= total
        uses[best] += 1
        yield best


def schedule(spark: SparkSession, weights: list[float], steps: int, stretch: int = STRETCH, warm: int = WARM) -> DataFrame:
    """step, source, nth (uses of the source before the step) of all steps."""
    ship(spark)
    w = whole_weights(weights)
    count = max(1, -(-steps // stretch))
    kind = "k long, began array<long>, ended array<long>"

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, began in zip(batch.column("k").to_pylist(), batch.column("began").to_pylist(), strict=True):
                first = k * stretch
                if began is None:
                    early = max(0, first - warm)
                    began = guess(w, early)
                    for _ in run(w, began, early, first - early):
                        pass
                uses = list(began)
                for _ in run(w, uses, first, min(stretch, steps - first)):
                    pass
                rows.append((k, began, uses))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["k", "began", "ended"])

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uses in zip(batch.column("k").to_pylist(), batch.column("began").to_pylist(), strict=True):
                first, sources, nth = k * stretch, [], []
                for s in run(w, uses, first, min(stretch, steps - first)):
                    sources.append(s)
                    nth.append(uses[s] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(sources)), pa.int64()), pa.array(sources, pa.int32()), pa.array(nth, pa.int64())], names=["step", "source", "nth"])

    parts = min(count, 4 * spark.sparkContext.defaultParallelism)
    stretches = spark.range(0, count, 1, parts).select(F.col("id").alias("k"), F.lit(None).cast("array<long>").alias("began"))
    found = materialise(stretches.mapInArrow(tried, kind), "stretches")
    before = F.lag("ended").over(W.orderBy("k"))  # a row a stretch
    while True:
        seams = found.withColumn("due", F.coalesce(before, F.array(*[F.lit(0)] * len(w)).cast("array<long>")))
        wrong = seams.filter("began != due")
        if wrong.isEmpty():
            break
        again = wrong.select("k", F.col("due").alias("began")).repartition(parts).mapInArrow(tried, kind)
        found = materialise(seams.filter("began = due").select("k", "began", "ended").unionByName(again), "stretches")
    return found.select("k", "began").repartition(parts, "k").mapInArrow(said, "step long, source int, nth long")
