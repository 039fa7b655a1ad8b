"""Near-duplicate texts by fast similarity sketches, banding and exact verification.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit key of
   its word sequence, band hashes of a fast similarity sketch, and a byte of each coordinate. Documents
   of one word sequence are a class, which stands for them from here on, so copies never meet in a
   bucket. The texts of classes that share a bucket with others, and no more, are written once.
2. Classes that share a band are candidates. In a first pass each class meets the first one of each of
   its buckets, then its most similar partner in another component: at most as many pairs as
   bucket entries, whatever a bucket's size, which joins most of a hot group. Each pair is confirmed on the
   full shingle sets of both texts: 100 * intersection >= percent * union.
3. Classes of a bucket that are still apart, though their sketches don't rule the threshold out (SLACK standard
   deviations below it), meet in blocks of the bucket that carry their texts, unless they met in the bucket of an
   earlier band. There all such pairs are confirmed on full sets, and a block gives a spanning forest of the
   links, not the links.

Connected components are found without gathering any.

With BANDS x ROWS = 25 x 5 a pair at similarity 0.85 shares no band with probability 4e-7, one at 0.80 with
5e-5; a sketch of 125 coordinates at 0.85 has a standard deviation of 0.032.

Defined cases: null text has no words; texts without words have an empty set and link with nothing; a
text of fewer words than a shingle is one shingle; rows that share an id are one node, so their links add up;
a null id links with nothing (component_id null, kept true); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.llm.graph import components, forest, in_blocks, whole_groups
from lectern.llm.shingles import chunks, key, mix, shingle_sets, sketches, words
from lectern.llm.worker import lean
from lectern.session import materialise, ship

BANDS, ROWS = 25, 5
#: Standard deviations below the threshold from which a sketch rules a pair out (about 3e-7 of true pairs at 5).
SLACK = 5.0
#: Classes of a block, in a bucket that is compared in blocks.
BLOCK = 500
#: Ids of texts to fetch (16 bytes each) that are broadcast at most; beyond it the join shuffles.
BROADCAST_IDS = 50_000
#: Shingles that a task remembers of the texts it has met.
REMEMBERED = 1 << 21

_SIGNED = "id long, tie long, k1 long, k2 long, n_shingles long, bands array<long>, signature binary"


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks(texts):
                ws = [words(texts[i]) for i in part]
                sets = shingle_sets(ws, n)
                s = sketches(sets, BANDS * ROWS)
                bands = np.empty((len(sets), BANDS), np.uint64)
                for b in range(BANDS):
                    h = np.full(len(sets), b + 1, np.uint64)
                    for r in range(ROWS):
                        h = mix(h * np.uint64(0x9DDFEA08EB382D69) ^ s[:, b * ROWS + r], b)
                    bands[:, b] = h
                small = (mix(s) >> np.uint64(56)).astype(np.uint8)
                keys = [key(w) for w in ws]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(part.start, len(part)),
                        batch.column("tie").slice(part.start, len(part)),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, np.int32), bands.reshape(-1).view(np.int64)),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    names=["id", "tie", "k1", "k2", "n_shingles", "bands", "signature"],
                )

    return run


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _least_agreement(percent: int) -> int:
    t, j = BANDS * ROWS, percent / 100
    return int(np.floor(t * j - SLACK * np.sqrt(t * j * (1 - j))))


def _close(percent: int):
    least = _least_agreement(percent)

    @F.pandas_udf(BooleanType())
    def close(a, b):
        import pandas as pd

        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (a, b))
        return pd.Series(_agreement(x, y) >= least)

    return close


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[np.ndarray, np.ndarray, bool]]]]:
    """Tables of whole groups, and for each group the rows that meet: left, right, and whether they're the same rows."""
    for table, bounds in whole_groups(batches, ["band", "i", "j"]):
        i, j, block = (table[c].to_numpy() for c in ("i", "j", "block"))
        found = []
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            at, inside = np.arange(first, last), i[first] == j[first]
            left = at if inside else at[block[at] == i[first]]
            right = at if inside else at[block[at] == j[first]]
            if len(left) and len(right) and last - first > 1:
                found.append((left, right, inside))
        yield table, found


def _scores(table: pa.Table, least: int):
    """For rows x and y of one bucket: agreement of their sketches, -1 where they're of one component, below `least`, or met in an earlier band's bucket."""
    root, band = table["root"].to_numpy(), table["band"].to_numpy()
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(table), -1)
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), BANDS)
    place = (bands == band[:, None]).argmax(axis=1) if len(table) else band

    def of(x: np.ndarray, y: np.ndarray, once: bool = True) -> np.ndarray:
        s = _agreement(sig[x][:, None, :], sig[y][None, :, :])
        out = (s < least) | (root[x][:, None] == root[y][None, :])
        for t in range(place[x[0]] if once and len(x) else 0):
            out |= bands[x, t][:, None] == bands[y, t][None, :]
        s[out] = -1
        return s

    return of


def _apart(percent: int):
    """For each class of a bucket its most similar partner in another component, unless the sketches rule it out: a pair a class and bucket at most."""
    least = _least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _meetings(batches):
            node, scores = table["node"].to_numpy(), _scores(table, least)
            xs, ys = [], []
            for left, right, inside in groups:
                top, of = np.full(len(right), -1, np.int64), np.zeros(len(right), np.int64)
                for k in range(0, len(left), 32):
                    x = left[k : k + 32]
                    s = scores(x, right)
                    to = s.argmax(axis=1)
                    ok = s[np.arange(len(x)), to] >= 0
                    xs.append(node[x[ok]])
                    ys.append(node[right[to[ok]]])
                    more = s.max(axis=0) > top
                    top[more], of[more] = s.max(axis=0)[more], x[s.argmax(axis=0)[more]]
                if not inside:
                    xs.append(node[of[top >= 0]])
                    ys.append(node[right[top >= 0]])
            if xs:
                x, y = np.concatenate(xs), np.concatenate(ys)
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _pending(percent: int):
    """The classes of a bucket that have a partner in another component there which the sketches don't rule out."""
    least = _least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _meetings(batches):
            scores, hit = _scores(table, least), np.zeros(len(table), bool)
            for left, right, _ in groups:
                for k in range(0, len(left), 32):
                    s = scores(left[k : k + 32], right) >= 0
                    hit[left[k : k + 32]] |= s.any(axis=1)
                    hit[right] |= s.any(axis=0)
            yield pa.RecordBatch.from_arrays([table[c].filter(pa.array(hit)).combine_chunks() for c in ("band", "node", "root")], names=["band", "node", "root"])

    return run


def _settle(percent: int, n: int):
    """Links among all classes of a bucket that are pending, confirmed on full sets: a spanning forest of them."""
    least = _least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _meetings(batches):
            node, scores = table["node"].to_numpy(), _scores(table, least)
            for left, right, inside in groups:
                rows = left if inside else np.r_[left, right]
                sets = shingle_sets([words(t) for t in table["text"].take(pa.array(rows)).to_pylist()], n)
                sizes = np.array([len(x) for x in sets])
                _, number = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.r_[0, np.cumsum(sizes)]
                r0 = 0 if inside else len(left)
                others, bounds, mark = number[starts[r0] :], starts[r0:-1] - starts[r0], np.zeros(number.max(initial=0) + 1, np.int64)
                a, b = [], []
                for k in range(0, len(left), 32):
                    close = scores(left[k : k + 32], right) >= 0
                    for x in np.flatnonzero(close.any(axis=1)):
                        own = number[starts[k + x] : starts[k + x + 1]]
                        mark[own] = 1
                        both = np.add.reduceat(mark[others], bounds)
                        mark[own] = 0
                        y = np.flatnonzero(close[x] & (100 * both >= percent * (sizes[k + x] + sizes[r0:] - both)))
                        a.append(np.full(len(y), k + x))
                        b.append(y + r0)
                if a and sum(map(len, a)):
                    root = forest(np.concatenate(a), np.concatenate(b), len(rows))
                    moved = np.flatnonzero(root != np.arange(len(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows[moved]]), pa.array(node[rows[root[moved]]])], names=["a", "b"])

    return run


def _confirm(percent: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            ok = np.zeros(len(a), bool)
            for part in chunks([x + y for x, y in zip(ta, tb, strict=True)]):
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                fresh = {c: t for i in part for c, t in ((a[i], ta[i]), (b[i], tb[i])) if c not in known}
                sets = shingle_sets([words(t) for t in fresh.values()], n)
                known.update(zip(fresh, sets, strict=True))
                held += sum(map(len, sets))
                for i in part:
                    x, y = known[a[i]], known[b[i]]
                    if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok[i] = 0 < both and 100 * both >= percent * (len(x) + len(y) - both)
            m = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(m), batch.column("b").filter(m)], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, percent: int = 80, words_a_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: id_col, n_shingles, component_id, kept, and the word sequence's key k1, k2."""
    ship(docs.sparkSession)
    own = lambda run: lean("near_dedup", run)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    signed = materialise(plain.mapInArrow(own(_sign(words_a_shingle)), _SIGNED), "signed")
    sequences = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    # equal words have equal bands and sketches: copies become one row before the exchange
    grouped = sequences.groupBy("k1", "k2").agg(F.min(F.struct("id", "tie")).alias("first"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = materialise(grouped.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "first.id", "first.tie", "bands", "signature"), "classes")
    entries = classes.select("node", F.explode("bands").alias("band"))
    # written first: then both sides of the join are plain exchanges, and a hot band's rows can be split over tasks
    lows = materialise(entries.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("band", "lo"), "lows")
    shared = materialise(entries.join(lows, "band").distinct(), "shared")
    met = materialise(classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "id", "tie", "signature", "bands"), "met")
    wanted = met.select("node", "id", "tie")
    wanted = F.broadcast(wanted) if met.count() <= BROADCAST_IDS else wanted
    texts = materialise(plain.join(wanted, ["id", "tie"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return materialise(both.select("a", "b", "ta", "tb").mapInArrow(own(_confirm(percent, words_a_shingle)), "a long, b long"), "links")

    def meeting(entries: DataFrame, *more: str) -> DataFrame:
        return in_blocks(entries, "band", "node", block).select("band", "i", "j", "block", "node", "root", "signature", "bands", *more)

    def apart() -> DataFrame:
        """Entries of buckets whose classes are of several components."""
        rest = shared.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        mixed = materialise(rest.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("band"), "mixed")
        return rest.join(mixed, "band", "left_semi").join(met.select("node", "signature", "bands"), "node")

    sig = met.select(F.col("node").alias("a"), F.col("signature").alias("sa")), met.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    stars = shared.filter("node != lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    close = stars.join(sig[0], "a").join(sig[1], "b").filter(_close(percent)("sa", "sb")).select("a", "b")
    # rows that share an id are one document: their classes are linked
    several = sequences.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).filter("x != y").select("id")
    of_id = sequences.select("id", "k1", "k2").join(several, "id").distinct().join(classes.select("k1", "k2", "node"), ["k1", "k2"])
    same_id = materialise(of_id.groupBy("id").agg(F.min("node").alias("a"), F.collect_set("node").alias("nodes")).select("a", F.explode("nodes").alias("b")).filter("a != b"), "same-id")
    roots = components(confirmed(materialise(close, "pairs")).unionByName(same_id))
    linked = lambda more: components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = linked(confirmed(materialise(meeting(apart()).mapInArrow(own(_apart(percent)), "a long, b long").distinct(), "pairs")))
    pending = materialise(meeting(apart()).mapInArrow(own(_pending(percent)), "band long, node long, root long").distinct(), "pending")
    held = pending.join(met.select("node", "signature", "bands"), "node").join(texts, "node")
    roots = linked(materialise(meeting(held, "text").mapInArrow(own(_settle(percent, words_a_shingle)), "a long, b long"), "links"))

    # the smallest id of each component of several classes; a root is a node of its component without a row in `roots`
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    low = materialise(members.join(classes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("low")), "low")
    return _named(signed, classes, roots, low, id_col)


def _named(signed: DataFrame, classes: DataFrame, roots: DataFrame, low: DataFrame, id_col: str) -> DataFrame:
    """Each row with the smallest id of its component."""
    of = classes.select("k1", "k2", F.col("id").alias("least"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(low, "root", "left")
    of = of.select("k1", "k2", F.coalesce("low", "least").alias("least"))
    out = signed.select("id", "k1", "k2", "n_shingles").join(of, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "k1", "k2")
