import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import instructions, ordered, smooth


def credits(weights, steps):
    """Sources by credits, one step after another."""
    w, out = smooth.whole_weights(weights), []
    credit = [0] * len(w)
    for _ in range(steps):
        credit = [c + x for c, x in zip(credit, w, strict=True)]
        k = credit.index(max(credit))
        credit[k] -= sum(w)
        out.append(k)
    return out


@pytest.mark.parametrize("weights", [[math.pi, 1.0], [2.0, 1.0], [1.0], [0.1, 0.2, 0.3, 0.25, math.e], [1e-3, 5.0, 1e-3], [1.0] * 7])
def test_schedule_of_any_weights(spark, weights):
    want = credits(weights, 3000)
    for stretch, warm in ((250, 40), (999, 0), (10_000, 10)):
        got = smooth.schedule(spark, weights, 3000, stretch, warm).orderBy("step").collect()
        assert [r.source for r in got] == want
        assert all(r.nth == want[: r.step].count(r.source) for r in got[::97])


def test_a_long_schedule_has_its_weights(spark):
    n = 400_000
    got = smooth.schedule(spark, [math.pi, 1.0], n, 50_000).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {0: round(n * math.pi / (1 + math.pi)), 1: round(n / (1 + math.pi))}
    assert smooth.schedule(spark, [1.0, 2.0], 0).count() == 0
    with pytest.raises(ValueError):
        smooth.schedule(spark, [1.0, 0.0], 5)
    assert ordered.smooth_schedule([2, 1, 0.5], 200) == credits([2, 1, 0.5], 200)


def plain(rows, merge, group):
    """For each row (group, order, value) what the rows before it merge to."""
    out, held = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        g = g if group else 0
        xs = held.setdefault(g, [])
        known = [(x, w) for x, w in xs if x is not None]
        out[o] = {
            "sum": sum(x for x, _ in known),
            "min": min((x for x, _ in known), default=None),
            "max": max((x for x, _ in known), default=None),
            "last": known[-1][0] if known else None,
            "argmin": next((w for x, w in known if x == min(k for k, _ in known)), None),
            "argmax": next((w for x, w in known if x == max(k for k, _ in known)), None),
        }[merge]
        xs.append((v, o))
    return out


def test_scans_of_every_merge(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), None if i == 5 else i, rng.choice([None, *range(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    of = F.struct(F.col("v").alias("value"), F.col("o").alias("of"))
    outs = {m: (m, "v") for m in ("sum", "min", "max", "last")} | {"argmin": ("argmin", of), "argmax": ("argmax", of)}
    for by in ([], ["g"]):
        got = {r.o: r for r in ordered.running(df, outs, "o", by).collect()}
        assert len(got) == 300
        for m in outs:
            assert {o: r[m] for o, r in got.items()} == plain(rows, m, bool(by)), m
    assert ordered.running(df.limit(0), outs, "o").count() == 0


def test_best_of_a_whole_log_without_one_window(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([None, 5, 7, 5, 3, None, 4, 2])], "step long, loss double")
    out = instructions.best_so_far(df, "step", "loss")
    got = out.orderBy("step").collect()
    assert [r.best for r in got] == [None, 5, 5, 5, 3, 3, 3, 2]
    assert [r.improved for r in got] == [True, True, False, False, True, None, False, True]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_blocks_by_index(spark):
    rng = random.Random(9)
    lists = [[rng.randrange(1000) for _ in range(rng.choice([0, 1, 3, 40]))] for _ in range(60)]
    rows = [(i, None if i % 13 == 0 else x, "ab"[i % 2]) for i, x in enumerate(lists)]
    df = spark.createDataFrame(rows, "o long, ids array<int>, g string")
    for block, stride, by in ((8, 8, []), (8, 3, []), (5, 1, ["g"])):
        made = ordered.block_map(df.select("o", "g", "ids"), "o", F.size("ids"), block, stride, by)
        assert set(made.rows.columns) == {*by, "o", "at", "n"}, "a map holds no elements"
        key = lambda r: (*[r[c] for c in by], r.block_id)  # noqa: B023, E731
        want = {key(r): r.input_ids for r in ordered.chunks(df, "o", "ids", block, stride, by).collect()}
        assert {key(r): r.ids for r in made.read(df, ["ids"]).collect()} == want
        assert {tuple(r[c] for c in by): r.blocks for r in made.counts().collect()} == {g: sum(k[:-1] == g for k in want) for g in {k[:-1] for k in want}}
        for first, last in ((0, 1), (3, 7), (20, 21), (10**6, 10**6 + 5)):
            assert {key(r): r.ids for r in made.read(df, ["ids"], first=first, last=last).collect()} == {k: v for k, v in want.items() if first <= k[-1] < last}
    with pytest.raises(ValueError):
        ordered.block_map(df, "o", F.size("ids"), 4, 5)
