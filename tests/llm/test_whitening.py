import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import whitening

NAN, INF = float("nan"), float("inf")


def vectors(n, dim, seed=1):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dim)) * np.linspace(3, 0.5, dim) + r.standard_normal(dim)).tolist()


def expected(rows, most):
    """rows: (id, vector) that are usable."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return {i: (d, w) for (i, _), d, w in zip(rows, far, centred @ u / np.sqrt(e), strict=True)}, e / np.trace(centred.T @ centred / n)


def run(spark, rows, most=32, parts=7):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("whitened", F.lit("in the way")).withColumn("vector", F.lit(1)).repartition(parts)
    return whitening.report(df, most).collect()


def compare(got, rows, most):
    want, shares = expected(rows, most)
    assert len(got) == len(rows) * len(shares)
    mine = {i: np.zeros(len(shares)) for i, _ in rows}
    for r in got:
        mine[r.vec_id][r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == want[r.vec_id][0]
        assert abs(r.explained - shares[r.component - 1]) <= 1e-10 and r.identity_error < 1e-9
    a, b = np.array([mine[i] for i in want]), np.array([w for _, w in want.values()])
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-8


@pytest.mark.parametrize(("n", "dim", "most", "parts"), [(300, 5, 32, 7), (200, 40, 32, 40), (90, 3, 2, 1)])
def test_equals_one_decomposition(spark, n, dim, most, parts):
    rows = list(enumerate(vectors(n, dim)))
    compare(run(spark, rows, most, parts), rows, most)


def test_what_is_left_out(spark):
    good = list(enumerate(vectors(60, 4)))
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, NAN, 2.0, 3.0]), (103, [1.0, INF, 2.0, 3.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 1.0, 1.0, 1.0])]
    compare(run(spark, good + bad), good, 32)


def test_no_variance_and_no_rows(spark):
    assert run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(i, [0.5, 0.5]) for i in range(9)]) == []
    assert run(spark, [(1, None)]) == [] and whitening.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    flat = [(i, [float(i), 7.0, 2.0 * i]) for i in range(20)]  # one direction of variance
    got = run(spark, flat)
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 3.0]), (2, [5.0, 1.0])]
    got = run(spark, rows)
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == ["1", "1", "2", "None"]


def test_merging_keeps_all_that_sums_hold():
    r = np.random.default_rng(3)
    x = r.integers(10**12, 10**12 + 1000, (500, 6))
    parts = [whitening.summary(p) for p in np.array_split(x, 9)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.merged(whole, p)
    n, sums, rows = whole
    exact = x - x.sum(axis=0).astype(object) // 1 / 500
    want = np.linalg.svd(np.array(exact, float), compute_uv=False)
    assert n == 500 and (sums == x.sum(axis=0)).all() and np.allclose(np.linalg.svd(rows, compute_uv=False), want, rtol=1e-6)


def test_deviation_beyond_a_long():
    w = whitening.Whitening(whitening.summary(np.array([[0], [2**41]])), 64.0, 0)
    assert w.deviation(np.array([[0], [2**41]])) == [None, None]
    w = whitening.Whitening(whitening.summary(np.array([[0], [2**20]])), 64.0, 0)
    assert w.deviation(np.array([[0], [2**20]])) == [2**40, 2**40]
