import numpy as np

from lectern.llm.embedding_dedup import embedding_dedup
from tests.llm.test_dedup import brute_components


def test_embedding_dedup_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = []

    def add(label, v):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label))

    for label in ("a", "b"):
        for _ in range(60):
            add(label, r.standard_normal(16))
        for _ in range(6):
            c = r.standard_normal(16)
            for s in r.random(12):  # around the threshold
                add(label, c + r.standard_normal(16) * s * 0.6)
        same = r.standard_normal(16)
        for k in range(30):
            add(label, same * (1 + k % 3))
    c = r.standard_normal(16)
    for _ in range(80):  # one hot cluster of different vectors
        add("a", c + r.standard_normal(16) * 0.02)
    add("a", None), add("a", []), add("a", [0.0] * 16), add("a", [None] + [1.0] * 15), add("a", [float("nan")] + [1.0] * 15), add("a", [float("inf")] * 16)
    add(None, c), add("a", c * 1e-170), add("a", c * 1e150), add("a", list(c) + [0.0])
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label string, n_links int").repartition(4)
    got = {g.vec_id: g for g in embedding_dedup(df, block=32).collect()}
    links = []
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.max(np.abs(v))
            ok[i] = (label, len(v), x / np.linalg.norm(x))
    for a in ok:
        for b in ok:
            if a < b and ok[a][:2] == ok[b][:2] and ok[a][2] @ ok[b][2] >= 0.93:
                links.append((a, b))
    want = brute_components(links, range(len(rows)))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert len(got) == len(rows)
    assert {i: g.n_links for i, g in got.items()} == dict(enumerate(n))
    assert {i: g.component_id for i, g in got.items()} == want
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())


def test_embedding_dedup_of_nothing_and_null_ids(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup(df).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.1], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup(df).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None")]
