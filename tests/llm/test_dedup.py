import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, near_dedup, shingles
from lectern.llm.exact_dedup import FuseFilter
from lectern.llm.graph import components


def brute_components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_set(text, n=5):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1)))


def corpus():
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one  two"), (6, "É a b"), (7, "é a b")]
    base = [r.choice(vocab) for _ in range(120)]
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    for i in range(60):  # edits of one text: some pairs above the threshold, some below
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((200 + i, " ".join(w)))
    for i in range(40):  # a chain
        rows.append((300 + i, " ".join(vocab[i * 2 : i * 2 + 100])))
    rows += [(400 + i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 200)))) for i in range(60)]
    rows.append((500, " ".join(r.choice(vocab) for _ in range(60_000))))
    rows.append((500, rows[-1][1]))
    return rows


def test_fuse_filter_has_no_false_negatives_and_few_false_positives():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = r.integers(0, 2**63, n).astype(np.uint64)
        f = FuseFilter.build(keys)
        assert f.holds(keys).all()
        others = r.integers(0, 2**63, 100_000).astype(np.uint64)
        assert f.holds(others).sum() < 30
        assert len(f.prints) <= max(64, 1.6 * n)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_against_brute_force(spark, weak):
    rows = [(i, t, i) for i, t in corpus()] + [(7, "é a b", 1), (None, "only null id", 2), (None, "one two", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    digest = (lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1).cast("string"))) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(docs, exact_dedup.in_first_half(), digest=digest, broadcast_groups=0 if weak else 1000).collect()
    by = {}
    for i, t, _ in rows:
        by.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    want = sorted((str(i), str(max((x for x in by[t or ""] if x is not None), default=None)), len(by[t or ""])) for i, t, _ in rows)
    assert sorted((str(g.doc_id), str(g.keep_id), g.group_size) for g in got) == want
    assert sum(g.kept for g in got) == len({(t or "") for _, t, _ in rows})


def test_a_batch_much_larger_than_its_snapshot(spark, tmp_path):
    digest = exact_dedup.sha256(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("digest")
    named = lambda first, last: spark.range(first, last).select(digest, F.lit(1).cast("long").alias("n"), F.col("id").alias("top"))
    snapshot = exact_dedup.Snapshot.write(named(0, 40), str(tmp_path / "s"))
    batch = named(20, 3000)
    said = snapshot.screen(batch, digests_a_task=10)
    assert said.count() == 2980 and 20 <= said.filter("maybe").count() < 30
    got = exact_dedup.merge_batch(snapshot, batch, digests_a_task=10)
    assert {(r.n, r.top) for r in got.collect()} == {(1, i) for i in (*range(20), *range(40, 3000))} | {(2, i) for i in range(20, 40)}
    assert got.count() == 3000


def test_exact_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(docs, exact_dedup.in_first_half()).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 4000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(links, {x for ab in links for x in ab})
    assert got == {k: v for k, v in want.items() if k != v}


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    for n in (1, 3, 50, 2000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.r_[a[: n // 2], r.integers(0, 2**63, n - n // 2).astype(np.uint64)]
        s = shingles.sketches([a, b, a[::-1], np.empty(0, np.uint64)], 512)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s[0] == s[2]).all() and (s[:3] < 2**63).all()
        assert abs((s[0] == s[1]).mean() - j) < 0.1


def test_shingle_sets_equal_brute_force():
    texts = [t for _, t in corpus()]
    sets = shingles.shingle_sets([shingles.words(t.encode() if t else None) for t in texts])
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    for i in range(0, len(texts), 7):
        for k in range(0, len(texts), 11):
            assert len(np.intersect1d(sets[i], sets[k])) == len(brute_set(texts[i]) & brute_set(texts[k]))


def test_near_dedup_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = near_dedup.near_dedup(docs, percent=85, block=16).collect()
    sets = [(i, brute_set(t)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = brute_components(links, {i for i, _ in rows})
    assert len(got) == len(rows)
    assert {g.doc_id: g.component_id for g in got} == want
    assert {g.doc_id: g.n_shingles for g in got} == {i: len(s) for i, s in sets}
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(9, a), (9, b), (9, b), (4, a + " more"), (7, b + " more"), (8, "apart from all of these others")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=85).collect()
    assert sorted((g.doc_id, g.component_id) for g in got) == [(4, 4), (7, 4), (8, 8), (9, 4), (9, 4), (9, 4)]


def test_long_words_and_long_texts():
    long, texts = "x" * 1_000_000, []
    texts = [f"{long} a b c d e", f"{long[1:]} a b c d e", f"{long} a b c d e", "w " * 300_000 + "end", None, ""]
    sets = shingles.shingle_sets([shingles.words(t.encode() if t else None) for t in texts])
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    assert len(np.intersect1d(sets[0], sets[1])) == 1 and (sets[0] == sets[2]).all()


def test_near_dedup_of_nothing_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_dedup(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_dedup(docs).collect())
    assert got == [("1", "1", True), ("2", "2", True), ("None", "None", True)]
