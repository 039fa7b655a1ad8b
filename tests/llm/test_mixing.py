import random
import re

import numpy as np
import pytest

from lectern.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest, all_w = total - sum(out.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / all_w >= most * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / all_w for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    for seed in range(3):
        assert sorted(mixing.permuted(np.arange(n), n, seed, 5).tolist()) == list(range(n))


def test_quotas_give_the_target_in_words():
    r = random.Random(3)
    for _ in range(400):
        size, block = r.randrange(1, 3000), r.choice([1, 7, 64, 256])
        target = r.random() * 3 * size
        blocks, slots, cut = mixing.quotas(size, target, block, 1, 4, 3)
        given, uses = 0, np.zeros(blocks, int)
        for k in range(slots):
            b = int(mixing.permuted(np.array([k % blocks]), blocks, 1, 4, k // blocks)[0])
            words = min(block, size - b * block) - (cut if k == slots - 1 else 0)
            assert words > 0
            uses[b] += 1
            given += words
        assert given == round(target) and uses.max(initial=0) <= 3


def test_shard_counts_add_up_and_look_random():
    totals = np.array([5000, 0, 123, 20_000, 1])
    shards, per = 7, 4096
    got = [mixing.shard_counts(totals, shards, s, per, 9) for s in range(shards)]
    assert (sum(h for h, _ in got) == totals).all()
    run = np.zeros(5, np.int64)
    for h, before in got:
        assert (before == run).all() and h.sum() <= per
        run += h
    assert len({tuple(h) for h, _ in got[:-1]}) > 1
    assert abs(got[0][0][3] / per - 20_000 / totals.sum()) < 0.05


def rows():
    r = random.Random(8)
    out = [(0, None, "a"), (1, "", "b"), (2, " \n", None), (3, "x y", "B"), (3, "x y", "B"), (None, "p q r", "é")]
    for i in range(300):
        src = r.choice(["hot"] * 6 + ["b", None, "tiny"[: 1 + i % 4]])
        out.append((10 + i, " ".join("w%d" % i for _ in range(r.choice([0, 1, 5, 50, 700]))), src))
    out.append((999, "z " * 30_000, "hot"))
    return out


def test_mix_against_brute_force(spark):
    docs = spark.createDataFrame([(*x, 1) for x in rows()], "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(7)).collect()
    pack = lambda xs: sorted(map(str, xs))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    assert pack((g.doc_id, g.size, g.source_size) for g in got) == pack((i, size(t), sizes[s]) for i, t, s in rows())
    assert pack((g.doc_id, g.size, g.taken) for g in again) == pack((g.doc_id, g.size, g.taken) for g in got)
    by_id = {i: s for i, _, s in rows()}
    taken = {}
    for g in got:
        s = by_id[g.doc_id]
        assert g.target == pytest.approx(want[s]) and 0 <= g.taken <= 3 * g.size
        taken[s] = taken.get(s, 0) + g.taken
    assert taken == {s: round(t) for s, t in want.items()}


def test_blocks_of_the_mix(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    m = mixing.Mix(docs, per_shard=64)
    slots = m.slots.collect()
    keys = [(s.shard, s.slot) for s in slots]
    assert len(set(keys)) == len(keys) and max(k[1] for k in keys) < 64
    assert {s.shard for s in slots} == set(range(-(-len(slots) // 64)))
    spans = {}
    for p in m.pieces.collect():
        spans.setdefault((p.src, p.block), []).append((p.off, p.off + p.words))
    for s in spans.values():  # pieces of a block lie end to end
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][1] <= mixing.BLOCK


def test_mix_of_nothing(spark):
    assert mixing.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_a_permutation_is_undone():
    for n in (1, 2, 3, 10, 1000, 12345):
        k = np.arange(n)
        p = mixing.permuted(k, n, 3, 4)
        assert sorted(p) == list(k) and (mixing.permuted(p, n, 3, 4, back=True) == k).all()


def test_draws_of_large_numbers_follow_the_law():
    r = np.random.default_rng(3)
    for good, bad, draws in ((3 * 10**9, 5 * 10**9, 10**6), (2 * 10**9, 10**6, 10**9), (10**3, 4 * 10**9, 10**9), (5 * 10**9, 10**9, 6 * 10**9 - 50)):
        x = np.array([mixing.hypergeometric(r, good, bad, draws) for _ in range(4000)])
        p, n = good / (good + bad), good + bad
        sd = np.sqrt(draws * p * (1 - p) * (n - draws) / (n - 1))
        assert abs(x.mean() - draws * p) < 5 * sd / np.sqrt(len(x)) + 1e-9 and abs(x.std() / sd - 1) < 0.08
        assert (x >= max(0, draws - bad)).all() and (x <= min(good, draws)).all()
