import random
import re

import corpus_pipeline as p
from lectern.llm import mixing
from tests.llm.test_dedup import brute_components, brute_set

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(12)
    vocab = ["w%d" % i for i in range(300)]
    out = []
    for i in range(120):
        t = " ".join(r.choice(vocab) for _ in range(r.choice([1, 20, 80, 400])))
        out.append((i, t + (" nasty nasty" if i % 6 == 0 else ""), "en", r.choice(["a", "a", "a", "b", None])))
    base = " ".join(r.choice(vocab) for _ in range(200))
    for i in range(200, 215):
        w = base.split()
        w[r.randrange(200)] = "edit%d" % i
        out.append((i, " ".join(w), "en", "b"))
    out += [(300 + i, out[1][1], "en", "b") for i in range(5)] + [(400, None, None, None), (401, "", "en", "a"), (402, " \n", "en", "a"), (300, out[1][1], "en", "b")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame(rows(), COLUMNS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(120)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = p.materialise(p.drop_toxic(spark, docs, str(tmp_path)), "t")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in rows() if "nasty" not in (r[1] or "")}

    single = p.materialise(p.drop_copies(spark, kept, str(tmp_path)), "t")
    got = single.collect()
    by = {}
    for r in kept.collect():
        by[r.text or ""] = max(by.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in got) == sorted(by.values()) and single.columns == docs.columns

    apart = p.materialise(p.drop_near_copies(spark, single, str(tmp_path)), "t")
    sets = [(r.doc_id, brute_set(r.text)) for r in got]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    roots = brute_components(links, [a for a, _ in sets])
    left = apart.collect()
    assert sorted(r.doc_id for r in left) == sorted(i for i, root in roots.items() if i == root)

    mix = p.materialise(p.mix_sources(spark, apart, str(tmp_path)), "t")
    assert mix.schema == docs.schema
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {}
    for r in mix.collect():
        assert r.n_chars == len(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + size(r.text)
    report = {r.doc_id: r for r in mixing.mix_report(apart).collect()}
    assert taken == {i: r.taken for i, r in report.items() if r.taken}

    last = p.encode(spark, mix, str(tmp_path)).collect()
    assert len(last) == mix.count() and all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
