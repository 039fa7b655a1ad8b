import random
import zlib

import numpy as np

from lectern.llm import toxicity


def corpus():
    r = random.Random(6)
    vocab = ["w%dx" % i for i in range(500)]
    bad = {"en": ["idiotic", "rubbish"], "de": ["schlimmer", "schlimmes", "schlimmen"]}
    rows, labels = [], []
    for i in range(900):
        lang = r.choice(["en", "de"])
        ws = [r.choice(vocab) for _ in range(r.choice([1, 8, 60, 300]))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(3):
                ws.insert(r.randrange(len(ws) + 1), r.choice(bad[lang]) + r.choice(["", "", ".", "!"]))
        rows.append((i, " ".join(ws).capitalize(), lang))
        if i % 4:
            labels.append((i, int(toxic)))
    truth = dict(labels)
    return rows, labels, truth


def test_held_out_accuracy_and_what_a_score_depends_on(spark):
    rows, labels, truth = corpus()
    rows += [(2001, None, "en"), (2002, "", None), (2003, " \n", "xx"), (None, "idiotic rubbish", "en"), (5, rows[5][1], "en"), (2004, "idiotic " + "fine " * 40_000, "en")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    away = [(g.predicted, g.toxic, truth[g.doc_id]) for g in got if g.held_out and g.doc_id in truth]
    assert np.mean([p == y for p, _, y in away]) > 0.97 and np.mean([t == y for _, t, y in away]) > 0.97
    # labels of held-out rows, languages and ids of scored rows change nothing
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    again = {g.doc_id: g.score for g in toxicity.toxicity(docs, other).collect()}
    assert again == {g.doc_id: g.score for g in got}


def test_scores_of_whole_texts_equal_a_plain_convolution():
    rows, _, _ = corpus()
    net, v = toxicity.Net.new(1), toxicity.Vocabulary()
    texts = [t for _, t, _ in rows[:60]] + ["", None, "one", "one two"]
    nums = v.number(texts)
    got = net.score(nums, v.rows)
    for t, s in zip(nums, got, strict=True):
        x = net.e[v.rows[t]].sum(axis=1) if len(t) else np.zeros((0, toxicity.WIDE))
        pooled, col = [], 0
        for k in toxicity.WIDTHS:
            places = max(1, len(t) - k + 1)
            padded = np.vstack([x, np.zeros((3, toxicity.WIDE))])
            a = sum(padded[j : j + places] @ net.w[:, col + j * toxicity.FILTERS : col + (j + 1) * toxicity.FILTERS] for j in range(k))
            pooled.append(a.max(axis=0) if len(t) else np.zeros(toxicity.FILTERS))
            col += k * toxicity.FILTERS
        z = np.maximum(np.concatenate(pooled) + net.b, 0) @ net.v + net.c
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-4


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 1 and 0.3 < got[0].score < 0.7
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_thresholds_come_from_all_labelled_rows(spark):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(docs, known, ~toxicity.held_out(), max_train=60)  # a fifth of 120 rows is too little for a language
    assert set(net.thresholds) == {"en", "de"}
    got = toxicity.score(docs, net).withColumn("toxic", toxicity.rejected(net)).collect()
    assert np.mean([g.toxic == truth[g.doc_id] for g in got if g.doc_id in truth]) > 0.9


def test_cut_of_bins_equals_the_cut_of_scores():
    r = np.random.default_rng(2)
    for _ in range(50):
        bins, y = r.integers(-40, 40, 30), r.integers(0, 2, 30)
        y[:2] = 0, 1
        cut = toxicity._best_cut_of_bins(bins, y, np.ones(30))
        f1 = lambda c: 2 * y[bins >= c * toxicity.BINS - 1e-9].sum() / ((bins >= c * toxicity.BINS - 1e-9).sum() + y.sum())  # noqa: B023, E731
        assert abs(f1(cut) - max(f1(b / toxicity.BINS) for b in bins)) < 1e-9


def test_a_repeated_id_pushes_no_label_out(spark, monkeypatch):
    labels = [(i, i % 2) for i in range(40)]
    hashed = spark.createDataFrame(labels, "doc_id long, y int").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()
    first = hashed[0].doc_id
    rows = [(i, f"text {i}", "en") for i, _ in labels] + [(first, f"copy {k}", "en") for k in range(200)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, langs: seen.append((texts, list(y))) or toxicity.Net.new(1))
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.F.lit(True), max_train=20)
    texts, y = seen[0]
    assert len(texts) == 40 and sum(y) == 20 and [t for t in texts if t.startswith("copy")] == ["copy 0"]


def test_labels_that_contradict_or_have_no_document(spark, monkeypatch):
    rows = [(i, f"text {i}", "en") for i in range(20)]
    labels = [(i, i % 2) for i in range(20)] + [(3, 0), (4, 0)] + [(i, 1) for i in range(100, 160)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, langs: seen.append((sorted(texts), sum(y))) or toxicity.Net.new(1))
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.F.lit(True), max_train=12)
    assert seen == [(sorted(f"text {i}" for i in range(20) if i != 3), 9)]
