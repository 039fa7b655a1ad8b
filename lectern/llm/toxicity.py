"""Toxic texts by a convolutional classifier over hashed word embeddings.

A word's vector is the sum of hashed embeddings of the word and of its first three to six characters,
so inflected and compound forms share what they begin with. Filters of widths 1, 2 and 3 run over the words of a whole text;
each filter's maximum, rectified, feeds a logistic unit. It's trained in numpy with word-level dropout by
Adagrad; gradients reach only the words where a filter has its maximum. Of the labelled rows at most MAX_TRAIN of
each label fit the net, those with the smallest hashes of their ids; a fifth of them is kept apart. The decision is placed
by all labelled rows that may train and didn't fit it: the raw score of best F1 becomes a score of 0.7, and each language with
enough of such rows gets a threshold of its own. Where there are more than MAX_TRAIN of a label, they're scored in Spark and
counted by language, score bin and label; a count stands for the rows of its label (and language) that fit the net, too.
Language, source, ids and labels are no inputs of a score; the language only picks the threshold of
`rejected`.

Defined cases: null and empty texts are scored like a text without words; of rows
that repeat a labelled id the one with the smallest text trains; an id that is labelled both ways doesn't; labels of ids without a document count for nothing; training texts after the first
MAX_TRAIN_BYTES of all in order of hashes are left out; with no labelled rows, or one label only, the score is that label's share, pulled to the middle; unlabelled rows and null labels don't train; rows that
repeat an id are scored one by one; a null language takes the general threshold; an empty table gives no rows; other columns
are kept by `score` and ignored by `toxicity`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shingles import chunks
from lectern.llm.worker import lean
from lectern.session import materialise, ship

#: Labelled texts of each label that train at most; embedding rows; their width; filters of each width.
MAX_TRAIN, ROWS, WIDE, FILTERS, WIDTHS = 1500, 1 << 15, 12, 8, (1, 2, 3)
#: Bytes of their texts together.
MAX_TRAIN_BYTES = 64 << 20
#: Score at which a text counts as toxic, and texts of a language that its own threshold needs.
DECISION, LEAST_OF_LANGUAGE = 0.7, 60
#: Texts that are worked on together, which bounds memory.
TOGETHER = 64
#: Words that a worker remembers.
REMEMBERED = 300_000
_WORD = re.compile(r"\w+")
_PARTS, _FIFTH = 5, 5
#: Bins of a raw score's unit, and where they end.
BINS, END = 50, 1500


def _hashes(word: str) -> tuple[int, ...]:
    """Rows of the embedding table: the word's, and those of what it begins with (row 0, zeros, where it's shorter)."""
    b = word.encode("utf-8", "replace")
    return (zlib.crc32(b) % (ROWS - 1) + 1, *(zlib.crc32(b"^" + word[:k].encode("utf-8", "replace")) % (ROWS - 1) + 1 if len(word) >= k else 0 for k in (3, 4, 5, 6)))


class Vocabulary:
    """Numbers of words, and the embedding rows of each number."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, _PARTS), np.int32)

    def number(self, texts: list[str | None], keep: bool = False) -> list[np.ndarray]:
        """Word numbers of each text; with `keep`, numbers given before stay good."""
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        new = {w for ws in words for w in ws if w not in self.known}
        if not keep and len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for ws in words for w in ws}
        first = len(self.known)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self.rows) // 2 + len(new), _PARTS), np.int32)])
        for i, w in enumerate(sorted(new)):
            self.known[w] = first + i
            self.rows[first + i] = _hashes(w)
        return [np.fromiter(map(self.known.__getitem__, ws), np.int32, len(ws)) for ws in words]


@dataclass
class Net:
    """The classifier: embeddings, filters, output weights, calibration."""

    e: np.ndarray
    w: np.ndarray  # embedding width, one column for each filter and place
    b: np.ndarray
    v: np.ndarray
    c: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int) -> Net:
        r = np.random.default_rng(seed)
        e = r.normal(0, 0.3, (ROWS, WIDE)).astype(np.float32)
        e[0] = 0
        n = FILTERS * len(WIDTHS)
        return cls(e, r.normal(0, 0.4, (WIDE, FILTERS * sum(WIDTHS))).astype(np.float32), np.full(n, -0.3, np.float32), r.normal(0.3, 0.1, n).astype(np.float32), -1.0)

    def pooled(self, texts: list[np.ndarray], rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum over a text (where: and its place); a text of fewer words than a filter is wide is padded with zeros."""
        pad = max(WIDTHS) - 1
        out = np.zeros((len(texts), len(self.b)), np.float32)
        places = np.full((len(texts), len(self.b)), -1, np.int64)
        held = [i for i, t in enumerate(texts) if len(t)]
        if not held:
            return out, places
        used, flat = np.unique(np.concatenate([texts[i] for i in held]), return_inverse=True)
        p = np.vstack([self.e[rows[used]].sum(axis=1) @ self.w, np.zeros((1, self.w.shape[1]), np.float32)])
        lengths = np.array([len(texts[i]) for i in held])
        starts = np.r_[0, np.cumsum(lengths + pad)[:-1]]
        line = np.full(int((lengths + pad).sum()), len(used), np.int64)
        line[np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(flat))] = flat
        at = col = 0
        for k in WIDTHS:
            n = len(line) - pad
            a = np.zeros((n, FILTERS), np.float32)
            for j in range(k):
                a += p[line[j : j + n], col : col + FILTERS]
                col += FILTERS
            for i, (s, length) in enumerate(zip(starts, lengths, strict=True)):
                part = a[s : s + max(1, length - k + 1)]
                if where:
                    top = part.argmax(axis=0)
                    places[held[i], at : at + FILTERS] = top
                    out[held[i], at : at + FILTERS] = part[top, np.arange(FILTERS)]
                else:
                    out[held[i], at : at + FILTERS] = part.max(axis=0)
            at += FILTERS
        return out, places

    def raw(self, texts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Scores before calibration, some texts at a time."""
        parts = [np.zeros((0, len(self.b)), np.float32), *(self.pooled(texts[i : i + TOGETHER], rows)[0] for i in range(0, len(texts), TOGETHER))]
        return np.maximum(np.concatenate(parts) + self.b, 0) @ self.v + self.c

    def score(self, texts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts, rows).astype(np.float64) * self.scale + self.shift, -30, 30)))


def _start(net: Net, nums: list[np.ndarray], rows: np.ndarray, y: np.ndarray) -> None:
    """Begin where word presence alone leads: one embedding column holds shrunk log odds, and the first filter reads it."""
    seen = np.zeros((2, ROWS))
    for t, k in zip(nums, y, strict=True):
        seen[k, np.unique(rows[t])] += 1
    n = np.bincount(y, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    both = seen.sum(axis=0)
    net.e[:, 0] = np.clip(odds * both / (both + 4), -1.5, 3)
    net.e[:, 1:] *= 0.3
    net.e[0] = 0
    net.w[0, :] = 0
    net.w[0, 0] = 1
    net.w[1:, 0] = 0
    top = np.concatenate([net.pooled(nums[i : i + TOGETHER], rows)[0][:, 0] for i in range(0, len(nums), TOGETHER)])
    cut = _best_cut(top.astype(float), y)
    net.b[0], net.v[0], net.c = 1 - cut, 1.5, -1.5


def _apart(texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """Which texts are kept apart; none, if a label would be missing there or among the others."""
    apart = np.array([zlib.crc32((t or "").encode("utf-8", "replace")) % _FIFTH == 0 for t in texts])
    if len({*y[~apart]}) < 2 or len({*y[apart]}) < 2:
        apart[:] = False
    return apart


def train(texts: list[str | None], y: np.ndarray, langs: list[str | None], seed: int = 3, steps: int = 250, batch: int = 48) -> Net:
    """Fit, then calibrate on a fifth kept apart."""
    net, vocab, y = Net.new(seed), Vocabulary(), np.asarray(y, int)
    if not len(y) or y.min() == y.max():
        net.e[:] = 0
        net.v[:] = 0
        share = (y.sum() + 1) / (len(y) + 2)
        net.c = float(np.log(share / (1 - share)))
        return net
    texts, nums = list(texts), []
    while len(nums) < len(texts):  # numbers are small beside words
        nums += vocab.number(texts[len(nums) : len(nums) + TOGETHER], keep=True)
    r = np.random.default_rng(seed)
    apart = _apart(texts, y)
    fit = [np.flatnonzero((y == k) & ~apart) for k in (0, 1)]
    _start(net, [nums[i] for f in fit for i in f], vocab.rows, np.concatenate([y[f] for f in fit]))
    g = {k: np.full_like(getattr(net, k), 0.1) for k in ("e", "w", "b", "v")}
    gc = 0.1
    n_f, starts = len(net.b), np.cumsum([0, *(FILTERS * k for k in WIDTHS)])
    for step in range(steps):
        rate = 0.05 * (1 - step / steps) + 0.002
        pick = np.concatenate([r.choice(f, batch // 2) for f in fit])
        some = [nums[i] for i in pick]
        some = [t[r.random(len(t)) > 0.2] if len(t) > 5 else t for t in some]
        m, places = net.pooled(some, vocab.rows, where=True)
        z = np.maximum(m + net.b, 0)
        drop = (r.random(z.shape) > 0.25) / 0.75
        logit = (z * drop) @ net.v + net.c
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / batch
        dv = (z * drop).T @ d + 1e-4 * net.v
        dz = d[:, None] * net.v * drop * (z > 0)
        db = dz.sum(axis=0)
        dw = 1e-5 * net.w
        touched, grads = [], []
        for f in range(n_f):
            k = WIDTHS[f // FILTERS]
            docs = np.flatnonzero(dz[:, f])
            for j in range(k):
                col = starts[f // FILTERS] + j * FILTERS + f % FILTERS
                live = [i for i in docs if places[i, f] + j < len(some[i])]
                if not live:
                    continue
                rows = vocab.rows[[some[i][places[i, f] + j] for i in live]]
                dw[:, col] += net.e[rows].sum(axis=1).T @ dz[live, f]
                touched.append(rows.ravel())
                grads.append(np.repeat(dz[live, f][:, None] * net.w[:, col][None], _PARTS, axis=0))
        if touched:
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            de = np.zeros((len(rows), WIDE), np.float32)
            np.add.at(de, inverse, np.concatenate(grads))
            de += 2e-5 * net.e[rows]
            g["e"][rows] += de**2
            net.e[rows] -= rate * de / np.sqrt(g["e"][rows])
            net.e[0] = 0
        for name, grad in (("w", dw), ("b", db), ("v", dv)):
            g[name] += grad**2
            getattr(net, name)[...] -= rate * grad / np.sqrt(g[name])
        gc += d.sum() ** 2
        net.c -= float(rate * d.sum() / np.sqrt(gc))
    _calibrate(net, [n for n, a in zip(nums, apart, strict=True) if a or not apart.any()], vocab.rows, y[apart] if apart.any() else y, [x for x, a in zip(langs, apart, strict=True) if a or not apart.any()])
    return net


def _best_cut(s: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among cuts of best F1."""
    order = np.argsort(-s)
    s, y = s[order], y[order]
    hit, all_ = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * hit / (all_ + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    after = np.append(s[1:], s[-1] - 2)
    k = best[np.argmax(s[best] - after[best])]
    return float((s[k] + after[k]) / 2)


def _best_cut_of_bins(bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """`_best_cut` over counts n of bins (bin k: raw scores from k / BINS) and labels."""
    order = np.unique(bins)[::-1]
    at = np.searchsorted(-order, -bins)
    hit, all_ = (np.cumsum(np.bincount(at, n * w, len(order))) for w in (y, np.ones(len(y))))
    f1 = 2 * hit / (all_ + hit[-1])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    low = order / BINS
    after = np.append((order[1:] + 1) / BINS, low[-1] - 2)
    k = best[np.argmax(low[best] - after[best])]
    return float((low[k] + after[k]) / 2)


def _calibrate_all(net: Net, rows: DataFrame) -> None:
    """Decision and thresholds from all labelled rows: lang, raw, y, and whether a row `fitted` the net."""
    place = F.greatest(F.least(F.floor(F.col("raw") * BINS), F.lit(END)), F.lit(-END)).cast("int").alias("bin")
    counts = materialise(rows.groupBy("lang", place, "y", "fitted").agg(F.count("*").alias("n")), "toxicity")

    def cut(found: pd.DataFrame, least: int, toxic: int) -> float | None:
        free = found[~found["fitted"]]
        y, n = free["y"].to_numpy(), free["n"].to_numpy(float)
        have = np.bincount(y, n, 2)
        if have.sum() < least or have[1] < toxic or not have.all():
            return None
        every = np.bincount(found["y"].to_numpy(), found["n"].to_numpy(float), 2)
        return _best_cut_of_bins(free["bin"].to_numpy(), y, n * (every / have)[y])

    general = cut(counts.groupBy("bin", "y", "fitted").agg(F.sum("n").alias("n")).toPandas(), 2, 1)
    if general is None:
        return
    net.scale, net.shift, net.thresholds = 1.0, float(np.log(DECISION / (1 - DECISION)) - general), {}
    many = counts.filter("NOT fitted AND lang <> ''").groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("y")).alias("toxic")).filter((F.col("all") >= LEAST_OF_LANGUAGE) & (F.col("toxic") >= LEAST_OF_LANGUAGE // 4))
    for lang, found in counts.join(many.select("lang"), "lang", "left_semi").toPandas().groupby("lang"):
        mine = cut(found, LEAST_OF_LANGUAGE, LEAST_OF_LANGUAGE // 4)
        if mine is not None:
            net.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(mine + net.shift, -30, 30))))


def _calibrate(net: Net, nums: list[np.ndarray], rows: np.ndarray, y: np.ndarray, langs: list[str | None]) -> None:
    raw = net.raw(nums, rows)
    cut = _best_cut(raw, y)
    net.shift = float(np.log(DECISION / (1 - DECISION)) - cut * net.scale)
    score = net.score(nums, rows)
    of = np.array([x or "" for x in langs])
    for lang in np.unique(of):
        mine = of == lang
        if lang and y[mine].sum() >= LEAST_OF_LANGUAGE // 4 and mine.sum() >= LEAST_OF_LANGUAGE:
            logit = np.log(score[mine] / (1 - score[mine]))
            net.thresholds[lang] = float(1 / (1 + np.exp(-_best_cut(logit, y[mine]))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Net:
    """Train on labelled rows where `usable` (over the id) holds; at most `max_train` of each label."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    named = named.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    named = named.withColumnRenamed("id", id_col).filter(usable).withColumnRenamed(id_col, "id").withColumn("h", F.xxhash64("id"))
    few = named.filter("y = 1").orderBy("h", "id").limit(max_train).unionByName(named.filter("y = 0").orderBy("h", "id").limit(max_train))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(few), "id")
    one = rows.groupBy("id").agg(F.min(F.struct("h", "id", "text", "lang", "y")).alias("r")).select("r.*")
    # bounded: max_train of each label, one row of an id however often it repeats, and MAX_TRAIN_BYTES of texts
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy("h", "id").rowsBetween(W.unboundedPreceding, 0))
    got = one.withColumn("held", held).filter(F.col("held") <= MAX_TRAIN_BYTES).orderBy("h", "id").collect()
    texts, y = [r.text for r in got], np.array([r.y for r in got], int)
    net = train(texts, y, [r.lang for r in got])
    if len({*y}) == 2 and not named.groupBy("y").count().filter(F.col("count") > max_train).isEmpty():
        away = _apart(texts, y).any()
        free = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(_FIFTH)) == 0 if away else F.lit(False)
        plain = docs.filter(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        # scored before the join, which then deals numbers and no texts
        raw = score(plain, net, "text", "raw", raw=True).select("id", "lang", "raw", free.alias("free"))
        marked = named.select("id", "y").join(F.broadcast(few.select("id", F.lit(True).alias("few"))), "id", "left")
        _calibrate_all(net, raw.join(marked, "id").select("lang", "raw", "y", (F.col("few").isNotNull() & ~F.col("free")).alias("fitted")))
    return net


def score(docs: DataFrame, net: Net, text_col: str = "text", score_col: str = "score", raw: bool = False) -> DataFrame:
    """The rows of `docs` with a score between 0 and 1 (raw: before calibration)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(net)  # ROWS x WIDE floats: 1.6 MB whatever the input

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab, model = Vocabulary(), shared.value  # a task's own: what it holds goes when the task ends
        for texts in batches:
            out = np.zeros(len(texts))
            xs = texts.tolist()
            for part in chunks(xs):
                out[part.start : part.stop] = (model.raw if raw else model.score)(vocab.number([xs[i] for i in part]), vocab.rows)
            yield pd.Series(out)

    return docs.withColumn(score_col, F.pandas_udf(lean("toxicity", of), "double")(F.col(text_col)))


def rejected(net: Net, score_col: str = "score", lang_col: str = "lang") -> Column:
    """Whether a text counts as toxic by its language's threshold."""
    least = F.lit(DECISION)
    for lang, t in sorted(net.thresholds.items()):
        least = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(least)
    return F.col(score_col) >= least


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: id_col, held_out, score, predicted, toxic (by its language's threshold)."""
    net = fit(docs, labels, ~held_out(id_col), max_train, id_col, text_col, lang_col=lang_col)
    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = score(plain, net)
    return out.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), rejected(net).alias("toxic"))
