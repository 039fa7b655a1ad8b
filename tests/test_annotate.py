import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import annotate as A
from lectern.functions import tokens as K
from lectern.operators import annotation

WORDS = ['"', "\\", "{", "}", "[", "]", '\\"', "\\\\", "\\n", "\n", "\r\n", " ", "  ", "`", "~", "```", "````", "```json", "~~~", "~~~~", "~~~x", "word", ":", "a\nb", "\n ", "\t", "3", "~ ", "`x"]


def one_by_one(tokens):
    """Depth and state before each token, a token at a time."""
    quote, stack, fences, begins, out = "out", [], [], True, []
    for i, t in enumerate(tokens):
        if quote == "escape" or quote == "in" and t in A.ESCAPES:
            state = A.JSON_ESCAPE
        elif quote == "in":
            state = A.JSON_STRING
        elif stack:
            state = {"{": A.JSON_OBJECT, "[": A.JSON_ARRAY}[stack[-1]]
        else:
            state = {0: A.PLAIN if begins else A.MD_TEXT, 1: A.MD_OUTER}.get(len(fences), A.MD_INNER)
        out.append((min(len(stack) + len(fences), A.MAX_DEPTH), state))
        bare = t.strip()
        if begins and bare[:1] in ("`", "~") and bare:
            c, run = bare[0], bare
            if bare == c:  # single characters next to each other make one fence
                run = ""
                for u in tokens[i:]:
                    if not u.strip() or set(u.strip()) != {c}:
                        break
                    run += u.strip()
            n = len(run) - len(run.lstrip(c))
            if n >= 3:
                if not run.strip(c) and fences and fences[-1][0] == c and n >= fences[-1][1]:
                    del fences[-1]
                else:
                    fences.append((c, n))
        if quote == "escape":
            quote = "in"
        elif quote == "in":
            quote = {"\\": "escape", '"': "out"}.get(t, "in")
        elif t == '"':
            quote = "in"
        elif t in ("{", "["):
            stack.append(t)
        elif t in ("}", "]"):
            del stack[-1:]
        if "\n" in t:
            begins = not t.split("\n")[-1].strip()
        elif bare:
            begins = False
    return [d for d, _ in out], [s for _, s in out]


def cut(rng, tokens):
    """Pieces whose first token doesn't go on with a fence."""
    can = [k for k in range(1, len(tokens)) if not set(tokens[k].strip()) or not set(tokens[k].strip()) <= set("`~")]
    at = sorted(rng.sample(can, min(len(can), rng.randrange(5))))
    return [tokens[a:b] for a, b in zip([0, *at], [*at, len(tokens)], strict=True)]


def test_compositions_equal_one_by_one():
    rng = random.Random(4)
    for _ in range(2500):
        texts = [[rng.choice(WORDS) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 4))]
        at = np.r_[0, np.cumsum([len(t) for t in texts])]
        depth, state = A.Batch([x for t in texts for x in t], at).annotate()
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert (depth[a:b].tolist(), state[a:b].tolist()) == one_by_one(t), t


def test_pieces_compose():
    rng = random.Random(5)
    for _ in range(1500):
        tokens = [rng.choice(WORDS) for _ in range(rng.randrange(40))]
        parts = cut(rng, tokens)
        at = np.r_[0, np.cumsum([len(p) for p in parts])]
        effects = A.Batch(tokens, at).effects()
        entry = [A.START]
        for e in effects:
            entry.append(e.on(entry[-1]))
        depth, state = A.Batch(tokens, at).annotate(entry[:-1])
        assert (depth.tolist(), state.tolist()) == one_by_one(tokens), parts
        assert reduce(A.Effect.then, effects).on(A.START) == entry[-1]
        if len(effects) > 2:  # in any order of merging
            assert effects[0].then(effects[1].then(effects[2])) == effects[0].then(effects[1]).then(effects[2])


def test_a_text_of_many_brackets_and_of_none():
    assert A.annotate(["["] * 50)[0] == [*range(33), *[32] * 17] and A.annotate([]) == ([], [])


def test_long_texts_in_pieces(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice([*WORDS, "long " * 5]) for _ in range(200)) for _ in range(20)] + [None, "", "no-break" * 300, "x\n```\n" * 40]
    rows = spark.createDataFrame([(None if i % 6 == 0 else i % 9, t) for i, t in enumerate(texts)], "k long, text string")
    tokens = {t: [r for r in spark.createDataFrame([(t,)], "t string").select(K.tokenise(F.col("t")).alias("x")).first().x] for t in texts if t}
    got = annotation.annotate_texts(rows, "k", chars=30).collect()
    flat = sorted((str(r.k), t, d, s) for r in got for t, d, s in zip(r.tokens, r.depth, r.state, strict=True))
    assert flat == sorted((str(r.k), t, d, s) for r in rows.collect() if r.text for t, d, s in zip(tokens[r.text], *one_by_one(tokens[r.text]), strict=True))
    assert max(r.piece for r in got) > 10


@pytest.mark.parametrize("most", [K.BROADCAST_TOKENS, 3])
def test_encoding_and_decoding_by_lookup_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(K, "BROADCAST_TOKENS", most)
    voc = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("<bos>", 2), ("<eos>", 3), ("a", 4), ("b", 5), ("{", 6)], "token string, token_id int")
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (None, ["a", "?"]), (None, None), (2, []), (3, ["{", "?", "a"])], "k long, tokens array<string>")
    ids = K.encode(rows, voc, "k")
    assert sorted((str(r.k), r.ids) for r in ids.collect()) == [("1", [2, 4, 5, 3]), ("1", [2, 5, 3]), ("2", [2, 3]), ("3", [2, 6, 1, 4, 3]), ("None", [2, 3]), ("None", [2, 4, 1, 3])]
    assert sorted((str(r.k), r.text) for r in K.decode(ids, voc, "k").collect()) == [("1", "ab"), ("1", "b"), ("2", ""), ("3", "{<unk>a"), ("None", ""), ("None", "a<unk>")]
    said = {str(r.k): (r.depth_ids, r.state_ids) for r in K.annotate_ids(ids, voc, "k").collect() if r.k in (2, 3)}
    assert said == {"2": ([0, 0], [0, 0]), "3": ([0, 0, 0, 1, 0], [0, 0, 0, 1, 0])}
