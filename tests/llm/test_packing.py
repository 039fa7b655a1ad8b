import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.encode import ByteEncoder

FILE = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(FILE, encoding="utf-8").read()
ENCODER, PLAIN = ByteEncoder(SPEC), Tokenizer.from_str(SPEC)
TEXTS = [None, "", " ", "Hello, World.", "it's  a\n b \n\nc\nd don't 's", "x" * 5000, "a　 b\u0085 c\x1c d", "<|endoftext|> a <|endoftext|>b  <|endo", "nul \x00 here  x", "中文。 中 文 .a", "wo.\nwo,\twi. 12 3.5 a1."]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abAB.,' \n\t\x1c\x00ćéΣ ​　1中<|>!?)s"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_segments_give_the_ids_of_whole_texts(texts):
    flat, at = ENCODER.encode_all([*texts, *TEXTS])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids(t) for t in [*texts, *TEXTS]]


def one_by_one(lengths, block):
    """Remaining capacities after best fit decreasing of single pieces."""
    room = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in room if r >= n), default=None)
        if best is not None:
            room.remove(best)
        room.append((block if best is None else best) - n)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda block: st.tuples(st.just(block), st.lists(st.integers(1, block), max_size=80))))
def test_plan_is_best_fit_decreasing(drawn):
    block, lengths = drawn
    filled, seen = {}, Counter()
    for n, first, pieces, sequence, each, offset in packing.best_fit(dict(Counter(lengths)), block).tolist():
        assert first == seen[n]
        for j in range(pieces):
            filled.setdefault(sequence + j // each, []).append((offset + j % each * n, n))
        seen[n] += pieces
    assert seen == Counter(lengths)
    for parts in filled.values():
        parts.sort()
        assert [at for at, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
    assert sorted(block - sum(n for _, n in parts) for parts in filled.values()) == one_by_one(lengths, block)


def test_tightest():
    rng = random.Random(5)
    tree, held = packing.Capacities(100), Counter()
    for _ in range(2000):
        c = rng.randrange(101)
        n = rng.choice([1, -1]) if held[c] else 1
        tree.add(c, n)
        held[c] += n
        need = rng.randrange(101)
        assert tree.tightest(need) == min((k for k, v in held.items() if v and k >= need), default=None)


def check(docs, got, block):
    """`docs`: (id, text); `got`: rows with ids."""
    whole = Counter((i, tuple(ids(t) + [2])) for i, t in docs)
    by_doc, by_sequence = {}, {}
    for r in got:
        x = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(x) == r.length <= block and crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.piece, x))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in by_doc.items():
        mine = [k for k in whole.elements() if k[0] == i]
        assert sum(len(x) for _, _, x in parts) == sum(len(k[1]) for k in mine)
        if len(mine) == 1:
            parts.sort()
            assert [p for _, p, _ in parts] == list(range(len(parts)))
            assert [s for s, _, _ in parts] == np.cumsum([0, *(len(x) for _, _, x in parts)])[:-1].tolist()
            assert tuple(t for _, _, x in parts for t in x) == mine[0][1]
            assert len(parts) == 1 or all(len(x) == block for _, _, x in parts[1:])
            assert len(parts) == -(-len(mine[0][1]) // block)
    for parts in by_sequence.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= block
    assert set(by_doc) == {i for i, _ in docs}
    assert sorted(block - sum(n for _, n in p) for p in by_sequence.values()) == one_by_one([r.length for r in got], block)


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_pieces_and_sequences(spark, block):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (100, "word " * 3000), (101, "word " * 1023), (102, "word " * 1024)] + [(200 + i, "copy of a copy") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("in the way")).withColumn("piece", F.lit(1)).repartition(5)
    packed = packing.pack(df, FILE, block, with_ids=True)
    got = packed.collect()
    check(docs, got, block)
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in got) and all(len(r.ids) == 4 * r.length for r in whole)


def test_repeated_ids_and_no_rows(spark):
    docs = [(1, "a b c"), (1, "a b c"), (1, "d e f g"), (None, None), (None, None)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), FILE, 16, with_ids=True).collect()
    check(docs, got, 16)
    assert len(got) == 5
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE)
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.count() == 0
