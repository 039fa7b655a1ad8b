import io
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import token_files
from lectern.llm.encode import WordEncoder

FILE = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(FILE, encoding="utf-8").read()
ENCODER, PLAIN = WordEncoder(SPEC), Tokenizer.from_str(SPEC)
TEXTS = [None, "", " ", "Hello, World.", "it's IT'S 'sa a.b c.. d., e.é É́ À ΣΣ İx a\u0085b c d e　f\x1cg h\x0bi", "x" * 5000, "wo.\nwo,\twi. 12 3.5 a1. 中文。", "<|endoftext|> a <|ENDOFTEXT|> b<|startoftext|>", "a,́ b.̈"]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abAB.,' \n\t\x1ćéΣ ​1中<|>"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_segments_give_the_ids_of_whole_texts(texts):
    got = ENCODER.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids(t) for t in texts]


def test_parts_of_arrays():
    import pyarrow as pa

    whole = pa.array(["Some À words first. " * 20, None, *TEXTS[3:], "ÀÀ Last."])
    for x in (whole, pa.chunked_array([whole.slice(0, 2), whole.slice(2)])):
        assert ENCODER.encode(x.slice(1)) == [np.array(ids(t.as_py()), "<u4").tobytes() for t in whole.slice(1)]


def test_file_round_trip_and_single_frames():
    lists = [np.array(ids(t) + [2], "<u4").tobytes() for t in TEXTS]
    names = [None, *range(10, 10 + len(TEXTS) - 1)]
    raw = token_files.pack(lists, names)
    assert raw[-4:] == b"\xb1\xea\x92\x8f"
    f = token_files.TokenFile(io.BytesIO(raw))
    assert f.doc_ids == names and f.counts.tolist() == [len(x) // 4 for x in lists]
    assert [f.frame(k) for k in reversed(range(len(lists)))] == lists[::-1]
    # any zstandard reader gets all frames one after another
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read().startswith(b"".join(lists))
    at = int(f.starts[5]) + 12
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile(io.BytesIO(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])).frame(5)


def test_written_and_read_back(spark, tmp_path):
    rows = [(i * 3 % 11, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (4, "tie", 2), (4, "tie", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    token_files.write_tokens(docs, str(tmp_path / "t"), FILE, file_bytes=100)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    assert [g.start for g in got] == [0, *np.cumsum([g.n_tokens for g in got])[:-1].tolist()]
    want = sorted((str(i), len(ids(t)) + 1, crc32(np.array(ids(t) + [2], "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_crc32) for g in got) == want
    g = got[-1]
    with open(tmp_path / "t" / g.file, "rb") as f:
        assert token_files.TokenFile(f).ids(g.frame).tolist()[-1] == 2


def test_no_documents(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), FILE)
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0
