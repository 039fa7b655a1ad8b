"""SentencePiece models run by the tokenizers library.

The model file's protobuf is read here: pieces with scores and kinds, the trainer's algorithm, byte fallback
and special ids, and the normaliser's character map and white-space rules. From them a
tokenizers pipeline is rebuilt: normaliser (character map, collapsing of spaces, dummy prefix, white-space
marker), unigram scores or the merges that the scores of a BPE model imply, byte fallback, and the decoder.

No token crosses the place between two characters that are neighbours in no piece. Texts are cut at such
places (before markers, around line ends, before full stops after letters, as the model allows), and each
distinct segment is encoded, and decoded again, once a worker. Ids of a text are those of its segments one after
another, and so are the bytes that they spell: a text's round trip holds if those of its segments do.

`parity` compares ids with those of the sentencepiece library; the query compares every document's whole text.

Limits, stated rather than hidden: word and char models, user-defined pieces, a suffix marker and
normalisers that drop the marker are refused. In a unigram model with byte fallback the names of byte
pieces ("<0x41>") are ordinary pieces to the tokenizers library; they get the lowest score. It adds scores in
double precision and the other library in single, so splits of equal score in long runs of few
characters may differ in a unigram model, as may runs of marker characters spelt in a text before a space.
`parity` tells.

Defined cases: null text is empty; an empty text has no ids and decodes to itself; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.encode import SegmentEncoder, encode_together, large, lists_of, threads
from lectern.llm.shingles import chunks
from lectern.llm.worker import lean, once
from lectern.session import ship

MARK = "▁"
#: Bytes of texts that are encoded together (a longer text alone), and segments that a worker remembers beside two models.
TOGETHER, REMEMBERED = 2 << 20, 250_000
#: Fixed values of the public model format: kinds of pieces, and the algorithms that are read here.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            c = b[at]
            at += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while at < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, b[at : at + n]
        at += n


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                x = dict(_fields(value))
                m.pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, NORMAL)))
            elif number == 2:
                x = dict(_fields(value))
                m.algorithm, m.byte_fallback, m.suffix_mark = x.get(3, UNIGRAM), bool(x.get(35, 0)), bool(x.get(24, 0))
                m.unk_id = x.get(40, 0)
            elif number == 3:
                x = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.collapse, m.escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        kinds = {k for _, _, k in m.pieces}
        if m.algorithm not in (UNIGRAM, BPE) or USER in kinds or m.suffix_mark or not m.escape:
            raise ValueError("this kind of model isn't supported")
        return m

    def merges(self) -> list[tuple[str, str]]:
        """The pairs of a BPE model, best first: a piece's score ranks all pairs that make it."""
        rank = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        made = sorted((p for p in rank if len(p) > 1), key=lambda p: (-self.pieces[rank[p]][1], rank[p]))
        return [(p[:i], p[i:]) for p in made for i in sorted(range(1, len(p)), key=lambda i: (rank.get(p[:i], -1), rank.get(p[i:], -1))) if p[:i] in rank and p[i:] in rank]

    def pairs(self) -> set[str]:
        """Neighbouring characters within pieces: tokens cross the place between two others nowhere."""
        return {p[i : i + 2] for p, _, k in self.pieces if k == NORMAL for i in range(len(p) - 1)}


class Cutter:
    """Cuts normalised text into segments that no token crosses, as the pairs of the model's pieces tell."""

    AT = "\uffff"

    def __init__(self, model: Model):
        pairs, alone = model.pairs(), {c for p, _, k in model.pieces if k == NORMAL for c in p}
        self.mark = not any(b == MARK != a for a, b in pairs)
        # without byte fallback, neighbouring unknown characters are one unknown piece: no cut among those
        ends = [c for c in ".,!?;:" if (model.byte_fallback or c in alone) and not any(b == c and a.isalpha() for a, b in pairs)]
        self.ends = rf"(\pL)([{''.join(ends)}])" if ends and self.mark else ""
        self.line = self.mark and model.byte_fallback and "\n" not in alone

    def __call__(self, texts: pa.LargeStringArray) -> pa.LargeListArray:
        """The segments of each text; an empty one is none."""
        if not self.mark:
            return pc.split_pattern(texts, self.AT + self.AT, max_splits=0)
        held = pc.match_substring(texts, self.AT).to_numpy(zero_copy_only=False)
        if held.any():  # a text that spells the sign of a cut is one segment
            cut = self(pc.if_else(pa.array(held), pa.scalar("", pa.large_string()), texts)).to_pylist()
            return pa.array([[t] if h else c for t, h, c in zip(texts.to_pylist(), held, cut, strict=True)], pa.large_list(pa.large_string()))
        # a run of marks stays whole: pieces hold several
        x = pc.replace_substring(pc.replace_substring(texts, MARK, self.AT + MARK), MARK + self.AT, MARK)
        if self.ends:
            x = pc.replace_substring_regex(x, self.ends, rf"\1{self.AT}\2")
        if self.line:
            x = pc.replace_substring(x, "\n", f"{self.AT}\n{self.AT}")
        cut = pc.split_pattern(x, self.AT)
        return pa.LargeListArray.from_arrays(cut.offsets.cast(pa.int64()), cut.flatten())


class PieceTokenizer:
    """Encodes and decodes by a model, through the tokenizers library."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer, decoders, models, normalizers

        threads()
        self.model = m = Model.parse(raw)
        # kinds that text never yields get names that normalised text can't hold: it has no plain space
        names = [p if k in (NORMAL, UNUSED, BYTE) else f" {p}" for p, _, k in m.pieces]
        if m.algorithm == BPE:
            vocab = {n: i for i, n in enumerate(names)}
            model = models.BPE(vocab=vocab, merges=m.merges(), unk_token=names[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            low = min(s for _, s, k in m.pieces if k == NORMAL)
            model = models.Unigram([(n, low if k in (BYTE, UNUSED) else s) for n, (_, s, k) in zip(names, m.pieces, strict=True)], m.unk_id, m.byte_fallback)
        self.tokenizer = Tokenizer(model)
        self.normal = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        self.names = names
        self.special = {i for i, (_, _, k) in enumerate(m.pieces) if k == CONTROL}
        self.cut = Cutter(m)
        self._spelt = {i: p.replace(MARK, " ").encode() for i, (p, _, k) in enumerate(m.pieces) if k == NORMAL}
        self._spelt |= {i: bytes([int(p[3:5], 16)]) for i, (p, _, k) in enumerate(m.pieces) if k == BYTE}
        glue = "\n" if self.cut.line else ""
        mark = self.tokenizer.encode(glue, add_special_tokens=False).ids if glue else []
        self.segments = SegmentEncoder(lambda xs: encode_together(self.tokenizer, xs, *((glue, mark[0]) if len(mark) == 1 else ())), REMEMBERED, self._decoded)
        #: Segments that their ids don't spell.
        self.lost: set[str] = set()

    def _decoded(self, segments: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        spelt, at = [self._spelt.get(i) for i in ids.tolist()], 0
        for s, n in zip(segments, counts.tolist(), strict=True):
            part = spelt[at : at + n]
            if None in part or b"".join(part) != s.replace(MARK, " ").encode():
                self.lost.add(s)
            at += n

    def normalise(self, text: str | None) -> str:
        """The text that pieces spell, markers for spaces."""
        text = text or ""
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        if self.model.collapse:  # trailing markers go too, spelt ones as well
            text = re.sub(" {2,}", " ", text.lstrip(" ")).rstrip(" " + MARK)
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts (a list or an Arrow array) one after another, where each text's begin and end, and whether they spell the normalised text."""
        raw = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        cut = self.cut(large([self.normalise(t) for t in raw]))
        if len(self.lost) > REMEMBERED:
            self.lost.intersection_update(self.segments.known)
        flat, offsets = self.segments.encode(cut)
        back = np.ones(len(raw), bool)
        if self.lost:
            at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            bad = np.r_[0, np.cumsum(pc.is_in(cut.flatten(), pa.array(sorted(self.lost), pa.large_string())).to_numpy(zero_copy_only=False))]
            back = bad[at[1:]] == bad[at[:-1]]
        return flat, offsets, back

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return lists_of(*self.encode_all(texts)[:2])

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode([self.names[i] for i in ids if i not in self.special])

    def decode_all(self, many: list[bytes]) -> list[str]:
        """Texts of id lists: runs of byte pieces become their bytes, markers spaces, the dummy prefix goes."""
        out = []
        for raw in many:
            ids = np.frombuffer(raw, "<u4").tolist()
            try:
                t = b"".join([self._spelt[i] for i in ids]).decode()
                out.append(t[1:] if self.model.dummy_prefix and t[:1] == " " else t)
            except (KeyError, UnicodeDecodeError):  # unknown or special pieces, or bytes that are no text
                out.append(self.decode(ids))
        return out


def parity(raw: bytes, texts: list[str], flat: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Whether the sentencepiece library gives the same ids for whole texts."""
    import sentencepiece

    sp = once(("pieces", "sentencepiece", crc32(raw)), lambda: sentencepiece.SentencePieceProcessor(model_proto=raw))
    found = sp.encode(list(texts), num_threads=1, return_type="numpy")
    return [np.array_equal(x, flat[a:b]) for x, a, b in zip(found, offsets[:-1], offsets[1:], strict=True)]


def _encoded(spec, compare: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = spec.value
        t = None
        for batch in batches:
            t = t or _tokenizer(raw)
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part in chunks(texts, TOGETHER):
                some = [texts[i] for i in part]
                flat, offsets, back = t.encode_all(some)
                whole = flat.astype("<u4", copy=False)
                cols = [
                    batch.column("id").slice(part.start, len(part)),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([crc32(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), flat.view(np.int32)),
                    pa.array(back),
                    pa.array(parity(raw, some, flat, offsets) if compare else [None] * len(some), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_crc32", "ids", "round_trip", "parity"])

    return lean("pieces", run)


def _tokenizer(raw: bytes) -> PieceTokenizer:
    """The tokenizer of a model, made once in a worker process."""
    return once(("pieces", crc32(raw)), lambda: PieceTokenizer(raw))


def encode_pieces(docs: DataFrame, model_file: str, compare: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_crc32 (of ids as little-endian unsigned 32-bit integers), ids, round_trip, parity.

    round_trip: decoding gives the normalised text. parity: the sentencepiece library gives
    the same ids (null where not compared).
    """
    spark = ship(docs.sparkSession)
    with open(model_file, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one model file: some hundred KB whatever the input
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = plain.mapInArrow(_encoded(spec, compare), "id long, n_tokens long, ids_crc32 long, ids array<int>, round_trip boolean, parity boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id_col, text."""
    spark = ship(encoded.sparkSession)
    with open(model_file, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _tokenizer(spec.value)
            texts = t.decode_all([np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(lean("pieces", run), "id long, text string").withColumnRenamed("id", id_col)
