"""Batches of texts to token ids through the tokenizers library, each distinct segment once.

A text is cut at places that no token crosses; its ids are those of its segments one after another. Cutting,
finding a batch's distinct segments and laying out ids are Arrow's own functions. Segments that a worker has met
before are known by number, until there are too many and the older half goes; the others go to
the library together, which encodes them on several threads.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that a worker remembers at most (about 150 bytes each), and the longest of them.
REMEMBERED, LONGEST = 600_000, 64
#: Segments that go to the library as one text.
TOGETHER = 200


def threads(n: int = 2) -> None:
    """Threads of the library in this process; it has effect before the first batch."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"


def large(texts) -> pa.LargeStringArray:
    """Texts as an array with 64-bit offsets; null is empty."""
    x = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    x = pc.fill_null(x.cast(pa.large_string()), "")
    parts = x.chunks if isinstance(x, pa.ChunkedArray) else [x]
    # laid out anew: pyarrow's ascii_lower goes wrong on a part of an array
    return pa.concat_arrays([*parts, pa.array([], pa.large_string())])


def lists_of(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    raw = flat.astype("<u4", copy=False).tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode_together(tokenizer, segments: list[str], glue: str = "", mark: int = -1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The segments in another order, their ids, and each one's number of ids.

    With `glue`, segments without a mark stand in one text with the glue between them; its id, `mark`, cuts the text's
    ids, and no other string may give that id.
    """
    held = glue.strip(" ") if glue else ""
    easy = [s for s in segments if held not in s] if glue else []
    odd = [s for s in segments if held in s] if glue else segments
    counts, ids = [], []
    if easy:
        for e in tokenizer.encode_batch_fast([glue.join(easy[k : k + TOGETHER]) for k in range(0, len(easy), TOGETHER)], add_special_tokens=False):
            x = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(x == mark)
            counts.append(np.diff(np.r_[-1, cuts, len(x)]) - 1)
            ids.append(np.delete(x, cuts))
    if odd:
        found = tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        counts.append(np.fromiter((len(e.ids) for e in found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32))
    return easy + odd, np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *counts])


class SegmentEncoder:
    """Ids of texts that are lists of segments. `ids_of`: for a list of segments, them in any order, their ids, and each one's number of ids."""

    def __init__(self, ids_of: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], remembered: int = REMEMBERED, seen: Callable[[list[str], np.ndarray, np.ndarray], None] | None = None):
        self.ids_of, self.remembered, self.seen = ids_of, remembered, seen
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _halve(self) -> None:
        half = len(self.known) // 2
        kept = list(self.known)[half:]
        self.ids, self.ends = self.ids[self.ends[half - 1] :], np.r_[0, self.ends[half:] - self.ends[half - 1]]
        self.known = {s: i for i, s in enumerate(["", *(s for s in kept if s)])}

    def _meet(self, segments: list[str]) -> list[str]:
        """Number segments that aren't known; the long ones among them."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > self.remembered and len(self.known) > 1:
            self._halve()
            new = [s for s in segments if s not in self.known]
        long = [s for s in new if len(s) > LONGEST]
        for part in ([s for s in new if len(s) <= LONGEST], long):  # long ones last: they go again
            if part:
                part, ids, counts = self.ids_of(part)
                first = len(self.known)
                self.known.update(zip(part, range(first, first + len(part)), strict=True))
                self.ends = np.r_[self.ends, len(self.ids) + np.cumsum(counts)]
                self.ids = np.concatenate([self.ids, ids])
                if self.seen:
                    self.seen(part, ids, counts)
        return long

    def encode(self, cut: pa.LargeListArray | pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end."""
        found = cut.flatten().dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = self._meet(names)
        numbers = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        starts = np.r_[0, self.ends[:-1]][numbers]
        counts = self.ends[numbers] - starts
        places = np.r_[0, np.cumsum(counts)]
        mine = self.ids[np.arange(places[-1]) + np.repeat(starts - places[:-1], counts)]
        flat = pa.LargeListArray.from_arrays(pa.array(places), pa.array(mine)).take(found.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(counts[found.indices.to_numpy()])]
        offsets = cut.offsets.to_numpy()
        if long:  # they would take most of the memory
            for s in long:
                del self.known[s]
            self.ends = self.ends[: len(self.known)]
            self.ids = self.ids[: self.ends[-1]]
        return flat, ends[offsets - offsets[0]]


class WordEncoder:
    """The ids of a tokenizer file whose pre-tokenizer drops white space, as Tokenizer.encode gives them.

    Words between ASCII white space are segments. The file lower-cases and its pattern keeps letters
    and punctuation apart, so ASCII letters are lowered first and the punctuation that ends a
    word after a letter is a segment of its own; both only raise the number of known segments.
    A text that holds an added token's string is encoded whole.
    """

    _BETWEEN = "|"
    _END = r"([a-z])([.,;:!?)]+)([ \t-\r]|$)"

    def __init__(self, file_json: str):
        import json

        from tokenizers import Tokenizer

        threads()
        self.tokenizer = Tokenizer.from_str(file_json)
        spec = json.loads(file_json)
        self.added = [t["content"] for t in spec["added_tokens"]]
        said = json.dumps(spec["normalizer"])
        split = json.dumps(spec["pre_tokenizer"])
        self.cuts = '"Lowercase"' in said and r"[\\p{L}]+" in split and '"Removed"' in split
        if not self.cuts or spec["post_processor"]:
            raise ValueError("only for tokenizer files that lower-case and drop white space")
        between = self.tokenizer.encode(self._BETWEEN, add_special_tokens=False).ids
        glue, mark = (f" {self._BETWEEN} ", between[0]) if len(between) == 1 else ("", -1)
        self.segments = SegmentEncoder(lambda xs: encode_together(self.tokenizer, xs, glue, mark))

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (a list or an Arrow array) one after another, and where each text's begin and end."""
        x = large(texts)
        odd = np.zeros(len(x), bool)
        for a in self.added:
            odd |= pc.match_substring(x, a).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~odd), x, pa.scalar("", pa.large_string())) if odd.any() else x
        flat, offsets = self.segments.encode(pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), self._END, r"\1 \2\3")))
        if not odd.any():
            return flat, offsets
        parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.tokenizer.encode(x[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def encode(self, texts) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return lists_of(*self.encode_all(texts))


class ByteEncoder:
    """The ids of a byte-level tokenizer file with the usual pattern, as Tokenizer.encode gives them.

    The pattern lets a token begin with one blank and never holds one elsewhere but in runs of white space, and letters and
    punctuation are never in one token: so texts are cut before a blank that print follows, between a Latin letter and the
    punctuation of a sentence, and after a line end between ASCII print. A text that holds an added
    token's string, or the character that marks cuts, is cut in Python.
    """

    _CUT = "\0"
    _RULES = ((r" ([!-~À-ÖØ-öø-ÿ])", "\0 \\1"), (r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?)])", "\\1\0\\2"), (r"([!-~])\n([!-~])", "\\1\n\0\\2"))

    def __init__(self, file_json: str, remembered: int = REMEMBERED):
        import json

        from tokenizers import Tokenizer

        threads()
        self.tokenizer = Tokenizer.from_str(file_json)
        spec = json.loads(file_json)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["post_processor"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only for plain byte-level tokenizer files")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.strings = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        glue, mark = (self.added[0], spec["added_tokens"][0]["id"]) if self.added else ("", -1)
        self.segments = SegmentEncoder(lambda xs: encode_together(self.tokenizer, xs, glue, mark), remembered)

    def _by_hand(self, text: str) -> list[str]:
        parts = self.strings.split(text) if self.strings else [text]
        return [s for k, p in enumerate(parts) for s in ([p] if k % 2 else re.split(r"(?= [!-~])", p))]

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (a list or an Arrow array) one after another, and where each text's begin and end."""
        x = large(texts)
        odd = np.zeros(len(x), bool)
        for a in [self._CUT, *self.added]:
            odd |= pc.match_substring(x, a).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~odd), x, pa.scalar("", pa.large_string())) if odd.any() else x
        for pattern, cut in self._RULES:
            plain = pc.replace_substring_regex(plain, pattern, cut)
        flat, offsets = self.segments.encode(pc.split_pattern(plain, self._CUT))
        if not odd.any():
            return flat, offsets
        parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i in np.flatnonzero(odd):
            cut = self._by_hand(x[int(i)].as_py())
            parts[i] = self.segments.encode(pa.LargeListArray.from_arrays(pa.array([0, len(cut)], pa.int64()), pa.array(cut, pa.large_string())))[0]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
