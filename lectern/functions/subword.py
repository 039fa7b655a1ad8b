"""Tokenizers of other makers behind one interface, and the choice between them and the pattern tokenizer.

An adapter wraps a file of the tokenizers library, which the caller names; nothing is fetched. It offers pandas
functions over columns: tokens, ids with or without the special ones, and texts with the CJK spacing put right.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import tokens as K
from lectern.functions.text import cjk_spacing

#: Names under which tokenizer files keep their special tokens.
NAMES = {"pad": ("<pad>", "[PAD]"), "unk": ("<unk>", "[UNK]"), "bos": ("<bos>", "<s>", "<|startoftext|>"), "eos": ("<eos>", "</s>", "<|endoftext|>"), "cls": ("[CLS]",), "sep": ("[SEP]",)}


class Subword:
    """A tokenizer file of the tokenizers library. Null texts and lists are empty."""

    def __init__(self, file_json: str):
        self.file_json = file_json
        made = self._made(file_json)
        self.vocab_size = made.get_vocab_size()
        found = {n: next((made.token_to_id(t) for t in ts if made.token_to_id(t) is not None), None) for n, ts in NAMES.items()}
        self.pad_id, self.unk_id, self.bos_id, self.eos_id = (K.special_id(found, n) for n in ("pad", "unk", "bos", "eos"))

    @staticmethod
    def _made(file_json: str):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(file_json)

    def _column(self, kind: str, f: Callable) -> Callable[[Column], Column]:
        file_json, make = self.file_json, self._made

        def of(batches):
            t = make(file_json)
            for x in batches:
                yield pd.Series([f(t, None if v is None else v) for v in x], dtype=object)

        from collections.abc import Iterator

        of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(of, kind)

    def tokenise(self, text: Column) -> Column:
        return self._column("array<string>", lambda t, x: t.encode(x or "", add_special_tokens=False).tokens)(text)

    def encode(self, text: Column, specials: bool = True) -> Column:
        first, last = ([self.bos_id], [self.eos_id]) if specials else ([], [])
        return self._column("array<int>", lambda t, x: first + t.encode(x or "", add_special_tokens=False).ids + last)(text)

    def decode(self, ids: Column) -> Column:
        return cjk_spacing(self._column("string", lambda t, x: t.decode([] if x is None else [int(i) for i in x], skip_special_tokens=True))(ids))


def load_tokenizer(content: str, kind: str = "auto") -> Subword | dict[str, int]:
    """What a tokenizer file holds: a vocabulary of the pattern tokenizer (`regex`) or a file of the tokenizers library (`hf`); `auto` tells them apart."""
    found = json.loads(content)
    is_vocabulary = isinstance(found, dict) and "token_to_id" in found
    if kind not in ("auto", "regex", "hf"):
        raise ValueError(f"unknown kind of tokenizer: {kind}")
    if kind == "regex" or kind == "auto" and is_vocabulary:
        if not is_vocabulary:
            raise ValueError("no vocabulary of the pattern tokenizer")
        return {t: int(i) for t, i in found["token_to_id"].items()}
    return Subword(content)


def build_vocabulary(texts: DataFrame, text: str, order: str, saved: DataFrame | None, size: int = 256) -> DataFrame:
    """The saved vocabulary (lines of `value`) where there is one, else one trained on the texts."""
    return K.load_vocabulary(saved) if saved is not None else K.train_vocabulary(texts, text, order, size)
