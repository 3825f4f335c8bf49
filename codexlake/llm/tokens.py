"""Whole texts to token ids with a public tokenizer, with the ids of units kept for reuse.

A text is cut at places where the tokenizer's own pre-tokenizer always cuts
(around white space, and between Latin letters and a full stop or comma), so
the ids of the text are the ids of its units one after the other. Each unit
goes through the tokenizer's normalizer, pre-tokenizer and model once per
worker; texts that may hold special tokens are encoded as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space, as the tokenizers' patterns understand \s.
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Units kept per worker, about 200 bytes each; at the limit the store is emptied.
MAX_UNITS = 1_000_000
#: A unit of letters only is one piece of the pre-tokenizer, whose byte-level step writes each byte as a printable character.
_WORD = re.compile(rf" ?[{_LETTERS}]+").fullmatch
_PRINTED = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_BYTES = _PRINTED | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class Encoder(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.normalizer, self.cut, self.model = self.whole.normalizer, self.whole.pre_tokenizer, self.whole.model
        lead = "" if self.normalizer else " ?"  # a normalizer that drops white space leaves no leading blanks
        units = rf"{lead}[{_LETTERS}]+(?=[{_SPACE}.,]|\Z)|[.,](?=[{_SPACE}]|\Z)|{lead}[^{_SPACE}]+"
        self.units = re.compile(units if self.normalizer else rf"{units}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda _: None

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MAX_UNITS:
            self.clear()
        if _WORD(unit):
            word = unit.lower() if self.normalizer else unit
            found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
        else:
            text = self.normalizer.normalize_str(unit) if self.normalizer else unit
            found = [t.id for piece, _ in self.cut.pre_tokenize_str(text) for t in self.model.tokenize(piece)]
        self[unit] = packed = np.array(found, dtype="<u4").tobytes()
        return packed

    def encode(self, text: str) -> bytes:
        if self.special(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, self.units(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
