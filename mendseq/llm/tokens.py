"""Token ids of whole texts, as the ``tokenizers`` library gives them.

Both vocabularies cut a text at white space before they merge, so a text is cut there
first and every distinct unit is encoded once per worker.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

# Units kept per worker, about 150 bytes each; further ones are encoded each time.
KEPT_UNITS = 800_000

_ODD_SPACE = re.compile(r"[^\S \n]|[ \n][ \n]")
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class UnitIds(dict):
    """From a unit of text to its ids, packed as ``kind`` (H: 16 bits, I: 32 bits).

    ``ranks``: the same vocabulary as a rank file, which encodes units without a special
    token in less time.
    """

    def __init__(self, vocabulary: str, kind: str, ranks: str | None = None):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.plain = kind, None
        if ranks is not None:
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                           special_tokens={}).encode_ordinary

    def encode(self, unit: str) -> list[int]:
        if self.plain is None or "<|" in unit:
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        return self.plain(unit)

    def __missing__(self, unit: str) -> bytes:
        ids = array(self.kind, self.encode(unit)).tobytes()
        if len(self) < KEPT_UNITS:
            self[unit] = ids
        return ids


@lru_cache(maxsize=4)
def unit_ids(vocabulary: str, kind: str, ranks: str | None = None) -> UnitIds:
    """``vocabulary``, ``ranks``: paths, or names of the installed public vocabularies."""
    path = lambda name: public_tokenizers.path(name) if name and "/" not in name else name
    return UnitIds(path(vocabulary), kind, path(ranks))


def byte_level_units(text: str) -> list[str]:
    """Cuts before a blank or line feed between two characters that are not white space.

    A byte-level vocabulary begins a new piece there, whatever stands around it.
    """
    if _ODD_SPACE.search(text) or "\0" in text:
        return _SAFE_CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def byte_level_ids(text: str, units: UnitIds) -> bytes:
    return b"".join(map(units.__getitem__, byte_level_units(text)))


def word_ids(text: str, units: UnitIds) -> bytes:
    """Ids of a vocabulary that drops white space: every word on its own."""
    return b"".join(map(units.__getitem__, text.replace("\n", " ").split(" ")))
