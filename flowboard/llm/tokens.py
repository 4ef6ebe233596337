"""Token ids of whole texts from a tokenizer file, fast enough to be run over a corpus.

Runs inside Python workers. A text is cut into units where the tokenizer cuts it anyway: words, runs of
common punctuation, and whatever else lies between spaces. Each is encoded by the tokenizers
library once and remembered, so a frequent word costs one look-up.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import regex

#: Units remembered per worker. It bounds memory, not what is encoded.
CACHE_UNITS = 750_000
#: The pattern of byte-level pre-tokenizers (a fixed value of the file format).
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD = re.compile(f" ?[{_LATIN}]+").fullmatch
#: A Latin word that no letter, digit or apostrophe follows; punctuation before a space, line end or the end; a single line
#: end; anything else up to the next space. Every match begins and ends where pre-tokens do, unless white space meets a space.
_UNIT = re.compile(rf" ?[{_LATIN}]+(?![^\W_]|')|[.,;:!?]+(?=[ \n]|\Z)|\n(?=\S)| ?[^ ]+| ").findall


class _NotAlone(Exception):
    """A unit with white space next to a space outside it, so it cannot be encoded by itself."""


class _Units(dict):
    """Unit -> its ids as bytes."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner, self.tokenize, self.characters = owner, owner.tokenizer.model.tokenize, _byte_characters()

    def __missing__(self, unit: str) -> bytes:
        if _WORD(unit):
            ids = self.word(unit)
        elif unit[-1].isspace() and unit != "\n":
            raise _NotAlone
        else:
            ids = self.owner.piece(unit)
        if len(self) < CACHE_UNITS:
            self[unit] = ids
        return ids

    def word(self, token: str) -> bytes:
        """Ids of one pre-token from the tokenizer's own model."""
        if token.isascii() and token.isprintable():
            spelled = token.replace(" ", self.characters[32])
        else:
            spelled = "".join(map(self.characters.__getitem__, token.encode()))
        ids = [t.id for t in self.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as `encode(text, add_special_tokens=False)` gives them.

    Byte-level BPE with the usual pattern cuts a text into pre-tokens, and nothing a pre-token
    becomes depends on its neighbours. So units that begin and end where pre-tokens do are encoded
    one by one: a Latin word is one pre-token, other units are cut by the same pattern. Units that may hold an added token, texts
    with other white space next to a space, and all texts with any other kind of tokenizer are given to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("truncation") is None and not any(t["lstrip"] or t["rstrip"] or re.search(rf"^[{_LATIN}.,;:!?]|\s", t["content"]) for t in spec.get("added_tokens", [])))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.pretokens, self.units = regex.compile(_PRETOKEN).findall, _Units(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(map(self.units.word, self.pretokens(text)))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self.whole(text)
        try:
            return b"".join(map(self.units.__getitem__, _UNIT(text)))
        except _NotAlone:
            pieces = _SAFE_CUT.split(text)
            return self.whole(pieces[0]) + b"".join([self.whole(" " + p) for p in pieces[1:]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
