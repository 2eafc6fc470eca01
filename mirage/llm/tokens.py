"""Token ids of whole texts by the ``tokenizers`` library (runs inside tasks).

The library is asked once for each distinct chunk of text, not once for each
occurrence. A chunk is cut only where no token of the tokenizer can reach
across, which the tokenizer's own file says:

* white space is dropped before splitting into words (``words``): between any
  two runs of non-space bytes;
* byte-level with the usual pattern (``spaces``): before a single space and
  around a single newline, each with no other white space beside it.

Any other tokenizer, and any text whose white space is not of that form, is
encoded whole. Special tokens contain no white space, so a chunk that holds
one goes to the library's full ``encode`` as it is.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Chunks of a text whose white space is single spaces and line feeds between
# words; any other white space shows as a chunk that is none of these.
_USUAL = re.compile(r"\n| ?[^\s\x00]+").fullmatch
# A chunk of (a space,) letters and ASCII marks other than the apostrophe: two
# words of the tokenizers' pattern, which normalisation changes in case only.
# Letters up to U+02AF, without the one whose lower case is two characters.
_SIMPLE = re.compile(r"( ?)([A-Za-zªµºÀ-ÖØ-öø-įı-ʯ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įı-ʯ]+").fullmatch
#: ASCII marks other than the apostrophe.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_OWN: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This worker's encoder for a tokenizer file (kept between tasks)."""
    if path not in _OWN:
        _OWN[path] = Encoder(path)
    return _OWN[path]


class _Mapped(dict):
    """What the pre-tokenizer makes of single characters, asked once each."""

    def __init__(self, pre):
        super().__init__({32: pre.pre_tokenize_str(" a")[0][0][:-1]})
        self.pre = pre

    def __missing__(self, code: int) -> str:
        got = self[code] = "".join(piece for piece, _ in self.pre.pre_tokenize_str(chr(code)))
        return got


class _Odd(Exception):
    """A chunk whose white space is not of the form that may be cut."""


class _Store(dict):
    """Remembers what ``make`` gives for a key: the ``most`` latest keys and,
    until as many others came, those before them. Beyond that a key is made
    anew, which costs time only."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    #: Chunks kept, and as many of those before them (some 120 MB in all).
    MOST = 260_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        kinds = [p.get("type") for p in parts]
        self.kind = "whole"
        if kinds == ["ByteLevel"] and parts[0].get("use_regex") and not parts[0].get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "spaces"
        elif kinds == ["Split", "ByteLevel"] and parts[0].get("invert") and parts[0].get("behavior") == "Removed" \
                and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space"):
            self.kind = "words"
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.mapped = _Mapped(self.whole.pre_tokenizer) if self.kind != "whole" else None
        # Byte-level tokenizers write a space as a letter of its own, ASCII
        # letters and marks as they are.
        self.space = self.mapped[32] if self.kind == "spaces" else None
        self.known = _Store(self._new, self.MOST)

    def _piece(self, piece: str) -> bytes:
        """Ids of one word of the tokenizer's pattern."""
        return array("I", [t.id for t in self.whole.model.tokenize(piece)]).tobytes()

    def _new(self, chunk: bytes) -> bytes:
        """Ids of a chunk: most are letters (after a space) and marks, which
        are words of the pattern of their own and so chunks of their own."""
        word = chunk.rstrip(_MARKS)
        spaced = self.space is not None and word[:1] == b" "
        bare = word[1:] if spaced else word
        plain = bare.isalpha()  # ASCII only
        if len(word) < len(chunk) and (plain or bare and _LETTERS(bare.decode("utf-8"))):
            return self.known[word] + self.known[chunk[len(word):]]
        if plain:
            return self._piece((self.space if spaced else "") + (bare.lower() if self.lower else bare).decode())
        if self.kind == "spaces" and not _USUAL(chunk.decode("utf-8")):
            raise _Odd
        return self._chunk(chunk)

    def _chunk(self, chunk: bytes) -> bytes:
        s = chunk.decode("utf-8")
        simple = _SIMPLE(s)
        if simple and (simple[2] or not simple[1] or simple[3]) and (self.kind == "spaces" or not simple[1]):
            space, word, marks = simple.groups()
            if self.lower:
                word = word.lower()
            parts = [p for p in ((space + word, marks) if word else (space + marks,)) if p]
            return b"".join([self._piece(p.translate(self.mapped)) for p in parts])
        if any(t in s for t in self.special):
            return np.array(self.whole.encode(s, add_special_tokens=False).ids, np.uint32).tobytes()
        norm = self.whole.normalizer
        cut = self.whole.pre_tokenizer.pre_tokenize_str(norm.normalize_str(s) if norm else s)
        return b"".join([self._piece(piece) for piece, _ in cut])

    def _split(self, text: bytes) -> list[bytes]:
        if self.kind == "words":
            return text.split()
        return text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole UTF-8 text as little-endian unsigned 32-bit."""
        if self.kind == "whole" or b"\0" in text:
            return np.array(self.whole.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32).tobytes()
        try:
            return b"".join(map(self.known.__getitem__, self._split(text)))
        except _Odd:
            # Only where single spaces stand between words.
            cut = re.split(r"(?<=\S)(?= \S)", text.decode("utf-8"))
            return b"".join([self._chunk(c.encode()) for c in cut])
