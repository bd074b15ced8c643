"""Ids of whole texts by way of the tokenizer's own pieces, several times faster than text by text.

A tokenizer of the kinds below cuts a text into pieces by a pattern and codes each piece by itself, so that the ids of a text are
those of its pieces one after the other.  Pieces recur: a worker keeps the ids of those it has seen of late, and only new ones
reach the library.  Texts of Latin-1 characters, where no letter has composed or contextual forms, are cut as bytes; all others by the
pattern itself; texts that the rules cannot answer for (special tokens, letters whose lower case depends on others, text that
is not composed) go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Pieces whose ids a worker has at hand (twice as many at most), and the longest that are kept, in bytes.
_PIECES, _LONGEST = 400_000, 64
#: Fixed value: the pattern by which byte-level tokenizers cut a text.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and white space of Latin-1 by the properties that the patterns ask for.
_UPPER, _LOWER, _DIGIT, _SPACE = rb"A-Z\xc0-\xd6\xd8-\xde", rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r \x85\xa0"
_SHORT = rb"'(?:[smtd]|re|ve|ll)"


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Recent(dict):
    """A table that forgets what has not been asked for while it was filled anew."""

    def __init__(self, most: int, make: Callable):
        self.most, self.make, self.before = most, make, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= _LONGEST:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


class PieceIds:
    """The ids of texts under one tokenizer file; ``ValueError`` for kinds other than the two below."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model.tokenize
        shape = json.loads(self.tokenizer.to_str())
        cut = shape["pre_tokenizer"]
        steps = [n["type"] for n in (shape["normalizer"] or {"normalizers": []})["normalizers"]]
        byte_level = {"type": "ByteLevel", "add_prefix_space": False}
        if not steps and cut.items() >= {**byte_level, "use_regex": True}.items():
            self.lower, pattern = False, _BYTE_LEVEL
            letters = _UPPER + _LOWER
            self.bytes_cut = re.compile(
                rb" ?[%(l)b]+|%(s)b| ?[%(n)b]+| ?[^%(w)b%(l)b%(n)b]+|[%(w)b]+(?![^%(w)b])|[%(w)b]+"
                % {b"l": letters, b"s": _SHORT, b"n": _DIGIT, b"w": _SPACE}).findall
        elif steps == ["NFC", "Replace", "Lowercase"] and cut["pretokenizers"][1].items() >= {**byte_level, "use_regex": False}.items():
            # white space is dropped, so what it is replaced by does not matter
            self.lower, pattern = True, cut["pretokenizers"][0]["pattern"]["Regex"]
            self.bytes_cut = re.compile(
                rb"[%(l)b]+|%(s)b|[%(n)b]|[^%(w)b%(l)b%(n)b]+" % {b"l": _LOWER, b"s": _SHORT, b"n": _DIGIT, b"w": _SPACE}).findall
        else:
            raise ValueError("this tokenizer codes whole texts only")
        self.cut = regex.compile(pattern).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in shape["added_tokens"]) or "(?!)").search
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter = _Recent(10_000, lambda c: "".join(x for x, _ in letters.pre_tokenize_str(c)))
        self.latin = _Recent(_PIECES, lambda piece: self._coded(piece.decode("latin-1")))
        self.piece = _Recent(_PIECES // 8, self._coded)

    def _coded(self, piece: str) -> bytes:
        text = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letter.__getitem__, piece))
        return array("I", [t.id for t in self.model(text)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> np.ndarray:
        """The ids of a text, as the library gives them; lone surrogates count as question marks."""
        if self.special(text):
            found = self._whole(text.encode("utf-8", "replace").decode("utf-8"))
        else:
            try:
                found = b"".join(map(self.latin.__getitem__, self.bytes_cut((text.lower() if self.lower else text).encode("latin-1"))))
            except UnicodeEncodeError:
                found = self._any(text.encode("utf-8", "replace").decode("utf-8"))
        return np.frombuffer(found, dtype="<u4")

    def _any(self, text: str) -> bytes:
        if self.lower:
            # a sigma's lower case depends on its neighbours, that of a dotted I has two letters
            if "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
                return self._whole(text)
            text = text.lower()
        return b"".join(map(self.piece.__getitem__, self.cut(text)))


of_file = functools.cache(PieceIds)
