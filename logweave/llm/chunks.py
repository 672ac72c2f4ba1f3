"""Token ids of texts by chunks that are remembered: words with the blank before them."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

#: A part of text between two blanks that has white space other than single line feeds inside.
_ODD = re.compile(r"^\Z|^\s|\s\Z|\s\s|[^\S\n]")
#: Signs that one piece has behind letters; an apostrophe may begin a piece of its own.
_SIGNS = "".join(c for c in string.punctuation if c != "'")
#: Chunks that a Python worker remembers: this many twice, the older ones go.
KEPT = 140_000


class _OddText(Exception):
    """A text whose white space does not allow chunks."""


class Chunks(dict):
    """Packed ids of words with the blank before them.

    Byte-level vocabularies split text before every blank that stands between
    two words and around every such line feed, whatever else the text holds.
    So a text whose white space is of that kind is encoded word by word, and a word is
    encoded once. Other texts are encoded whole.

    ``encode`` gives the packed ids of any text, ``piece`` those of a text that
    the vocabulary's pattern does not split: letters, also with a blank before them, or signs.
    """

    def __init__(self, encode: Callable[[str], bytes], piece: Callable[[str], bytes], kept: int = KEPT):
        super().__init__()
        self.encode, self.piece, self.kept, self.older = encode, piece, kept, {}
        self.tails: dict[str, bytes] = {}
        self.first = _LineStarts(encode, kept // 8)

    def __missing__(self, key: str) -> bytes:
        packed = self.older.get(key)
        if packed is None:
            if key.isalpha():
                packed = self.piece(" " + key)
            elif _ODD.search(key):
                raise _OddText
            elif "\n" in key:
                before, *lines = key.split("\n")
                return b"".join([self[before], *map(self.first.__getitem__, lines)])
            else:
                packed = self._word(key)
        if len(key) <= 48:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[key] = packed
        return packed

    def _word(self, key: str) -> bytes:
        stem = key.rstrip(_SIGNS)
        if not (stem.isalpha() and key.isascii()):
            return self.encode(" " + key)
        tail = key[len(stem):]
        if tail not in self.tails:
            self.tails[tail] = self.piece(tail)
        return self[stem] + self.tails[tail]

    def text(self, text: str | None) -> bytes:
        """The packed ids of a whole text; none for null and empty texts."""
        if not text:
            return b""
        head, *words = text.split(" ")
        try:
            if _ODD.search(head):
                raise _OddText
            start, *lines = head.split("\n")
            return b"".join([self.encode(start), *map(self.first.__getitem__, lines),
                             *map(self.__getitem__, words)])
        except _OddText:
            return self.encode(text)


class _LineStarts(dict):
    """Packed ids of a line feed and the word behind it."""

    def __init__(self, encode: Callable[[str], bytes], kept: int):
        super().__init__()
        self.encode, self.kept = encode, kept

    def __missing__(self, word: str) -> bytes:
        packed = self.encode("\n" + word)
        if len(self) >= self.kept:
            self.clear()
        if len(word) <= 48:
            self[word] = packed
        return packed
