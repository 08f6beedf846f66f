"""Encoding by distinct segments.

A tokenizer that never forms a token across a certain kind of boundary gives, for a text cut at such
boundaries, the joined results of the parts. Words repeat, so a task asks the tokenizer library once for each
distinct part and joins the remembered answers. What is remembered is bounded: two generations of entries, of
which the older goes when the younger is full.
"""

from __future__ import annotations

import re

#: White space other than the plain space and the line feed, in any of the definitions that libraries use.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: A cut before a space or line feed that follows something that no library takes for white space.
AFTER_TEXT = re.compile(r"(?<=\S)(?=[ \n])")
#: Entries of one generation.
REMEMBERED = 300_000


class Remembered(dict):
    """A bounded memo of `make`; lookups of known keys run at dict speed."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


def split_before_breaks(text: str) -> list[str] | None:
    """Parts of text cut before each space and line feed. A part that begins with a line feed keeps it; before
    every other part but the first a space has been taken away. None if white space stands in runs, at the ends,
    or is of another kind, where such cuts are not provably boundaries."""
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or "\n" in parts or OTHER_SPACE.search(text):
        return None
    return parts


def plain_letters(word: str) -> bool:
    """Letters of the Latin blocks only: every Unicode version and library agrees on their class and case, and
    they are in composed form."""
    return word.isalpha() and max(word) < "ɐ"


def byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others take
    the code points from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


BYTE_CHARS = byte_alphabet()


def as_byte_chars(word: str) -> str:
    return word if word.isascii() and word.isalpha() else "".join(BYTE_CHARS[b] for b in word.encode())
