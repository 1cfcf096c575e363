"""Cutting a text where the byte-level pre-tokenisers always cut, so that pieces can be cached.

The split pattern of the public byte-level vocabularies takes a blank only in front of a word or inside a run of
white space. Between a character that is not white space and a following blank it therefore always cuts, and what
it does right of the cut depends on nothing left of it. Texts are cut there; each piece is encoded once per worker.
"""

from __future__ import annotations

import re

#: White space as the split patterns mean it (the Unicode property White_Space).
SPACE = "\\t-\\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SPACE_BEFORE_BLANK = re.compile(f"[{SPACE}] ")


def cut(text: str) -> tuple[list[str], list[str]]:
    """Pieces, then words. Their encodings concatenate to the text's encoding, if each word is encoded with a blank
    in front of it. (Words leave the blank out only to spare a copy of each.)"""
    if not text:
        return [], []
    if text[0] == " " or _blank_after_space(text):
        return _PIECES.findall(text), []
    words = text.split(" ")
    return words[:1], words[1:]


def _blank_after_space(text: str) -> bool:
    if text[-1] == " ":
        return True
    if text.isascii():
        return any(pair in text for pair in ("  ", "\n ", "\r ", "\t ", "\x0b ", "\x0c "))
    return _SPACE_BEFORE_BLANK.search(text) is not None


class Known:
    """What a worker has encoded so far: ``words`` follow a blank, ``pieces`` are as they are.

    ``make`` encodes a list of pieces at once. When more than ``limit`` are held, all are forgotten.
    """

    def __init__(self, make, limit: int = 800_000):
        self.make, self.limit = make, limit
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        pieces, words = cut(text)
        try:
            return b"".join(map(self.pieces.__getitem__, pieces)) + b"".join(map(self.words.__getitem__, words))
        except KeyError:
            if len(self.pieces) + len(self.words) > self.limit:
                self.pieces, self.words = {}, {}
            new_pieces = list({piece for piece in pieces if piece not in self.pieces})
            new_words = list({word for word in words if word not in self.words})
            made = self.make(new_pieces + [" " + word for word in new_words])
            self.pieces.update(zip(new_pieces, made))
            self.words.update(zip(new_words, made[len(new_pieces):]))
            return b"".join(map(self.pieces.__getitem__, pieces)) + b"".join(map(self.words.__getitem__, words))
