"""Byte-level pre-tokens: where a text may be cut, and how a piece splits."""

from __future__ import annotations

from itertools import chain

import regex

#: White space beside a space: only there can a cut at a single space change the matches.
BESIDE = regex.compile(r" \s|\s ")
#: Characters outside these may be classed otherwise by a library with other Unicode tables.
UNSURE = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞€]")


class Pieces(dict):
    """piece -> list of indices of its pre-tokens; ``words`` has the pre-tokens by index.

    ``split`` gives a piece's pre-tokens. Cutting a text before each space that has
    no white space beside it cuts between matches of the pattern, so the pieces'
    pre-tokens joined are the text's.
    """

    def __init__(self, split):
        super().__init__()
        self.split = split
        self.index: dict[str, int] = {}
        self.words: list[str] = []

    def of(self, piece: str) -> list[int]:
        out = []
        for word in self.split(piece):
            k = self.index.get(word)
            if k is None:
                k = self.index[word] = len(self.words)
                self.words.append(word)
            out.append(k)
        return out

    def __missing__(self, piece: str) -> list[int]:
        found = self[piece] = self.of(" " + piece)
        return found

    def sequence(self, text: str) -> list[int]:
        """Indices of the text's pre-tokens, in order."""
        if BESIDE.search(text):
            return self.of(text)
        first, *rest = text.split(" ")
        return [*self.of(first), *chain.from_iterable(map(self.__getitem__, rest))]


def pattern_splitter(pattern: str):
    """Matches of the pattern; a piece with unsure characters stays whole, for the library to split."""
    find = regex.compile(pattern).findall

    def split(piece: str) -> list[str]:
        return [piece] if UNSURE.search(piece) else find(piece)

    return split
