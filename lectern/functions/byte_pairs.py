"""Tokens of a byte-pair vocabulary, for counting and cutting texts as the model that reads them does."""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import regex

#: Words whose tokens are remembered, and how many bytes they may have.
MEMO, MEMO_BYTES = 1 << 16, 64


class BytePairTokens:
    """Counts and cuts by the ranks of a byte-pair vocabulary; pattern parts a text into words before bytes are merged.

    Inside a word the neighbouring parts whose joined bytes have the lowest rank are joined first, the leftmost of equal ones, until no
    two parts make a token. A part that is no token counts as one for each byte. Texts joined by white space may have fewer tokens than both have.
    """

    additive = False

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._words, self._memo = regex.compile(pattern), {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairTokens:
        """A vocabulary of lines with a token in base 64 and its rank."""
        with open(path, "rb") as file:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}, pattern)

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _parts(self, word: bytes) -> list[bytes]:
        found = self._memo.get(word)
        if found is None:
            found = [word] if word in self.ranks else self._merged(word)
            if len(word) <= MEMO_BYTES:
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                self._memo[word] = found
        return found

    def _merged(self, word: bytes) -> list[bytes]:
        """Joins from the lowest rank up; a heap has the joins that may come, those that came to nothing are passed over."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a byte; 0: no part begins there
        joins = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (rank := self.ranks.get(word[a : end[b]])) is not None:
                heappush(joins, (rank, a, end[b]))

        for a in range(n - 1):
            if (rank := self.ranks.get(word[a : a + 2])) is not None:
                joins.append((rank, a, a + 2))
        heapify(joins)
        while joins:
            _, a, stop = heappop(joins)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [word[a : end[a]] for a in range(n) if end[a]]

    def split(self, text: str) -> list[bytes]:
        """The tokens as bytes; joined they are the text."""
        return [part for word in self._words.findall(text) for part in self._parts(word.encode())]

    def count(self, text: str) -> int:
        return sum(len(self._parts(word.encode())) for word in self._words.findall(text))

    @staticmethod
    def join(parts: list[bytes]) -> str:
        """Tokens as text; a character of which only some bytes are there becomes a replacement sign."""
        return b"".join(parts).decode("utf-8", "replace")
