"""Words and character n-grams of many texts at once, as hashes (numpy, executor side)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .text import U, span_hashes

CHARS = 1 << 18  # characters handled at a time
_MUL = 0x9FB21C651E98DF25


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    """Letters and digits among all code points."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Tokens:
    """Words (runs of letters and digits, lower case) of several texts.

    ``index[offs[d]:offs[d+1]]`` numbers the words of text d among the distinct words;
    ``hashes`` are theirs, ``chars[starts[u]:ends[u]]`` their code points.
    """

    def __init__(self, texts: list[str | None], letters_only: bool = False):
        joined = "\n".join("" if t is None else t.lower().replace("\n", " ") for t in texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        tok = (_letters() if letters_only else _alnum())[raw] if len(raw) else np.zeros(0, bool)
        edge = np.diff(np.r_[0, tok.view(np.int8), 0])
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        line = np.r_[-1, np.flatnonzero(raw == 10), len(raw)][: len(texts) + 1]
        self.offs = np.searchsorted(start, line) if texts else np.zeros(1, np.int64)
        codes = raw.astype(U) + U(1)
        h = span_hashes(codes, start, end, _MUL)
        self.hashes, first, self.index = np.unique(h, return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        n = e - s
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        self.chars = codes[np.repeat(s - self.starts, n) + np.arange(int(n.sum()))]

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, hash) of every n-gram of ``length``; one at a word's start or end differs from one inside."""
        word = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        i = np.arange(len(self.chars))
        ok = i + length <= self.ends[word]
        i, word = i[ok], word[ok]
        flags = (i == self.starts[word]).astype(U) + U(2) * (i + length == self.ends[word]).astype(U)
        return word, span_hashes(self.chars, i, i + length, _MUL) ^ (flags * U(0xA24BAED4963EE407))


def token_chunks(texts: list[str | None], letters_only: bool = False) -> Iterator[tuple[int, int, Tokens]]:
    """(first, last, tokens) over runs of texts of about ``CHARS`` characters."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= CHARS):
            size += len(texts[last] or "")
            last += 1
        yield first, last, Tokens(texts[first:last], letters_only)
        first = last
