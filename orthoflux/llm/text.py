"""Vectorised word hashing over Arrow string buffers (numpy, executor side).

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``; as these
are ASCII, byte runs and character runs agree in UTF-8.  Hashes are polynomial
prefix sums modulo 2**64 with odd multipliers, so the hash of any run of words is
two look-ups and a multiplication, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_MUL = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time: hashing holds some 70 bytes a byte, and tables of powers as long stay in the worker.
CHUNK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``mul**i`` and ``mul**-i`` modulo 2**64 for i < n, kept for reuse."""
    have = _powers.get(mul)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for m in (mul, pow(mul, -1, 1 << 64)):
            a = np.full(size, m, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if size <= 1 << 22:
            _powers[mul] = have
    return have


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, mul: int) -> np.ndarray:
    """Mixed hash of ``values[start:end]`` for each pair; equal for equal content at any place."""
    up, down = powers(mul, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))


def _segment(buf: np.ndarray, offs: np.ndarray, muls: tuple[int, ...]):
    n = len(buf)
    tok = ~SPACE[buf]
    before = np.zeros(n, bool)
    before[1:] = tok[:-1]
    after = np.zeros(n, bool)
    after[:-1] = tok[1:]
    cut = offs[(offs > 0) & (offs < n)]
    before[cut] = False
    after[cut - 1] = False
    start, end = np.flatnonzero(tok & ~before), np.flatnonzero(tok & ~after) + 1
    wide = buf.astype(U) + U(1)
    return start, end, [span_hashes(wide, start, end, m) for m in muls]


class Words:
    """Words of several documents: ``offs[d]:offs[d+1]`` are those of document d; ``starts`` and ``ends`` are their bytes."""

    def __init__(self, offs: np.ndarray, hashes: list[np.ndarray], starts: np.ndarray, ends: np.ndarray):
        self.offs, self.hashes, self.starts, self.ends = offs, hashes, starts, ends

    def windows(self, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start positions (over all documents) and hashes of all windows inside a document."""
        h = self.hashes[which]
        n = np.diff(self.offs)
        last = np.repeat(self.offs[1:], n)  # end of the document that holds each word
        p = np.arange(len(h))
        p = p[p + length <= last]
        return p, span_hashes(h, p, p + length, WORD_MUL[which])


def words_of(buf: np.ndarray, offs: np.ndarray, hashes: int = 1, lower: bool = False) -> Words:
    """Hash the words of documents ``buf[offs[d]:offs[d+1]]``; a long document is hashed in
    pieces cut at white space, so memory follows the words and not the byte sums."""
    if lower:
        buf = LOWER[buf]
    cuts, at = [0], 0
    while len(buf) - at > CHUNK:
        doc = int(np.searchsorted(offs, at + CHUNK, side="right")) - 1
        if offs[doc] > at:
            at = int(offs[doc])
        else:
            tail = np.flatnonzero(SPACE[buf[at + CHUNK : at + 2 * CHUNK]])
            if not len(tail):
                tail = np.flatnonzero(SPACE[buf[at + CHUNK :]])
            if not len(tail):
                break
            at = min(at + CHUNK + int(tail[0]) + 1, int(offs[doc + 1]))
        cuts.append(at)
    cuts.append(len(buf))
    starts, ends, parts = [], [], [[] for _ in range(hashes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        lo, hi = np.searchsorted(offs, [a, b])
        s, e, hs = _segment(buf[a:b], offs[lo : hi + 1] - a, BYTE_MUL[:hashes])
        starts.append(s + a)
        ends.append(e + a)
        for part, h in zip(parts, hs, strict=True):
            part.append(h)
    start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    return Words(np.searchsorted(start, offs), [np.concatenate(p) if p else np.zeros(0, U) for p in parts], start, end)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents of about ``size`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, side="right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last
