"""Token-id files with Elias-Fano document boundaries.

A file holds, little-endian: an 8-byte magic, a header of 64-bit numbers (see
``HEADER``), two Elias-Fano sequences (the end of every document in the id array, and
the document ids less their least), and the id array (2 or 4 bytes an id, by
vocabulary).  Lower bits are packed; upper bits are unary.  The file also holds the
place of every ``SAMPLE``-th one among the upper bits, in 32 bits each, and for every
2**32 upper bits the number of samples before them.  ``select`` is a look-up and a scan of few
bytes; readers go through it a block of documents at a time, and no table of all
offsets is ever made.
"""

from __future__ import annotations

import array
import os
import struct
import sys
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import attempt, materialize, open_input, scratch, write_atomically
from .text import CHUNK, U, chunks, words_of

MAGIC = b"OFTOKEF1"
HEADER = ("n_docs", "n_ids", "id_bytes", "n_null", "first_id", "ends_bytes", "docs_bytes")
SAMPLE = 256
#: Ids of one file; a longer document makes one longer file.
FILE_IDS = 1 << 23
#: Bytes of text in one range of ids, where the session's number of partitions does not make them smaller.
RANGE_BYTES = 128 << 20
#: Documents whose bounds a reader holds at once.
READ_DOCS = 4096
#: Words remembered by one worker (about 36 bytes each, and as much again while new ones go in) and word parts (about
#: 200); beyond that it starts anew.  Workers are reused, so what they remember stays while other stages run.
CACHE_WORDS, CACHE_PIECES = 1 << 19, 1 << 16


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(u / n) bits each, and 32 / SAMPLE for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, bases: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples, self.bases = n, low_bits, low, high, samples, bases

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = (values & ((1 << low_bits) - 1)).astype("<u8")
        low = np.zeros(0, np.uint8)
        if n:
            low = np.packbits(np.unpackbits(lows.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits].reshape(-1), bitorder="little")
        place = (values >> low_bits) + np.arange(n)
        high = np.zeros((n + (top >> low_bits) + 8) >> 3, np.uint8)
        np.bitwise_or.at(high, place >> 3, (1 << (place & 7)).astype(np.uint8))
        kept = place[::SAMPLE]
        bases = np.searchsorted(kept >> 32, np.arange(1, (int(kept[-1]) >> 32) + 1)) if n else np.zeros(0)
        return cls(n, low_bits, low, high, (kept & 0xFFFFFFFF).astype("<u4"), bases.astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = self.low, self.high, self.samples, self.bases
        return struct.pack("<6Q", self.n, self.low_bits, *map(len, parts)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, *sizes = struct.unpack_from("<6Q", data)
        parts, at = [], 48
        for size, kind in zip(sizes, ("u1", "u1", "<u4", "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * parts[-1].itemsize
        return cls(n, low_bits, *parts)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def _places(self, first: int, last: int) -> np.ndarray:
        """Places of ones number ``first`` to ``last - 1`` among the upper bits: from the sampled one before, scanned piece by piece."""
        k = first // SAMPLE
        start = (int(np.searchsorted(self.bases, k, "right")) << 32) + int(self.samples[k])
        skip, want = first - k * SAMPLE, last - first
        byte, found, have = start >> 3, [], 0
        step = 64 + want // 4
        while have < want:
            bits = np.unpackbits(self.high[byte : byte + step], bitorder="little")
            if byte == start >> 3:
                bits[: start & 7] = 0
            ones = np.flatnonzero(bits)
            mine = ones[skip : skip + want - have]
            skip = max(0, skip - len(ones))
            found.append(mine + byte * 8)
            have += len(mine)
            byte += step
        return np.concatenate(found)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1``, by one select and a scan from there."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        i = np.arange(first, last)
        return ((self._places(first, last) - i) << self.low_bits) | self._low(i)


def write_file(uri: str, doc_ids: list, counts: list[int], ids: list[bytes], id_bytes: int) -> None:
    """Documents in ascending id order, null ids last; ``ids`` are their id arrays as bytes.

    Ids of one file must span less than 2**63.
    """
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    if len(known) and int(known[-1]) - first >= 1 << 63:
        raise ValueError("ids of one file span 2**63 or more")
    ends = EliasFano.of(np.cumsum(counts)).to_bytes()
    docs = EliasFano.of(known - first).to_bytes()
    head = struct.pack(f"<{len(HEADER)}q", len(counts), int(sum(counts)), id_bytes, len(doc_ids) - len(known), first, len(ends), len(docs))

    def write(out):
        for piece in (MAGIC, head, ends, docs, *ids):
            out.write(piece)

    write_atomically(uri, write)


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        self._in = open_input(uri)
        head = self._in.read(8 + 8 * len(HEADER))
        if head[:8] != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        for k, v in zip(HEADER, struct.unpack_from(f"<{len(HEADER)}q", head, 8), strict=True):
            setattr(self, k, v)
        self.ends = EliasFano.from_bytes(self._in.read(self.ends_bytes))
        self.docs = EliasFano.from_bytes(self._in.read(self.docs_bytes))
        self._at = len(head) + self.ends_bytes + self.docs_bytes

    def doc_ids(self, first: int, last: int) -> list:
        """Ids of documents ``first`` to ``last - 1``; those without id come last."""
        known = self.docs.select_range(min(first, self.docs.n), min(last, self.docs.n))
        return [*(known + self.first_id).tolist(), *[None] * (last - first - len(known))]

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last - 1`` begin in the id array, and where the last one ends."""
        ends = self.ends.select_range(max(0, first - 1), last)
        return np.r_[0, ends] if first == 0 else ends

    def read(self, start: int, end: int) -> np.ndarray:
        self._in.seek(self._at + start * self.id_bytes)
        return np.frombuffer(self._in.read((end - start) * self.id_bytes), "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.read(*self.bounds(i, i + 1).tolist())

    def close(self) -> None:
        self._in.close()


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stay, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class WordEncoder:
    """Encodes texts word by word with a ``tokenizers`` file whose pre-tokenizer drops white space.

    Such a tokenizer never joins what white space parts, so a text's ids are those of
    its words in order and every distinct word is encoded once.  Words of many texts are
    hashed and looked up at once in a sorted table of hashes, and their ids gathered
    from one array.  Where the file has the known form (a removing ``Split`` and
    ``ByteLevel``), word parts go straight to the library's BPE model; other words, and
    files of another form, go through the library's ``encode``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"]
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec.get("added_tokens", [])) or r"(?!)")
        self.marked = not any(x["content"].isalpha() for x in spec.get("added_tokens", []))
        if self.by_word:
            self.parts = regex.compile(pre[0]["pattern"]["Regex"])
            self.space = regex.compile(r"\s")
            self.letters = _byte_letters()
            self.model = self.tok.model
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Known words: sorted hashes, a second hash of each to tell chance hits, and where their ids are."""
        self.keys, self.checks = np.zeros(0, U), np.zeros(0, U)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def _bytes(self, ids: list[int]) -> bytes:
        return array.array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        as_bytes = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        got = self.pieces[piece] = self._bytes([t.id for t in self.model.tokenize(as_bytes)])
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha() and self.marked:  # ASCII letters only
            low = text.lower()
            return self.pieces.get(low) or self._piece(low)
        if self.special.search(text):
            return self._whole(text)
        if text.isascii() or (max(text) < "\u0180" and "\u0130" not in text and unicodedata.is_normalized("NFC", text)):
            # up to here lower case is a matter of single letters, as in the library
            low = text.lower()
            if low.isalpha():
                return self.pieces.get(low) or self._piece(low)
            if self.space.search(low):
                return self._whole(text)
        else:
            low = self.tok.normalizer.normalize_str(text)
            if self.space.search(low):
                return self._whole(text)
        if not low.isprintable():
            return self._whole(text)
        pieces = self.pieces
        return b"".join([pieces.get(p) or self._piece(p) for p in self.parts.findall(low)])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each sorted key among the known words, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        own = list(map(self._word, words))
        size = np.array(list(map(len, own)), np.int32) // self.dtype.itemsize
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        place = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("checks", checks), ("at", at), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(own), self.dtype)])

    def _chunk(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        w = words_of(buf, offs, hashes=2)
        if not len(w.starts):
            return [b""] * (len(offs) - 1)
        keys, first, place = np.unique(w.hashes[0], return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._forget()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        new = np.flatnonzero(self._find(keys) < 0)
        if len(new):
            raw, own = buf.tobytes(), first[new]
            self._learn(keys[new], w.hashes[1][own], [raw[a:b] for a, b in zip(w.starts[own].tolist(), w.ends[own].tolist(), strict=True)])
        row = self._find(keys)[place]
        if (self.checks[row] != w.hashes[1]).any():  # two words of one hash: each by itself
            raw = buf.tobytes()
            return [b"".join(map(self._word, raw[a:b].split())) for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
        size = self.size[row]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.at[row] - ends + size, size) + np.arange(int(ends[-1]))]
        cut = np.r_[0, ends][w.offs].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]

    def encode_all(self, texts: pa.Array):
        """The ids of every text as little-endian bytes, in order."""
        if not self.by_word:
            for text in texts.to_pylist():
                yield self._whole(text) if text else b""
            return
        for _, _, buf, offs in chunks(texts, CHUNK):
            yield from self._chunk(buf, offs)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return next(iter(self.encode_all(pa.array([text], pa.string()))))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _writer(folder: str, path: str, end_id: int, file_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, own_name, n = TaskContext.get().partitionId(), attempt(), 0
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        docs, counts, ids, held = [], [], [], 0

        def flush():
            nonlocal docs, counts, ids, held, n
            uri = f"{folder}/{own_name}-{n:06d}.ids"
            write_file(uri, docs, counts, ids, enc.dtype.itemsize)
            row = [[part], [n], [uri], [len(docs)], [held]]
            docs, counts, ids, held, n = [], [], [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "uri", "n_docs", "n_ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                for d, own in zip(piece.column(0).to_pylist(), enc.encode_all(piece.column(1)), strict=True):
                    docs.append(d)
                    ids += own, end
                    counts.append(len(own) // enc.dtype.itemsize + 1)
                    held += counts[-1]
                    if held >= file_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` in ascending id order (null ids last, repeated rows kept) and return the
    manifest ``(part, file, uri, n_docs, n_ids, start)`` of the files, ``start`` being the ids before each.

    Rows of one id, and rows without, come in order of a hash of their texts, which
    also spreads them over tasks.  Null texts count as empty: they hold the end id only.
    An empty table gives no file and an empty manifest.  Other columns are ignored.
    Files are named by task attempt and listed by the attempt that was committed, so
    a retried or speculative task never replaces what the manifest names.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    order = F.col("id").asc_nulls_last(), F.col("th")
    ranged = base.withColumn("th", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    manifest = materialize(ranged.select("id", "text").mapInArrow(_writer(folder, tokenizer, end_id, file_ids), "part int, file int, uri string, n_docs long, n_ids long"), "manifest")
    ahead = W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))


def _reader(digest_block: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["uri"])
                for lo in range(0, f.n_docs, READ_DOCS):
                    hi = min(lo + READ_DOCS, f.n_docs)
                    at = f.bounds(lo, hi)
                    crcs, first = [], 0
                    while first < hi - lo:  # documents of about digest_block ids at a time
                        last = max(first + 1, int(np.searchsorted(at, at[first] + digest_block, side="right")) - 1)
                        block = f.read(int(at[first]), int(at[last]))
                        crcs += [zlib.crc32(block[at[i] - at[first] : at[i + 1] - at[first]].data) for i in range(first, last)]
                        first = last
                    values = f.doc_ids(lo, hi), at[:-1] + row["start"], np.diff(at), crcs
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["id", "start", "n_tokens", "ids_crc32"])
                f.close()

    return run


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", block: int = 1 << 20) -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` of every document, from the files."""
    n = max(1, min(manifest.count(), 1_000_000))
    files = manifest.select("uri", "start").repartition(n, "uri")
    return files.mapInArrow(_reader(block), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
