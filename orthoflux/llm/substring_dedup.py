"""Repeated passages across documents by level-wise doubling.

A window is ``window`` consecutive words of one document; it goes where its word
sequence also starts in a document with a lesser id.  Each level looks at windows of
twice the length of the level before, and only at those whose two halves were both
found in another text; it begins with seeds of half a window and ends when no
candidate survives, so the last level that a document reaches tells how long its
longest repeated passage is.

Documents of equal text are one text with a least and a greatest id from the start: all
but the first of them go, if they hold a window, and what holds for the text holds for
each.  Inside a level windows are not compared one by one.  Each is represented by the
*seed* (a window of half the length) of least hash inside it, so equal windows always
have equal seeds and about two in ``length / 2 + 2`` positions are shuffled.
Consecutive windows with one seed form a *block*.  Blocks of equal content are one
class, counted by partial aggregation, and what holds for a class holds for all windows
of its blocks.  Only where a seed stands in classes of different content are single
windows compared, for the first text of each class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import own_exchange
from .storage import keep, materialize, scope
from .text import WORD_MUL, Words, chunks, span_hashes, words_of


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """For each k, the leftmost index of the least of v[k : k + width]."""
    idx, have = np.arange(len(v)), 1
    while have < width and len(idx):
        step = min(have, width - have)
        left, right = idx[: max(0, len(idx) - step)], idx[step:]
        idx = np.where(v[left] <= v[right], left, right)
        have += step
    return idx


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), values)


def _marked(words: Words, ranges: pa.Array) -> np.ndarray:
    """True at the words (of all documents) where one of the document's ranges has a start."""
    edge = np.zeros(len(words.hashes[0]) + 1, np.int64)
    flat, doc = ranges.flatten(), np.repeat(np.arange(len(ranges)), ranges.value_lengths().fill_null(0).to_numpy())
    np.add.at(edge, words.offs[doc] + flat.field("lo").to_numpy(), 1)
    np.add.at(edge, words.offs[doc] + flat.field("hi").to_numpy() + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _seeds(length: int):
    """Blocks of the candidate windows of ``length`` words: a document's third column holds where windows of half the
    length were found in another document (no such column: every window is a candidate)."""
    half = (length + 1) // 2

    def run(batches):
        for batch in batches:
            for first, last, buf, offs in chunks(batch.column("text")):
                w = words_of(buf, offs, hashes=2)
                p, h = w.windows(half)
                a = _least(h, length - half + 1)
                n = np.diff(w.offs)
                doc = np.repeat(np.arange(last - first), n)[p[: len(a)]]
                ok = p[: len(a)] + length <= w.offs[1:][doc]
                if "ranges" in batch.schema.names:
                    found = np.r_[_marked(w, batch.column("ranges").slice(first, last - first)), np.zeros(length, bool)]
                    ok &= found[p[: len(a)]] & found[p[: len(a)] + length - half]
                a, doc, p = a[ok], doc[ok], p[: len(ok)][ok]
                new = np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)][: len(a)]
                k0 = np.flatnonzero(new)
                k1 = np.r_[k0[1:], len(a)][: len(k0)] - 1
                body = span_hashes(w.hashes[1], p[k0], p[k1] + length, WORD_MUL[1])
                counts = np.bincount(doc[k0], minlength=last - first)
                base = w.offs[:-1][doc[k0]]
                lists = (h[a[k0]].view(np.int64), body.view(np.int64), (p[k0] - base).astype(np.int32), (p[k1] - base).astype(np.int32))
                own = [batch.column(c).slice(first, last - first) for c in _TEXT]
                yield pa.RecordBatch.from_arrays([*own, *(_lists(v, counts) for v in lists)], names=[*_TEXT, "seed", "body", "lo", "hi"])

    return run


def _expand(length: int):
    """Full-length hashes (128 bits) of the windows that start in the given ranges."""

    def run(batches):
        for batch in batches:
            for first, last, buf, offs in chunks(batch.column("text")):
                w = words_of(buf, offs, hashes=2)
                p = np.flatnonzero(_marked(w, batch.column("ranges").slice(first, last - first)))
                doc = np.searchsorted(w.offs, p, side="right") - 1
                h1, h2 = (span_hashes(h, p, p + length, m).view(np.int64) for h, m in zip(w.hashes, WORD_MUL, strict=True))
                own = [batch.column(c).slice(first, last - first).take(pa.array(doc)) for c in _TEXT]
                start = pa.array((p - w.offs[doc]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*own, start, pa.array(h1), pa.array(h2)], names=[*_TEXT, "p", "h1", "h2"])

    return run


def _cut(window: int):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, longest, kept, spans = [], [], [], []
                for text, found, reached, copied, later in zip(part.column("text").cast(pa.binary()), *(part.column(c).to_pylist() for c in ("spans", "longest", "copied", "later")), strict=True):
                    words = (text.as_py() or b"").split()
                    n_words.append(len(words))
                    length = window
                    while copied and length <= len(words):  # the whole text stands elsewhere
                        reached, length = length, 2 * length
                    longest.append(reached)
                    merged: list[list[int]] = [[0, len(words)]] if later and len(words) >= window else []
                    for r in sorted((r["lo"], r["hi"]) for r in found or ()) if not merged else ():
                        if merged and r[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r[1])
                        else:
                            merged.append([*r])
                    rest, to = [], 0
                    for a, b in merged:
                        rest += words[to:a]
                        to = b
                    kept.append(b" ".join(rest + words[to:] if merged else words))
                    spans.append([{"first": a, "last": b - 1} for a, b in merged])
                values = [part.column("id"), pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(values, names=["id", "n_words", "longest", "removed", "kept_text"])

    return run


#: A text: two hashes of it (96 bits), and the least and greatest id of the documents that have it.
_TEXT = ["t1", "t2", "first", "last"]
_TEXT_TYPES = "t1 long, t2 int, first long, last long"
_KEY = _TEXT[:2]


def _placed(seeds: DataFrame) -> DataFrame:
    """Blocks ``(*_TEXT, lo, hi)`` whose seed stands in two documents or more, with what is known of their class: the least
    (``one``) and greatest (``top``) id, whether other texts hold it (``shared``), and how many classes have the seed."""
    # blocks of equal content are one row from here on
    ends = F.min("first").alias("one"), F.max("last").alias("top"), (F.min("t1") < F.max("t1")).alias("shared")
    classes = seeds.groupBy("seed", "body").agg(*ends)
    again = classes.groupBy("seed").agg(F.min("one").alias("a"), F.max("top").alias("z"), F.count(F.lit(1)).alias("n_bodies")).where("a < z")
    alive = classes.join(own_exchange(again.drop("a", "z"), "seed"), "seed").where("n_bodies > 1 OR (one < top AND shared)")
    placed = seeds.join(own_exchange(alive, "seed", "body"), ["seed", "body"])
    return materialize(placed.select(*_TEXT, "lo", "hi", "one", "top", "shared", "n_bodies"), "placed")


def _singles(placed: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Single windows ``(*_TEXT, p, one)`` that start in two documents or more, of classes that share a seed and differ:
    those of the first text of each class."""
    loose = placed.where("first = one AND n_bodies > 1").groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    chosen = texts.select(*_TEXT, "text").join(loose, _KEY)
    windows = materialize(chosen.mapInArrow(_expand(length), f"{_TEXT_TYPES}, p int, h1 long, h2 long"), "windows")
    ends = F.min("first").alias("one"), F.max("last").alias("top"), (F.min("t1") < F.max("t1")).alias("shared")
    again = windows.groupBy("h1", "h2").agg(*ends).where("one < top AND shared").select("h1", "h2", "one")
    return windows.join(own_exchange(again, "h1", "h2"), ["h1", "h2"]).select(*_TEXT, "p", "one")


def _starts(placed: DataFrame, single: DataFrame) -> DataFrame:
    """Where windows start that another text of another document holds too: ``(t1, t2, ranges)``."""
    found = placed.where("one < top AND shared").select(*_KEY, "lo", "hi")
    both = found.unionByName(single.select(*_KEY, F.col("p").alias("lo"), F.col("p").alias("hi")))
    return both.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


_SEEDED = f"{_TEXT_TYPES}, seed array<long>, body array<long>, lo array<int>, hi array<int>"
_BLOCKS = "inline(arrays_zip(seed, body, lo, hi))"


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``(id_col, n_words, longest, removed, kept_text)``, one row for each row of ``docs``.

    ``removed`` holds the merged spans of words that go (first and last word, from
    0), ``kept_text`` the other words joined by one space.  ``longest`` is the greatest
    of ``window``, ``2 * window``, ``4 * window`` and so on such that so many words in a
    row of this document start in another one too, 0 if none.  Null and blank texts
    have no words; rows with a null id are neither earlier nor later than any document
    and stay whole; equal ids are not earlier than each other, and rows of one id with
    different texts are judged one by one.  Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t1"), F.hash(text_col).alias("t2"), F.col(text_col).alias("text"))
    known = base.where("id IS NOT NULL")
    with scope(spark) as own:
        with scope(spark) as inner:
            every = known.select("t1", "t2", F.col("id").alias("first"), F.col("id").alias("last"), "text")
            lists = [F.first(c).alias(c) for c in ("seed", "body", "lo", "hi")]
            seeded = every.mapInArrow(_seeds(window), _SEEDED).where("size(seed) > 0").groupBy(*_KEY).agg(F.min("first").alias("first"), F.max("last").alias("last"), *lists)
            seeded = materialize(seeded, "seeds")
            placed = _placed(seeded.select(*_TEXT, F.expr(_BLOCKS)))
            lead = placed.select(*_TEXT, F.col("first").alias("id")).distinct()
            # the texts of this level and all above: of each one document's, which is looked up by its id
            texts = known.join(lead, ["id", *_KEY]).groupBy("id", *_TEXT).agg(F.first("text").alias("text"))
            texts = keep(texts.drop("id"), "texts", inner)
            single = materialize(_singles(placed, texts, window), "single")
            gone = placed.where("first > one").select(*_KEY, "lo", F.col("hi").alias("end"))
            gone = gone.unionByName(single.where("first > one").select(*_KEY, F.col("p").alias("lo"), F.col("p").alias("end")))
            spans = F.collect_set(F.struct("lo", (F.col("end") + window).alias("hi"))).alias("spans")
            gone = keep(gone.groupBy(*_KEY).agg(spans), "spans", inner)
            copies = keep(seeded.where("first < last").select(*_TEXT), "copies", inner)
            starts = keep(_starts(placed, single), "starts", inner)
        length, reached = window, starts.select(*_KEY, F.lit(window).cast("long").alias("longest"))
        while True:
            # a window of twice the length needs starts that are a length apart
            wide = starts.where(F.array_max("ranges.hi") - F.array_min("ranges.lo") >= length)
            if wide.isEmpty():
                break
            length *= 2
            with scope(spark) as inner:
                texts = keep(texts.join(wide, _KEY).select(*_TEXT, "text", "ranges"), "texts", inner)
                seeded = materialize(texts.mapInArrow(_seeds(length), _SEEDED).where("size(seed) > 0"), "seeds")
                placed = _placed(seeded.select(*_TEXT, F.expr(_BLOCKS)))
                starts = keep(_starts(placed, _singles(placed, texts, length)), "starts", inner)
                texts = texts.drop("ranges")
            reached = reached.unionByName(starts.select(*_KEY, F.lit(length).cast("long").alias("longest")))
        reached = reached.groupBy(*_KEY).agg(F.max("longest").alias("longest"))
        told = reached.join(gone, _KEY, "full").join(copies, _KEY, "full")
        # what is known of a text goes to its documents by hashes alone; texts then meet only what is said of their own id
        lean = known.select("id", *_KEY).distinct().join(own_exchange(told, *_KEY), _KEY)
        later = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("later")
        spans = F.when(~later, F.col("spans")).alias("spans")
        found = keep(lean.select("id", *_KEY, F.col("first").isNotNull().alias("copied"), later, spans, "longest"), "found", own)
    joined = base.join(own_exchange(found, "id", *_KEY), ["id", *_KEY], "left")
    out = joined.select("id", "text", "spans", F.coalesce("longest", F.lit(0)).alias("longest"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("copied", "later")))
    done = out.mapInArrow(_cut(window), "id long, n_words long, longest long, removed array<struct<first:int,last:int>>, kept_text string")
    return done.withColumnRenamed("id", id_col)
