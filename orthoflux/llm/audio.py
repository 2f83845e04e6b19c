"""Chroma fingerprints of audio columns, and their alignment.

A recording becomes frames of twelve pitch-class energies.  Sixteen box filters,
evaluated by an integral image over time and pitch class, give two bits each, packed
into one 32-bit integer per frame.  Two recordings are aligned by the histogram of
offsets between integers that are equal in their ``KEY`` bits, at all their places; of
the offsets with enough votes the most-voted one with a small share of unequal bits
(of all 32) is taken.
"""

from __future__ import annotations

import io
import math
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import own_exchange
from .storage import attempt, materialize, open_input, scratch, write_atomically

FFT, HOP = 1024, 192
LOW_HZ, HIGH_HZ = 110.0, 1800.0
#: The bits of an integer that must be equal for a vote: those of the eight longest filters, which a start between two
#: frames changes least (at half a frame 12 % of all bits differ, and whole integers are hardly ever equal).
KEY = np.uint32(0xFFFF)
#: Equal integers needed at one offset, frames of overlap, and the largest share of unequal bits.
MIN_VOTES, MIN_FRAMES, MAX_ERROR = 3, 24, 0.25
#: Query recordings of one block, of which a task holds one.
BLOCK = 4096
#: Pairs of equal runs whose votes are counted at once.
PAIRS = 1 << 20
WIDTH = 12
#: (shape, first pitch class, pitch classes, frames): shapes halve the box in time (0), in pitch (1), both ways (2) or take its middle (3).
FILTERS = tuple((k % 4, (5 * k) % 8, 2 + 2 * (k % 2) + k // 8, (4, 6, 8, 12)[k // 4]) for k in range(16))
LEVELS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of a 16-bit WAV; nothing for null or broken data."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 0
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
            return raw.reshape(-1, w.getnchannels()).mean(1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 0


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch-class shares."""
    n = (len(samples) - FFT) // HOP + 1
    if n < 1 or rate <= 0:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(FFT, 1 / rate)
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.rint(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), pitch] = 1
    out = np.empty((n, 12))
    for a in range(0, n, 512):  # frames at a time
        b = min(n, a + 512)
        frames = np.lib.stride_tricks.sliding_window_view(samples[a * HOP : (b - 1) * HOP + FFT], FFT)[::HOP]
        out[a:b] = (np.abs(np.fft.rfft(frames * np.hanning(FFT), axis=1)[:, use]) ** 2) @ fold
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.full_like(out, 1 / 12), where=total > 1e-12)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer per position at which the widest filter fits."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), 0), 1)  # pitch classes wrap around
    t = np.arange(n)

    def box(t0, t1, p0, p1):
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    code = np.zeros(n, np.uint32)
    for shape, p, h, w in FILTERS:
        q, m, half = p + h, p + h // 2, w // 2
        whole = box(0, w, p, q)
        if shape == 0:
            part = box(0, half, p, q)
        elif shape == 1:
            part = box(0, w, p, m)
        elif shape == 2:
            part = box(0, half, p, m) + box(half, w, m, q)
        else:
            part = box(w // 4, w - w // 4, p, q)
        ratio = np.log((part + 0.01) / (whole - part + 0.01)) / 2
        code = code << np.uint32(2) | GRAY[np.searchsorted(LEVELS, ratio)]
    return code


def fingerprint_media(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``(id, fp)`` with the packed integers as little-endian bytes; null, broken or short recordings have none."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                fps = [fingerprint(chroma(*decode_wav(d.as_py()))).astype("<u4").tobytes() for d in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps, pa.binary())], names=["id", "fp"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, fp binary")


def _runs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, length) of the stretches of one key: a held tone is one row."""
    key = fp & KEY
    at = np.flatnonzero(np.r_[np.ones(min(1, len(fp)), bool), key[1:] != key[:-1]])
    return key[at], at, np.diff(np.r_[at, len(fp)])


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, ascending, with the sums of their values."""
    uniq, place = np.unique(key, return_inverse=True)
    return uniq, np.bincount(place, value, len(uniq)).astype(np.int64)


class QueryBlock:
    """Fingerprints of a bounded number of queries, the runs of all their integers indexed by integer."""

    def __init__(self, ids: list[int], fps: list[bytes]):
        self.ids = ids
        self.fps = [np.frombuffer(f, "<u4") for f in fps]
        runs = [_runs(f) for f in self.fps]
        keys = np.concatenate([*(r[0] for r in runs), np.zeros(0, np.uint32)])
        place, length = (np.concatenate([*(r[c] for r in runs), np.zeros(0, np.int64)]) for c in (1, 2))
        owner = np.repeat(np.arange(len(ids)), [len(r[0]) for r in runs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place, self.length = keys[order], owner[order], place[order].astype(np.int64), length[order].astype(np.int64)

    def votes(self, fp: np.ndarray):
        """(query, offsets, votes) of the queries that have ``MIN_VOTES`` equal integers at an offset; all places vote.

        Two runs of lengths L and M vote in a trapezoid over L + M - 1 offsets, which is
        four steps of the second difference, so the work grows with runs and not with frames.
        """
        key, at, long = _runs(fp)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        span, half = 1 << 32, 1 << 31
        slices, ends = [], np.cumsum(n)
        # runs of the recording at a time, so that about PAIRS pairs of runs are held
        for rows in np.split(np.arange(len(key)), np.flatnonzero(np.diff(ends // PAIRS)) + 1):
            m = n[rows]
            pick = np.repeat(lo[rows] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            mine, theirs = np.repeat(long[rows], m), self.length[pick]
            first = self.owner[pick].astype(np.int64) * span + half + np.repeat(at[rows], m) - self.place[pick] - theirs + 1
            one = np.ones(len(pick))
            slices.append(_summed(np.concatenate([first, first + mine, first + theirs, first + mine + theirs]), np.concatenate([one, -one, -one, one])))
        point, step = _summed(np.concatenate([s[0] for s in slices]), np.concatenate([s[1] for s in slices])) if len(slices) > 1 else slices[0]
        if not len(point):
            return
        slope, gap = np.cumsum(step), np.diff(np.r_[point, point[-1] + 1])  # both sums are back at 0 where a query ends
        after = np.cumsum(slope * gap)
        before = after - slope * gap
        use = np.flatnonzero(np.maximum(before + slope, after) >= MIN_VOTES)
        for part in np.split(use, np.flatnonzero(np.diff(point[use] // span)) + 1) if len(use) else ():
            g = gap[part]
            t = np.arange(int(g.sum())) - np.repeat(np.cumsum(g) - g, g)
            votes = np.repeat(before[part], g) + np.repeat(slope[part], g) * (t + 1)
            offset = np.repeat(point[part] % span - half, g) + t
            yield int(point[part[0]] // span), offset[votes >= MIN_VOTES], votes[votes >= MIN_VOTES]

    def align(self, fp: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(query, offset, votes, frames, unequal bits) of the queries that ``fp`` aligns with: of all offsets that pass, the most-voted."""
        out = []
        for q, offset, votes in self.votes(fp):
            other = self.fps[q]
            a, b = np.maximum(0, offset), np.minimum(len(fp), len(other) + offset)
            fits = np.flatnonzero(b - a >= MIN_FRAMES)
            for k in fits[np.lexsort((offset[fits], np.abs(offset[fits]), -votes[fits]))].tolist():
                bad = int(np.bitwise_count(fp[a[k] : b[k]] ^ other[a[k] - offset[k] : b[k] - offset[k]]).sum())
                if bad <= MAX_ERROR * 32 * (b[k] - a[k]):
                    out.append((self.ids[q], int(offset[k]), int(votes[k]), int(b[k] - a[k]), bad))
                    break
        return out


_FOUND = "query_id long, match_id long, offset long, votes long, n_frames long, bit_errors long"


def _block_writer(folder: str):
    """Writes query blocks (rows in order of ``blk``), each as one file, and names them."""

    def run(batches):
        own, held, blk = attempt(), [], None

        def flush():
            uri = f"{folder}/{own}-{blk:06d}.queries"
            data = pa.table({"id": pa.array([h[0] for h in held], pa.int64()), "fp": pa.array([h[1] for h in held], pa.large_binary())})

            def write(out):
                with pa.ipc.new_file(out, data.schema) as f:
                    f.write_table(data)

            write_atomically(uri, write)
            return pa.RecordBatch.from_pydict({"uri": [uri]})

        for batch in batches:
            for k, own_id, fp in zip(*(batch.column(c).to_pylist() for c in ("blk", "id", "fp")), strict=True):
                if held and k != blk:
                    yield flush()
                    held = []
                blk = k
                held.append((own_id, fp))
        if held:
            yield flush()

    return run


def _load_block(uri: str) -> QueryBlock:
    with open_input(uri) as f:
        t = pa.ipc.open_file(f).read_all()
    return QueryBlock(t.column("id").to_pylist(), t.column("fp").to_pylist())


def align_recordings(prints: DataFrame, every: int = 100) -> DataFrame:
    """Align the recordings whose id is divisible by ``every`` with all recordings.

    ``prints(id, fp)`` -> ``(kind, query_id, match_id, offset, votes, n_frames, bit_errors)``.
    Recordings with equal fingerprints are one class named by its least id.  Rows of kind
    ``alignment`` are pairs of classes, of which the first holds a query; a query's class
    is paired with itself too.  Rows of kind ``member``, one for each recording that has
    a fingerprint, name the class (``query_id``) of a recording (``match_id``), so every
    pair of recordings can be read off without all pairs of copies being listed.  Null
    ids, recordings without fingerprint, and alignments of fewer than ``MIN_FRAMES``
    frames give no alignment; an empty table gives no rows.

    The queries are written in blocks of about ``BLOCK`` into the shared folder.  A task
    takes the blocks one after the other for each batch of its recordings, so it holds
    one block and one batch, and the driver holds the names of the blocks only.
    """
    spark = prints.sparkSession
    known = materialize(prints.where("id IS NOT NULL AND octet_length(fp) > 0").select("id", "fp", F.sha2("fp", 256).alias("sha")), "prints")
    # the members of a class meet in no task: only the hash is grouped, and the fingerprint taken of the least id
    classes = materialize(known.groupBy("sha").agg(F.min("id").alias("class"), F.max((F.col("id") % every == 0).cast("int")).alias("is_query")), "classes")
    lead = own_exchange(classes.select("sha", F.col("class").alias("id"), "is_query"), "sha", "id")
    firsts = materialize(known.join(lead, ["sha", "id"]).dropDuplicates(["sha", "id"]).select("id", "fp", "is_query"), "firsts")
    queries = firsts.where("is_query = 1").select("id", "fp")
    n_blocks = max(1, math.ceil(queries.count() / BLOCK))
    dealt = queries.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).repartition(n_blocks, "blk").sortWithinPartitions("blk", "id")
    named = materialize(dealt.mapInArrow(_block_writer(scratch(spark, "queries")), "uri string"), "blocks")
    uris = sorted(r["uri"] for r in named.collect())  # one name for BLOCK queries
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            own = [(i, np.frombuffer(f, "<u4")) for i, f in zip(batch.column("id").to_pylist(), batch.column("fp").to_pylist(), strict=True)]
            for uri in uris:
                block = _load_block(uri) if len(uris) > 1 else only_block(uri)
                out = [(q, i, *rest) for i, fp in own for q, *rest in block.align(fp)]
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    pairs = firsts.select("id", "fp").mapInArrow(run, _FOUND).select(F.lit("alignment").alias("kind"), *names)
    members = known.select("id", "sha").join(own_exchange(classes.select("sha", "class"), "sha"), "sha")
    nothing = [F.lit(None).cast("long").alias(c) for c in names[2:]]
    return pairs.unionByName(members.select(F.lit("member").alias("kind"), F.col("class").alias("query_id"), F.col("id").alias("match_id"), *nothing))


@lru_cache(maxsize=1)
def only_block(uri: str) -> QueryBlock:
    """A single block stays in the worker."""
    return _load_block(uri)


def render_melodies(table: DataFrame, id_col: str, vector_col: str, rate: int = 4096, note: int = 192) -> DataFrame:
    """``(id, media)``: every vector as a WAV, one note for each number (test tables hold no audio)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                media = []
                for v in part.column(1).to_pylist():
                    x = np.nan_to_num(np.array([0.0 if a is None else a for a in v or []], float))
                    scale = np.abs(x).max() if len(x) else 0
                    steps = np.rint(x / scale * 12) if scale > 0 else np.zeros(len(x))
                    hz = np.repeat(440.0 * 2 ** (steps / 12), note)
                    phase = 2 * np.pi * np.cumsum(hz) / rate
                    media.append(encode_wav(0.5 * np.sin(phase) + 0.1 * np.sin(2 * phase), rate))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])

    return table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, media binary")
