"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its own bucket and of its character n-grams; a
text segment is the mean of its words; a linear softmax scores the segment.  Vectors
and softmax are trained jointly (Adam, numpy, on the driver) on a bounded sample of
labelled rows, so a misspelling never seen shares the n-grams of what was.  A
document is as toxic as its worst segment; a two-parameter logistic curve, fitted on
rows kept aside, turns that into a probability at the true share of toxic rows.

As all is linear up to the softmax, scoring needs one number per bucket: the whole
model is an array of ``2 ** BITS`` floats, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import with_text
from .subwords import Tokens, token_chunks
from .text import U

BITS, DIM, LENGTHS = 18, 8, (3, 4, 5)
SEGMENT, LEAST = 20, 8
#: Labelled rows used for fitting, at most so many of each label (by hash order of the id).
SAMPLE = {1: 1200, 0: 1800}
#: Labelled texts of more characters are not fitted on, so the sample is bounded in bytes too.
SAMPLE_CHARS = 100_000
EPOCHS, ROUNDS, RATE, DECAY = 18, 3, 0.15, 5e-6
THRESHOLD = 0.3


def _bags(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, bucket) pairs: words in the lower half of the table, n-grams in the upper."""
    half = U(1 << (BITS - 1))
    words, buckets = [np.arange(len(tokens.hashes))], [(tokens.hashes % half).astype(np.int64)]
    for n in LENGTHS:
        w, h = tokens.grams(n)
        words.append(w)
        buckets.append((h % half + half).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


def _segments(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of every word, text of every segment, divisor of every segment: even parts of about SEGMENT words."""
    n = np.diff(offs)
    parts = np.where(n > 0, np.maximum(1, np.rint(n / SEGMENT).astype(np.int64)), 0)
    base = np.cumsum(parts) - parts
    inside = np.arange(int(n.sum())) - np.repeat(offs[:-1] - offs[0], n)
    seg = np.repeat(base, n) + inside * np.repeat(parts, n) // np.maximum(1, np.repeat(n, n))
    text = np.repeat(np.arange(len(n)), parts)
    return seg, text, np.maximum(LEAST, np.bincount(seg, minlength=len(text)))


def _distinct(seg: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and word of every distinct pair: a word repeated over and over says no more than once."""
    key = np.unique(seg * n + index)
    return key // n, key % n


class ToxicityModel:
    """Bucket scores, bias and calibration."""

    def __init__(self, scores: np.ndarray, bias: float, curve: tuple[float, float, float], prior: float):
        self.scores, self.bias, self.curve, self.prior = scores, bias, curve, prior

    def worst(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Largest segment logit and number of segments of each text (NaN and 0 without words)."""
        top, count = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
        for first, last, t in token_chunks(texts):
            if not len(t.index):
                continue
            word, bucket = _bags(t)
            of_word = np.bincount(word, self.scores[bucket], len(t.hashes)) / np.bincount(word, minlength=len(t.hashes))
            seg, text, size = _segments(t.offs)
            seg, index = _distinct(seg, t.index, len(t.hashes))
            logit = np.bincount(seg, of_word[index], len(text)) / size + self.bias
            lead = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            top[first + text[lead]] = np.maximum.reduceat(logit, lead)
            count[first:last] = np.bincount(text, minlength=last - first)
        return top, count

    def score(self, texts: list[str | None]) -> np.ndarray:
        top, n = self.worst(texts)
        a, b, c = self.curve
        p = 1 / (1 + np.exp(-np.clip(a * top + b + c * np.log(np.maximum(n, 1)), -30, 30)))
        return np.where(np.isnan(top), min(self.prior, THRESHOLD / 2), p)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted, slightly shrunk logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - 1e-3 * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hess, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _vocabulary(texts: list[str | None]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of distinct words, word of every token, offsets of texts, and word and bucket of every subword), a chunk of texts at a time."""
    seen, hashes, tokens, counts, words, buckets, base = np.zeros(0, U), [], [], [], [], [], 0
    for _, _, t in token_chunks(texts):
        new = ~np.isin(t.hashes, seen)
        w, b = _bags(t)
        own = new[w]
        words.append((w[own] + base).astype(np.int32))
        buckets.append(b[own].astype(np.int32))
        tokens.append((t.index + base).astype(np.int64))
        hashes.append(t.hashes)
        counts.append(np.diff(t.offs))
        seen = np.union1d(seen, t.hashes)
        base += len(t.hashes)
    if not base:
        return 0, *[np.zeros(0, np.int64)] * 4
    _, number = np.unique(np.concatenate(hashes), return_inverse=True)
    return len(seen), number[np.concatenate(tokens)], np.r_[0, np.cumsum(np.concatenate(counts))], number[np.concatenate(words)], np.concatenate(buckets)


def fit(texts: list[str | None], labels: np.ndarray, prior: float, seed: int = 7) -> ToxicityModel:
    """Train on texts with labels 0/1; ``prior`` is the share of ones to which scores refer.

    With one label only, or no words at all, every text gets the prior.
    """
    labels = np.asarray(labels)
    flat = ToxicityModel(np.zeros(1 << BITS), 0.0, (0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), 0.0), prior)
    if len(set(labels.tolist())) < 2:
        return flat
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(labels), bool)
    for v in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == v))
        aside[own[: len(own) // 4]] = True
    train = np.flatnonzero(~aside)
    y_doc = labels[train].astype(np.float32)
    n_words, index, offs, word, bucket = _vocabulary([texts[i] for i in train])
    if not n_words:
        return flat
    # words of one or two documents keep their n-grams only
    doc = np.repeat(np.arange(len(train)), np.diff(offs))
    pair = np.unique(index * len(train) + doc)
    rare = np.bincount(pair // len(train), minlength=n_words) < 3
    n_sub = np.bincount(word, minlength=n_words).astype(np.float32)
    keep = ~((bucket < 1 << (BITS - 1)) & (rare & (n_sub > 1))[word])
    word, bucket = word[keep], bucket[keep]
    used, local = np.unique(bucket, return_inverse=True)
    del doc, pair, bucket
    seg, seg_doc, size = _segments(offs)
    seg, index = _distinct(seg, index, n_words)
    y_seg = y_doc[seg_doc]
    emb = np.zeros((len(used), DIM), np.float32)
    soft = rng.choice([-1.0, 1.0], (DIM, 2)).astype(np.float32)
    soft[:, 1] = -soft[:, 0]
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, bias)]
    share = np.ones(len(seg_doc), np.float32)
    step = 0

    def forward():
        vec = np.stack([np.bincount(word, emb[local, d], n_words) for d in range(DIM)], 1) / n_sub[:, None]
        h = np.stack([np.bincount(seg, vec[index, d], len(seg_doc)) for d in range(DIM)], 1) / size[:, None]
        z = h @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        return h, z, p / p.sum(1, keepdims=True)

    for r in range(ROUNDS):
        total = [max(1e-6, float(share[y_seg == v].sum())) for v in (0, 1)]
        w = (share / np.where(y_seg > 0, total[1], total[0]) / 2).astype(np.float32)
        for _ in range(EPOCHS):
            h, _, p = forward()
            g = p.copy()
            g[np.arange(len(g)), y_seg.astype(int)] -= 1
            g *= w[:, None]
            dh = (g @ soft.T) / size[:, None]
            dvec = np.stack([np.bincount(index, dh[seg, d], n_words) for d in range(DIM)], 1) / n_sub[:, None]
            demb = np.stack([np.bincount(local, dvec[word, d], len(used)) for d in range(DIM)], 1) + DECAY * emb
            step += 1
            for par, grad, (m, v) in zip((emb, soft, bias), (demb, h.T @ g, g.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                par -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if r + 1 < ROUNDS:  # of a toxic text, only what looks toxic counts as such from now on
            _, z, p = forward()
            best = np.full(len(train), -np.inf)
            margin = z[:, 1] - z[:, 0]
            np.maximum.at(best, seg_doc, margin)
            share = np.where((y_seg == 0) | (p[:, 1] > 0.5) | (margin == best[seg_doc]), 1, 0).astype(np.float32)
    scores = np.zeros(1 << BITS)
    scores[used] = emb @ (soft[:, 1] - soft[:, 0])
    model = ToxicityModel(scores, float(bias[1] - bias[0]), (1.0, 0.0, 0.0), prior)
    held = np.flatnonzero(aside)
    top, n = model.worst([texts[i] for i in held])
    ok = ~np.isnan(top)
    y = labels[held][ok].astype(float)
    if len(set(y.tolist())) == 2:
        x = np.column_stack([top[ok], np.ones(ok.sum()), np.log(n[ok])])
        weight = np.where(y > 0, prior / max(y.mean(), 1e-6), (1 - prior) / max(1 - y.mean(), 1e-6))
        model.curve = tuple(_logistic(x, y, weight))
    return model


def fit_from_tables(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Fit on at most ``sample[v]`` documents of each label v, of ``sample_chars`` characters at most, chosen by hash of the id.

    Labels other than 0 and 1 and null ids teach nothing; repeated rows count once; rows
    of one id with other texts, or with both labels, count each.  Without labelled
    documents every text gets a score of 0.1.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    text = text.where(F.length(F.coalesce("text", F.lit(""))) <= sample_chars)
    eligible = text.select("id", "th").distinct().join(known, "id")
    picked = None
    for v, n in sample.items():
        part = eligible.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id", "th").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    rows = text.join(F.broadcast(picked), ["id", "th"]).dropDuplicates(["id", "th", "y"]).toArrow()  # bounded by the parameters
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("id", "y", "th", "text")), strict=True), key=lambda r: r[:3])
    total = sum(counts.values())
    return fit([r[3] for r in got], np.array([r[1] for r in got], int), counts.get(1, 0) / total if total else 0.1)


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` from 0 to 1; the whole text counts.

    Null and blank texts get the prior share (below the threshold).  Only the text is
    read by the model; every other column passes through, repeated rows included, but a
    column of that name is replaced.  An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, fields, place = with_text(docs, text_col, [name])
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = held.value.score(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array(s, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
