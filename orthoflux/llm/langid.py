"""Language identification: words first, then shorter and shorter character n-grams.

A word seen in training adds its log frequency in every language.  An unseen word
adds the mean log frequency of its longest n-grams of which any was seen, from five
characters down to one.  All counts come from a bounded sample of labelled rows; the
model is a few sorted hash tables of at most ``TABLE`` rows each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import with_text
from .subwords import Tokens, token_chunks

LENGTHS = (5, 4, 3, 2, 1)
#: Labelled rows used for fitting, at most (by hash order of the id).
SAMPLE = 1_200
#: Rows of one table, the most frequent ones.
TABLE = 200_000
SMOOTH = 0.1
#: How often the n-grams of one word count in a language, at most: what words share matters more than the commonest of them.
GRAM_TIMES = 8
#: Labelled texts of more characters are not fitted on, so the sample is bounded in bytes too.
SAMPLE_CHARS = 100_000
#: Words whose joint evidence makes the score; more words are averaged down to so many.
EVIDENCE = 10
UNKNOWN = "und"


class _Table:
    """Log frequency of hashed keys by language."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, n_langs: int):
        uniq, inv = np.unique(keys, return_inverse=True)
        counts = np.bincount(inv * n_langs + langs, minlength=len(uniq) * n_langs).reshape(len(uniq), n_langs)
        if len(uniq) > TABLE:
            top = np.sort(np.argsort(-counts.sum(1), kind="stable")[:TABLE])
            uniq, counts = uniq[top], counts[top]
        self.keys = uniq
        self.logs = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * max(1, len(uniq)))).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where unseen."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class LanguageModel:
    def __init__(self, langs: list[str], words: _Table, grams: dict[int, _Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def _of_words(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.hashes), len(self.langs)))
        row = self.words.find(t.hashes)
        out[row >= 0] = self.words.logs[row[row >= 0]]
        open_ = row < 0
        for n in LENGTHS:
            if not open_.any():
                break
            word, h = t.grams(n)
            mine = open_[word]
            word, h = word[mine], h[mine]
            row = self.grams[n].find(h)
            word, row = word[row >= 0], row[row >= 0]
            k = np.bincount(word, minlength=len(open_))
            hit = k > 0
            for i in range(len(self.langs)):
                s = np.bincount(word, self.grams[n].logs[row, i], len(open_))
                out[hit, i] = s[hit] / k[hit]
            open_ &= ~hit
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text; ``und`` and 0 without letters."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, score
        for first, last, t in token_chunks(texts, letters_only=True):
            n = np.diff(t.offs)
            if not n.sum():
                continue
            of_word = self._of_words(t)
            doc = np.repeat(np.arange(last - first), n)
            total = np.stack([np.bincount(doc, of_word[t.index, i], last - first) for i in range(len(self.langs))], 1)
            z = total / np.maximum(1, n)[:, None] * np.minimum(n, EVIDENCE)[:, None]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for d in np.flatnonzero(n):
                names[first + d], score[first + d] = self.langs[best[d]], p[d, best[d]]
        return names, score


def fit(texts: list[str | None], langs: list[str]) -> LanguageModel:
    """Count words and n-grams by language (every document weighs by its words)."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    at = np.array([number[x] for x in langs], np.int64)
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in (0, *LENGTHS)}
    for i in range(len(names)):
        mine = [texts[d] for d in np.flatnonzero(at == i)]
        for _, _, t in token_chunks(mine, letters_only=True):
            parts[0].append((t.hashes[t.index], np.full(len(t.index), i)))
        seen, total = np.unique(np.concatenate([k for k, v in parts[0] if len(v) and v[0] == i] or [np.zeros(0, np.uint64)]), return_counts=True)
        open_ = np.ones(len(seen), bool)
        for _, _, t in token_chunks(mine, letters_only=True):
            # the n-grams of a word count as often as the word is found in the language, GRAM_TIMES times at most
            place = np.searchsorted(seen, t.hashes)
            times_of = np.where(open_[place], np.minimum(total[place], GRAM_TIMES), 0)
            open_[place] = False
            for n in LENGTHS:
                word, h = t.grams(n)
                times = times_of[word]
                parts[n].append((np.repeat(h, times), np.full(int(times.sum()), i)))

    def table(n):
        keys = np.concatenate([k for k, _ in parts[n]] or [np.zeros(0, np.uint64)])
        own = np.concatenate([v for _, v in parts[n]] or [np.zeros(0, np.int64)]).astype(np.int64)
        parts[n] = []
        return _Table(keys, own, max(1, len(names)))

    return LanguageModel(names, table(0), {n: table(n) for n in LENGTHS})


def fit_from_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fit on at most ``sample`` rows with id and language and texts of ``sample_chars`` characters at most, chosen by hash of the id.

    Repeated rows count once; rows of one id with other texts or languages count each,
    in order of a hash of the text.  Null texts teach nothing.  Without such rows the
    model knows no language and calls every text ``und``.
    """
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = named.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.length("text") <= sample_chars))
    # a sorted prefix by a total order: bounded by its parameter, and the same in every run
    picked = known.select("id", "th", "lang").distinct().orderBy(F.xxhash64("id"), "id", "th", "lang").limit(sample)
    rows = known.join(F.broadcast(picked), ["id", "th", "lang"]).dropDuplicates(["id", "th", "lang"]).toArrow()
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("id", "th", "lang", "text")), strict=True))
    return fit([r[3] for r in got], [r[2] for r in got])


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with a string and a double column added; null texts and texts without letters are ``und``, score 0.

    Only the text is read by the model, all of it; other columns pass through, repeated
    rows included, but columns of the two names are replaced.  An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, fields, place = with_text(docs, text_col, [lang_name, score_name])
    schema = T.StructType([*fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lang, score = held.value.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
