"""Queries of the ten training-data operators over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import find_overlaps
from .pii import pseudonymize
from .mixing import mix_sources
from .neardup import near_duplicates
from .substring_dedup import remove_repeated
from . import langid, toxicity
from .audio import align_recordings, fingerprint_media, render_melodies
from .token_files import read_token_files, write_token_files
from .warc import normalize_archives, read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk
  FROM sized GROUP BY source),
w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, source_size * 2e0 AS cap FROM src),
lv AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0
             - (sum(cap) OVER (ORDER BY cap / weight, rk ROWS UNBOUNDED PRECEDING) - cap))
            / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, rk ROWS UNBOUNDED PRECEDING) + weight) AS level
  FROM w),
pick AS (SELECT level FROM lv WHERE cap >= level * weight ORDER BY cap / weight, rk LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN (SELECT count(*) FROM pick) = 0 THEN cap ELSE least(cap, (SELECT level FROM pick) * weight) END AS target
  FROM lv),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes,
         CAST(floor(b.target) AS BIGINT) - b.passes * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM run
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(normalize_archives(write_archives(_table(spark, sf_dir, "pages")), keep_source=False))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; a fixed one here, so reruns agree."""
    out = pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"test tables only")
    return out.select("doc_id", F.size("pii").cast("long").alias("n_found"), "clean_text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``longest`` follows the digests: the length of the last level that a document reached."""
    out = remove_repeated(_table(spark, sf_dir, "documents"), window=50)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), "longest")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without id teach nothing and count as not held out."""
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit_from_table(docs.where(fold != 1))
    return langid.predict_languages(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_chroma_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: every embedding is rendered as a melody, stored as WAV bytes and read from those."""
    media = render_melodies(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return align_recordings(fingerprint_media(media, "id", "media"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without id teach nothing and count as not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = toxicity.fit_from_tables(docs, labels.where(fold != 2))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc_members": op6_warc_members,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_language_id": op8_language_id,
    "op9_chroma_align": op9_chroma_align,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": MIX_SQL,
}
