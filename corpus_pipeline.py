"""From raw documents to token files: the training-data operators in a row.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflux.llm import storage, toxicity
from orthoflux.llm.decontam import find_overlaps
from orthoflux.llm.mixing import WORD, mix_rules, order_key
from orthoflux.llm.neardup import near_duplicates
from orthoflux.llm.queries import tokenizer_path
from orthoflux.llm.token_files import read_token_files, write_token_files


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``ids(doc_id)``; rows without id are not dealt to one task for the look-up, they pass by."""
    known = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti")
    return known.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; labels are learned from the training fold only.

    Null and blank texts score the prior, below the threshold, and stay; rows without id
    teach nothing and are scored like all others; repeated rows share their fate.  An
    empty table stays empty; without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_from_tables(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    scored = toxicity.score_documents(docs, model, name="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays.

    Of rows with one id and one text (whatever else they hold) one stays; rows of one id
    with different texts are one document and stay or go together.  Rows without id,
    null and blank texts are like nothing else and all stay.
    """
    with storage.scope(spark) as own:
        found = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id")
        ids = found.agg(F.max(~F.col("kept")).alias("__gone"), (F.count(F.lit(1)) > 1).alias("__again"))
        marked = storage.keep(ids.where("__gone OR __again"), "marked", own)
    once = _without(docs, marked)
    again = marked.where("NOT __gone").select("doc_id")
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, "doc_id").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Rows without id, null and blank texts overlap nothing and stay; of rows with one id
    all go where one overlaps.
    """
    with storage.scope(spark) as own:
        found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        gone = storage.keep(found.select("doc_id").distinct(), "contaminated", own)
    return _without(docs, gone)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document; the last row at a source's cut holds the words before it.

    Nothing is taken of null and blank texts.  Rows that share an id (or have none)
    share the greatest number of words taken of one of them.  ``n_chars``, where there
    is such a column, is counted anew for a document that was cut.
    """
    with storage.scope(spark) as own:
        cuts, shared = mix_rules(docs)
        cuts, shared = storage.keep(cuts, "cuts", own), storage.keep(shared, "shared", own)
    # a document is judged by its own key and its source's cut: what meets the texts is small and broadcast, texts stay where they are
    met = docs.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left").join(shared, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    several, key = F.col("__taken").isNotNull(), order_key()
    more = F.when(key < F.col("__at"), 1).when((key == F.col("__at")) & (F.col("__part") > 0), 1).otherwise(0)
    single = F.when(F.col("text").rlike(WORD), F.col("__passes") + more)
    copies = F.when(several, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(single).cast("int")
    each = met.withColumn("__copies", copies).where("__copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    words = F.when(several, F.col("__taken") - (F.col("__k") - 1) * F.col("__size")).otherwise(F.col("__part")).cast("int")
    whole = F.when(several, words >= F.col("__size")).otherwise((F.col("__k") <= F.col("__passes")) | (key < F.col("__at")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    cut = each.withColumn("__whole", whole).withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("__whole"), F.col("n_chars")).otherwise(counted))
    return cut.select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back; they stay in the shared folder until the process ends.

    Null texts hold the end id only; rows of one id, and rows without, come in order of their texts' hashes.
    """
    return read_token_files(write_token_files(docs, tokenizer_path(), end_id=1))


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("mixing", source_mix),
    ("token_files", token_output),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = storage.scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
