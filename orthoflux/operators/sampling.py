"""Deterministic samples, caps and splits by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import values_at


def hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: a top-n per partition, then one merge of n rows."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def cap_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group; Spark cuts each group before the shuffle (window group limit)."""
    w = W.partitionBy(group).orderBy(hash_order(seed, key), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ceil(test * n) keys in hash order are the test rows; rows with a null key train.

    The cut is found by counting ranges of the hash's first 52 bits (``ranks``); only
    keys that agree in all of these are sorted.  Rows are then compared with one
    constant, so nothing is ranked, joined or shuffled.
    """
    h = hash_order(seed, key)
    spot = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
    hashed = df.select(h.alias("h"), spot.alias("v")).where("h IS NOT NULL")
    k = min(-int(-(df.count() * test) // 1), hashed.count())
    if k < 1:
        return df.withColumn("split", F.lit("train"))
    top = values_at(hashed, "v", [k - 1])[0]
    left = k - hashed.where(F.col("v") < top).count()
    cut = hashed.where(F.col("v") == top).select("h").orderBy("h").limit(left).agg(F.max("h")).first()[0]
    return df.withColumn("split", F.when(h <= cut, "test").otherwise("train"))
