"""Statistics of rasters, samples and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def raster_stats(df: DataFrame, value: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation of the valid cells."""
    return df.agg(F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.avg(value).alias("mean_v"), F.stddev_pop(value).alias("std_v"))


def coverage(df: DataFrame, value: str) -> DataFrame:
    """Cells, valid cells and their percentage."""
    return df.agg(F.count(F.lit(1)).alias("n_cells"), F.count(value).alias("n_valid"), (F.count(value) * 100.0 / F.count(F.lit(1))).alias("pct"))


def share(df: DataFrame, condition: Column) -> DataFrame:
    """Share of rows that meet a condition."""
    return df.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("share"))


def median_of_groups(df: DataFrame, group: str, value: str, quantile: float) -> DataFrame:
    """Median over groups of a quantile within each."""
    per = df.groupBy(group).agg(F.percentile(value, F.lit(quantile)).alias("q"))
    return per.agg(F.median("q").alias("median_q"))


def percentiles(df: DataFrame, value: str, at: tuple[float, ...]) -> DataFrame:
    """One row of exact quantiles ``p5``, ``p95`` and so on, found by range counts (``ranks``), not in one task."""
    found = quantiles(df, value, at)
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(f"p{round(p * 100)}") for p, v in zip(at, found, strict=True)])


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("left"), F.min(y).alias("bottom"), F.max(x).alias("right"), F.max(y).alias("top"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then macro and weighted means.

    One aggregation of the rows to a confusion table; the rest runs on its few rows.
    """
    m = confusion(df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()), label, prediction)
    sides = m.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")), F.struct(F.col(prediction).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    per = per.select(F.col("c").cast("string").alias("class"), p.alias("precision"), r.alias("recall"), ratio(2.0 * p * r, p + r).alias("f1"), "support")
    macro = per.agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"))


def fill_mean(df: DataFrame, value: str) -> DataFrame:
    """Null cells get the mean of the valid ones (one broadcast row, no global window)."""
    mean = df.agg(F.avg(value).alias("__m"))
    return df.crossJoin(F.broadcast(mean)).withColumn(value, F.coalesce(value, "__m")).drop("__m")
