"""Exact order statistics without gathering the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a step counts, and values that are fetched once a range holds no more of them.
BUCKETS, FETCH = 1024, 10_000


def values_at(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values that stand at ``ranks`` (from 0) when the non-null numbers of ``value`` are sorted.

    A step counts the values of ``BUCKETS`` equal ranges between the least and the
    greatest that are left for a rank, with partial aggregates, and goes on inside the
    range that holds it; the ends of a range are values, so a value of any frequency
    ends the search.  What reaches the driver is bounded by the number of ranks.  Two
    scans are usual, more where most values lie in a tiny part of their span.
    """
    clean = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n, lo, hi = clean.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if any(not 0 <= r < n for r in ranks):
        raise IndexError(f"ranks {ranks} of {n} values")
    found: dict[int, float] = {}
    open_ = {r: (lo, hi, 0, n) for r in ranks}  # least, greatest, values below, values inside
    while open_:
        for r, (a, b, _, _) in list(open_.items()):
            if a == b:
                found[r] = a
                del open_[r]
        spans = sorted({(a, b, below, size) for a, b, below, size in open_.values()})
        parts = []
        for k, (a, b, _, size) in enumerate(spans):
            at = F.least(F.floor((F.col("v") - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1))
            # few values are told apart by themselves
            key = F.col("v") if size <= FETCH else at.cast("double")
            parts.append(clean.where(F.col("v").between(a, b)).select(F.lit(k).alias("k"), key.alias("key"), "v"))
        if not parts:
            break
        each = parts[0]
        for p in parts[1:]:
            each = each.unionByName(p)
        rows = each.groupBy("k", "key").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for k, (_, _, below, _) in enumerate(spans):
            mine = sorted((row for row in rows if row["k"] == k), key=lambda row: row["a"])
            for r in [r for r, s in open_.items() if s == spans[k]]:
                at = below
                for row in mine:
                    if r < at + row["n"]:
                        # a span that ranges cannot part (infinite ends) is told apart by its values
                        stuck = (row["a"], row["b"], at, row["n"]) == open_[r]
                        open_[r] = (row["a"], row["b"], at, 0 if stuck else row["n"])
                        break
                    at += row["n"]
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, value: str, at: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; nulls do not count, of no values they are null."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    ranks = sorted({r for x in places for r in (int(x), min(int(x) + 1, n - 1))})
    got = dict(zip(ranks, values_at(df, value, ranks), strict=True))
    return [got[int(x)] + (got[min(int(x) + 1, n - 1)] - got[int(x)]) * (x - int(x)) for x in places]
