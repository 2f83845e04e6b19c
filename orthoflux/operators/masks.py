"""Filters and masks over pixel, point and polygon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import GridMeta
from .ranks import quantiles

ALPHA_VALID = 250


def valid_alpha(a: str = "a") -> Column:
    """Opaque pixels."""
    return F.col(a) >= ALPHA_VALID


def valid_mask(bands: list[str], alpha: str | None = None, nodata: float | None = None) -> Column:
    """By alpha where there is one, else no band may hold nodata, else everything."""
    if alpha:
        return valid_alpha(alpha)
    if nodata is None:
        return F.lit(True)
    out = F.lit(True)
    for b in bands:
        out = out & (F.col(b) != nodata)
    return out


def by_confidence(df: DataFrame, classes: DataFrame, probs: dict[str, str], mask: Column, direction: str = "below", need_suffix: bool = False) -> DataFrame:
    """Pixels of each class whose probability lies below (or at or above) the class's confidence.

    Classes without confidence are skipped; ``probs`` maps class to probability
    column.  Of the class table only the classes of ``probs`` take part, so what is
    broadcast is a row for each of these where it names each class once.
    """
    long = df.where(mask).select("*", F.explode(F.create_map(*[x for k, c in probs.items() for x in (F.lit(k), F.col(c))])).alias("class", "p"))
    dim = classes.where(F.col("confidence").isNotNull() & F.col("class").isin(list(probs)))
    if need_suffix:
        dim = dim.where("las_suffix IS NOT NULL")
    keep = F.col("p") < F.col("confidence") if direction == "below" else F.col("p") >= F.col("confidence")
    return long.join(F.broadcast(dim), "class").where(keep)


def in_range(ranges: dict[str, tuple[int, int]]) -> Column:
    """Every named column between its limits, both included."""
    out = F.lit(True)
    for c, (lo, hi) in ranges.items():
        out = out & F.col(c).between(lo, hi)
    return out


def usable(c: str) -> Column:
    """Neither null nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(c)


def nodata_to_null(c: str, nodata: float | None) -> Column:
    v = F.col(c)
    return F.when(~F.isnan(v) & (v != nodata if nodata is not None else F.lit(True)), v)


def drop_zscore_outliers(df: DataFrame, value: str, limit: float = 3.5, strict: bool = False) -> DataFrame:
    """Rows within ``limit`` population deviations of the mean; one row of statistics is broadcast."""
    clean = df.where(usable(value))
    stats = clean.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.abs(F.col(value) - F.col("__m")) / F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(F.col("__s"))
    return clean.crossJoin(F.broadcast(stats)).where(z < limit if strict else z <= limit).drop("__m", "__s")


def drop_iqr_outliers(df: DataFrame, value: str, k: float = 2.5) -> DataFrame:
    """Rows between q1 - k iqr and q3 + k iqr, exact linear quantiles; the limits are plain numbers that reach the scan."""
    clean = df.where(usable(value))
    q1, q3 = quantiles(clean, value, (0.25, 0.75))
    if q1 is None:
        return clean
    return clean.where((F.col(value) >= q1 - (q3 - q1) * k) & (F.col(value) <= q3 + (q3 - q1) * k))


def in_grid(df: DataFrame, grid: GridMeta, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside a raster, with their pixel."""
    row, col = grid.world_to_pixel(F.col(x), F.col(y))
    return df.withColumns({"prow": row, "pcol": col}).where(grid.inside(F.col("prow"), F.col("pcol")))
