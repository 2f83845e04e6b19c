"""Neighbourhood operators on dense pixel tables.

Separable stencils are two window passes: along rows (partitioned by row) and along
columns (partitioned by column).  A partition is one line of the raster, so tasks stay
small whatever the raster's size; passes along one direction share one shuffle.
Missing pixels must have rows (``densify``).  The border of the raster is where a line
has no further row; a null inside the raster is a gap, and whatever the kernel mixes
with a gap is null, as NaN would be in an array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..grid import GridMeta

#: Half-widths of the rows -2..2 of the 5 x 5 ellipse.
ELLIPSE5 = {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
BOX3 = {-1: 1, 0: 1, 1: 1}


def _lines(parts: tuple[str, ...] = ()):
    return W.partitionBy(*parts, "prow").orderBy("pcol"), W.partitionBy(*parts, "pcol").orderBy("prow")


def densify(df: DataFrame, grid: GridMeta) -> DataFrame:
    """A row for every pixel of the grid; added ones are null."""
    return grid.cells(df.sparkSession).select("prow", "pcol").join(df, ["prow", "pcol"], "left")


def _outside(w, i: int) -> Column:
    """Whether the row ``i`` places on (back, if negative) lies beyond the line's end."""
    return F.lead(F.lit(True), i).over(w).isNull() if i > 0 else F.lag(F.lit(True), -i).over(w).isNull()


def _sum3(v: str, w) -> Column:
    """v and its two neighbours, edge repeated."""
    before = F.when(_outside(w, -1), F.col(v)).otherwise(F.lag(v).over(w))
    after = F.when(_outside(w, 1), F.col(v)).otherwise(F.lead(v).over(w))
    return before + F.col(v) + after


def mean3(df: DataFrame, value: str, out: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """3 x 3 mean, edge repeated; ``parts`` (tile columns) confine it to tiles."""
    h, v = _lines(parts)
    one = df.withColumn("__h", _sum3(value, h))
    return one.withColumn(out, _sum3("__h", v) / 9.0).drop("__h")


def variance3(df: DataFrame, value: str, out: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """E[g^2] - E[g]^2 over 3 x 3, not below 0: both means in the same two passes."""
    h, v = _lines(parts)
    one = df.withColumn("__q", F.col(value) * F.col(value)).select("*", _sum3(value, h).alias("__s1"), _sum3("__q", h).alias("__s2"))
    two = one.select("*", (_sum3("__s1", v) / 9.0).alias("__m1"), (_sum3("__s2", v) / 9.0).alias("__m2"))
    return two.withColumn(out, F.greatest(F.lit(0.0), F.col("__m2") - F.col("__m1") * F.col("__m1"))).drop("__q", "__s1", "__s2", "__m1", "__m2")


def _sides(v: str, w) -> tuple[Column, Column]:
    """Neighbours before and after, mirrored without repeating the edge."""
    a, b = F.lag(v).over(w), F.lead(v).over(w)
    first, last = _outside(w, -1), _outside(w, 1)
    single = F.when(first & last, F.col(v))
    return single.when(first, b).otherwise(a), single.when(last, a).otherwise(b)


def sobel(df: DataFrame, value: str) -> DataFrame:
    """Adds ``gx``, ``gy`` and ``sobel`` (their magnitude)."""
    h, v = _lines()
    a, b = _sides(value, h)
    one = df.select("*", (b - a).alias("__d"), (a + F.col(value) * 2.0 + b).alias("__s"))
    (da, db), (sa, sb) = _sides("__d", v), _sides("__s", v)
    two = one.select("*", (da + F.col("__d") * 2.0 + db).alias("gx"), (sb - sa).alias("gy")).drop("__d", "__s")
    return two.withColumn("sobel", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def _difference(v: str, w, step: float) -> Column:
    a, b, x = F.lag(v).over(w), F.lead(v).over(w), F.col(v)
    first, last = _outside(w, -1), _outside(w, 1)
    inner = (b - a) / (2.0 * step)
    return F.when(first & last, F.lit(0.0)).when(first, (b - x) / step).when(last, (x - a) / step).otherwise(inner)


def gradient(df: DataFrame, value: str, step: float) -> DataFrame:
    """Adds ``d_row`` and ``d_col``: central inside, one-sided at edges."""
    h, v = _lines()
    return df.withColumn("d_row", _difference(value, v, step)).withColumn("d_col", _difference(value, h, step))


def _extreme(df: DataFrame, value: str, out: str, kernel: dict[int, int], f) -> DataFrame:
    """Minimum or maximum over a kernel of row half-widths; what lies outside is ignored."""
    h, v = _lines()
    widths = sorted(set(kernel.values()))
    one = df.select("*", *[f(value).over(h.rowsBetween(-k, k)).alias(f"__k{k}") for k in widths])
    if len(widths) == 1:
        r = max(kernel)
        col = f(f"__k{widths[0]}").over(v.rowsBetween(-r, r))
    else:
        take = F.least if f is F.min else F.greatest
        shifted = [F.lag(f"__k{k}", -dy).over(v) if dy < 0 else F.lead(f"__k{k}", dy).over(v) if dy > 0 else F.col(f"__k{k}") for dy, k in kernel.items()]
        col = take(*shifted)  # least and greatest skip the nulls outside
    return one.withColumn(out, col).drop(*[f"__k{k}" for k in widths])


def erode(df: DataFrame, value: str, out: str, kernel: dict[int, int] = BOX3) -> DataFrame:
    return _extreme(df, value, out, kernel, F.min)


def dilate(df: DataFrame, value: str, out: str, kernel: dict[int, int] = BOX3) -> DataFrame:
    """Greatest value under the kernel; on labels, the greatest id."""
    return _extreme(df, value, out, kernel, F.max)


def opened(df: DataFrame, value: str, out: str, kernel: dict[int, int] = BOX3) -> DataFrame:
    """Erosion, then dilation."""
    return dilate(erode(df, value, "__e", kernel), "__e", out, kernel).drop("__e")


def closed(df: DataFrame, value: str, out: str, kernel: dict[int, int] = BOX3) -> DataFrame:
    """Dilation, then erosion."""
    return erode(dilate(df, value, "__e", kernel), "__e", out, kernel).drop("__e")


def gaussian_taps(sigma: float = 1.5, truncate: float = 4.0) -> list[float]:
    """Normalised taps -radius..radius."""
    r = int(truncate * sigma + 0.5)
    t = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(t) for x in t]


def _smooth(v: str, w, taps: list[float]) -> Column:
    r = len(taps) // 2
    ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(v).over(ends), F.last(v).over(ends)
    out = F.col(v) * taps[r]
    for i in range(1, r + 1):
        before = F.when(_outside(w, -i), first).otherwise(F.lag(v, i).over(w))
        after = F.when(_outside(w, i), last).otherwise(F.lead(v, i).over(w))
        out = out + before * taps[r - i] + after * taps[r + i]
    return out


def gaussian(df: DataFrame, value: str, out: str, sigma: float = 1.5) -> DataFrame:
    """Separable Gaussian, edge clamped; rows first, then columns."""
    taps, (h, v) = gaussian_taps(sigma), _lines()
    one = df.withColumn("__g", _smooth(value, h, taps))
    return one.withColumn(out, _smooth("__g", v, taps)).drop("__g")


def gaussian_with_gaps(df: DataFrame, value: str, out: str, sigma: float = 1.5, compat: bool = False) -> DataFrame:
    """Gaussian over the valid cells: smoothed values over smoothed mask, null where the mask is 0.01 or less.

    Gaps count as 0 before normalising; ``compat`` fills them with the mean instead,
    which pulls cells beside gaps towards it.
    """
    mask = F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)
    if compat:
        mean = df.agg(F.avg(value).alias("__m"))
        full = df.crossJoin(F.broadcast(mean)).withColumn("__f", F.coalesce(value, "__m")).drop("__m")
    else:
        full = df.withColumn("__f", F.coalesce(value, F.lit(0.0)))
    both = gaussian(gaussian(full.withColumn("__w", mask), "__f", "__fs", sigma), "__w", "__ws", sigma)
    return both.withColumn(out, F.when(F.col("__ws") > 0.01, F.col("__fs") / F.col("__ws"))).drop("__f", "__w", "__fs", "__ws")


def bilateral(df: DataFrame, bands: tuple[str, str, str] = ("r", "g", "b"), d: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0, tile: int = 256) -> DataFrame:
    """Edge-preserving smoothing: ``(prow, pcol, r, g, b)`` doubles.

    Weights fall with distance and with the summed channel difference, over a disc.
    Not separable, so tiles with a halo of d // 2 go to numpy, one bounded tile a
    group; borders mirror without repeating the edge.
    """
    r = d // 2
    size = df.agg(F.max("prow").alias("h"), F.max("pcol").alias("w")).first()
    height, width = (size["h"] or 0) + 1, (size["w"] or 0) + 1
    tr, tc = F.col("__o")[0], F.col("__o")[1]
    offs = F.array_distinct(F.array(F.lit(-r), F.lit(0), F.lit(r)))
    spread = (
        df.select("prow", "pcol", *bands)
        .withColumn("__dr", F.explode(offs))
        .withColumn("__dc", F.explode(offs))
        .withColumn("__o", F.array(F.floor((F.col("prow") + F.col("__dr")) / tile), F.floor((F.col("pcol") + F.col("__dc")) / tile)))
        .select("prow", "pcol", *bands, tr.alias("tr"), tc.alias("tc"))
        .distinct()
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.tr.iloc[0]) * tile, int(pdf.tc.iloc[0]) * tile
        if r0 < 0 or c0 < 0 or r0 >= height or c0 >= width:
            return pd.DataFrame(columns=["prow", "pcol", *bands])
        h, w = min(tile, height - r0), min(tile, width - c0)
        top, left = max(0, r0 - r), max(0, c0 - r)
        block = np.zeros((min(height, r0 + h + r) - top, min(width, c0 + w + r) - left, 3))
        for i, b in enumerate(bands):
            block[pdf.prow.to_numpy() - top, pdf.pcol.to_numpy() - left, i] = pdf[b].to_numpy()
        mirror = lambda n, a, b: np.abs((np.arange(a, b) + (n - 1)) % max(1, 2 * (n - 1)) - (n - 1)) if n > 1 else np.zeros(b - a, int)
        rows, cols = mirror(height, r0 - r, r0 + h + r) - top, mirror(width, c0 - r, c0 + w + r) - left
        pad = block[np.clip(rows, 0, block.shape[0] - 1)][:, np.clip(cols, 0, block.shape[1] - 1)]
        centre = pad[r : r + h, r : r + w]
        num, den = np.zeros_like(centre), np.zeros((h, w))
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dy * dy + dx * dx <= r * r:
                    near = pad[r + dy : r + dy + h, r + dx : r + dx + w]
                    diff = np.abs(near - centre).sum(2)
                    weight = np.exp(-(diff**2) / (2 * sigma_color**2) - (dy * dy + dx * dx) / (2 * sigma_space**2))
                    num += near * weight[..., None]
                    den += weight
        out = num / den[..., None]
        yy, xx = np.mgrid[r0 : r0 + h, c0 : c0 + w]
        return pd.DataFrame({"prow": yy.ravel(), "pcol": xx.ravel(), **{b: out[..., i].ravel() for i, b in enumerate(bands)}})

    return spread.groupBy("tr", "tc").applyInPandas(run, "prow long, pcol long, " + ", ".join(f"{b} double" for b in bands))
