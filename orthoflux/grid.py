"""Grid metadata: the affine of a north-up raster and its pixel conventions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridMeta:
    """``x = c + col * a``, ``y = f + row * e`` at pixel corners (e < 0)."""

    a: float
    c: float
    e: float
    f: float
    width: int
    height: int
    nodata: float | None = None
    epsg: int = 31982

    def pixel_to_world(self, row: Column, col: Column) -> tuple[Column, Column]:
        """Pixel centre in world units."""
        return F.lit(self.c) + (col + 0.5) * self.a, F.lit(self.f) + (row + 0.5) * self.e

    def world_to_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of the pixel that holds a point."""
        return F.floor((F.lit(self.f) - y) / F.lit(-self.e)).cast("long"), F.floor((x - self.c) / self.a).cast("long")

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)

    def buffer_px(self, metres: float) -> int:
        """A buffer in whole pixels, one at least."""
        return max(1, math.ceil(metres / abs(self.a)))

    @staticmethod
    def over(left: float, bottom: float, right: float, top: float, res: float, epsg: int = 4326) -> GridMeta:
        """The output grid that covers bounds."""
        return GridMeta(res, left, -res, top, math.ceil((right - left) / res), math.ceil((top - bottom) / res), None, epsg)

    def cells(self, spark: SparkSession) -> DataFrame:
        """``(prow, pcol, x, y)`` of every cell, generated on the executors from one range."""
        ids = spark.range(self.width * self.height)
        row, col = F.floor(F.col("id") / self.width).cast("long"), (F.col("id") % self.width).cast("long")
        x, y = self.pixel_to_world(F.col("prow"), F.col("pcol"))
        return ids.select(row.alias("prow"), col.alias("pcol")).select("prow", "pcol", x.alias("x"), y.alias("y"))
