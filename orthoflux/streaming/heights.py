"""Heights for points that arrive as a stream: the raster look-up is stateless, so it runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..grid import GridMeta
from ..operators.joins import raster_at_points
from ..operators.masks import usable


def stream_heights(points: DataFrame, surface: DataFrame, grid: GridMeta, value: str = "z") -> DataFrame:
    """Streaming ``points(pid, x, y)`` joined with a static surface; points outside or without height drop out."""
    return raster_at_points(points, surface.select("prow", "pcol", value), grid).where(usable(value))


def start(points: DataFrame, surface: DataFrame, grid: GridMeta, path: str, checkpoint: str, value: str = "z"):
    """Append heights to Parquet, exactly once, with the offsets in ``checkpoint``."""
    return stream_heights(points, surface, grid, value).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
