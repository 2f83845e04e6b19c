"""Rasters to polygons: regions, their rings and their outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import circularity
from ..grid import GridMeta
from .components import label_components


def trace_rings(rows: np.ndarray, cols: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings of pixel edges around a 4-connected region, as (x, y) corners: the exterior first, then holes.

    Every pixel side without a neighbour is a directed edge with the region on its
    right; edges are chained, turning right where two regions touch at a corner.
    """
    have = set(zip(rows.tolist(), cols.tolist(), strict=True))
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in have:
        for dr, dc, a, b in ((-1, 0, (c, r), (c + 1, r)), (0, 1, (c + 1, r), (c + 1, r + 1)), (1, 0, (c + 1, r + 1), (c, r + 1)), (0, -1, (c, r + 1), (c, r))):
            if (r + dr, c + dc) not in have:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges)
        ring, at, came = [start], start, None
        while True:
            outs = edges[at]
            if len(outs) > 1 and came is not None:
                right = (-came[1], came[0])
                pick = next((o for o in outs if (o[0] - at[0], o[1] - at[1]) == right), outs[0])
            else:
                pick = outs[0]
            outs.remove(pick)
            if not outs:
                del edges[at]
            before, came = came, (pick[0] - at[0], pick[1] - at[1])
            if before == came:  # straight on
                ring[-1] = pick
            else:
                ring.append(pick)
            at = pick
            if at == start:
                break
        rings.append(ring)
    area = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)))
    rings.sort(key=area, reverse=True)
    return rings


def trace_outline(rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Outer boundary of an 8-connected region through pixel centres (Moore neighbours, clockwise)."""
    have = set(zip(rows.tolist(), cols.tolist(), strict=True))
    start = min(have)
    ways = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    out, at, back = [start], start, 0
    first = None
    while True:
        for k in range(1, 9):
            w = (back + k) % 8
            step = (at[0] + ways[w][0], at[1] + ways[w][1])
            if step in have:
                break
        else:
            return out
        if first is None:
            first = (at, step)
        elif (at, step) == first:
            return out[:-1] if len(out) > 1 and out[-1] == start else out
        at, back = step, (w + 4) % 8
        out.append(at)


def _regions(pixels: DataFrame, id_col: str, eight: bool, tile: int) -> DataFrame:
    return label_components(pixels.select(id_col, "prow", "pcol"), id_col, eight, tile=tile)


def contours(pixels: DataFrame, id_col: str = "id", tile: int = 512) -> DataFrame:
    """``(component, n_pixels, area, perimeter, circ, ring)`` of 8-connected regions; area and perimeter through pixel centres.

    One region is one group, so a region must fit a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = trace_outline(pdf.prow.to_numpy(), pdf.pcol.to_numpy())
        p = np.array([*o, o[0]], float)
        area = abs((p[:-1, 1] * p[1:, 0] - p[1:, 1] * p[:-1, 0]).sum()) / 2
        length = float(np.hypot(*(p[1:] - p[:-1]).T).sum())
        ring = [{"x": float(c), "y": float(r)} for r, c in p]
        return pd.DataFrame({"component": [pdf.component.iloc[0]], "n_pixels": [len(pdf)], "area": [area], "perimeter": [length], "ring": [ring]})

    schema = "component long, n_pixels long, area double, perimeter double, ring array<struct<x:double,y:double>>"
    out = _regions(pixels, id_col, True, tile).select("component", "prow", "pcol").groupBy("component").applyInPandas(run, schema)
    return out.withColumn("circ", F.when(F.col("perimeter") > 0, circularity(F.col("area"), F.col("perimeter"))).otherwise(0.0))


def polygons(pixels: DataFrame, grid: GridMeta, id_col: str = "id", tile: int = 512) -> DataFrame:
    """``(component, n_pixels, area, rings)`` of 4-connected regions, rings along pixel edges in world units."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [[{"x": grid.c + x * grid.a, "y": grid.f + y * grid.e} for x, y in ring] for ring in trace_rings(pdf.prow.to_numpy(), pdf.pcol.to_numpy())]
        return pd.DataFrame({"component": [pdf.component.iloc[0]], "n_pixels": [len(pdf)], "area": [len(pdf) * abs(grid.a * grid.e)], "rings": [rings]})

    schema = "component long, n_pixels long, area double, rings array<array<struct<x:double,y:double>>>"
    return _regions(pixels, id_col, False, tile).select("component", "prow", "pcol").groupBy("component").applyInPandas(run, schema)
