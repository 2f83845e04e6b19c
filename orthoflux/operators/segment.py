"""Segmentation: marker watershed and probability orientation."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import GridMeta
from ..scratch import keep, materialize, scope
from .joins import raster_at_points


def swap_if_inverted(prob: DataFrame, tree_points: DataFrame, grid: GridMeta, p: str = "p_tree", q: str = "p_soil") -> DataFrame:
    """Exchange the two probabilities if their mean at known tree points is below one half."""
    mean = raster_at_points(tree_points.select("x", "y"), prob, grid).agg(F.avg(p).alias("__mean"))
    swap = F.col("__mean") < 0.5
    return prob.crossJoin(F.broadcast(mean)).withColumns({p: F.when(swap, F.col(q)).otherwise(F.col(p)), q: F.when(swap, F.col(p)).otherwise(F.col(q))}).drop("__mean")


def flood(cost: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Priority flood from markers over four neighbours, by (cost, order of arrival)."""
    label = np.where(mask, markers, 0)
    h, w = cost.shape
    heap, age = [], 0
    for r, c in zip(*np.nonzero(label), strict=True):
        heap.append((cost[r, c], age, r, c))
        age += 1
    heapq.heapify(heap)
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for y, x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= y < h and 0 <= x < w and mask[y, x] and not label[y, x]:
                label[y, x] = label[r, c]
                heapq.heappush(heap, (cost[y, x], age, y, x))
                age += 1
    return label


def watershed_image(pixels: DataFrame, image: str = "image") -> DataFrame:
    """``pixels(image, prow, pcol, cost, marker, mask)`` -> ``(image, prow, pcol, label)``.

    The exact flood, one image a group: for images that fit one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf.prow.to_numpy() - pdf.prow.min(), pdf.pcol.to_numpy() - pdf.pcol.min()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        cost, marker, mask = np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, bool)
        cost[r, c], marker[r, c], mask[r, c] = pdf.cost, pdf.marker, pdf["mask"]
        return pd.DataFrame({image: pdf[image], "prow": pdf.prow, "pcol": pdf.pcol, "label": flood(cost, marker, mask)[r, c]})

    return pixels.select(image, "prow", "pcol", F.col("cost").cast("double").alias("cost"), F.col("marker").cast("long").alias("marker"), F.col("mask").cast("boolean").alias("mask")).groupBy(image).applyInPandas(run, f"{image} long, prow long, pcol long, label long")


def _relax(border: bool):
    """Best (level, steps, label) of every inner pixel of a tile ``t``, or of those on its border, given its halo: Dijkstra
    over four neighbours on the tile's padded grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inner = ~pdf["halo"].to_numpy(bool)
        r, c = pdf.prow.to_numpy(), pdf.pcol.to_numpy()
        r0, c0, wide = r.min() - 1, c.min() - 1, int(c.max() - c.min()) + 3
        at = (r - r0) * wide + (c - c0)
        size = (int(r.max() - r0) + 2) * wide
        cost, level, steps, label = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
        cost[at], level[at], steps[at], label[at] = pdf.cost, pdf.level, pdf.steps, pdf.label
        todo = np.zeros(size, np.uint8)
        todo[at[inner]] = 1
        todo, cost, level, steps, label = bytearray(todo.tobytes()), cost.tolist(), level.tolist(), steps.tolist(), label.tolist()
        heap = [(level[k], steps[k], label[k], k) for k in at.tolist() if label[k] > 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            lv, st, lb, p = pop(heap)
            if lv != level[p] or st != steps[p] or lb != label[p]:
                continue
            todo[p] = 0
            for k in (p - wide, p - 1, p + 1, p + wide):
                if todo[k]:
                    new, far = cost[k], 0
                    if new <= lv:
                        new, far = lv, st + 1
                    was = label[k]
                    if not was or new < level[k] or (new == level[k] and (far < steps[k] or (far == steps[k] and lb < was))):
                        level[k], steps[k], label[k] = new, far, lb
                        push(heap, (new, far, lb, k))
        if border:
            rows, cols = r[inner], c[inner]
            edge = (rows == rows.min()) | (rows == rows.max()) | (cols == cols.min()) | (cols == cols.max())
            inner[inner] = edge
        at = at[inner]
        values = (np.array(v)[at] for v in (level, steps, label))
        out = pd.DataFrame({"t": pdf.t.to_numpy()[inner], "prow": r[inner], "pcol": c[inner]} | dict(zip(("level", "steps", "label"), values, strict=True)))
        return out[out.label > 0] if border else out

    return run


def watershed(pixels: DataFrame, tile: int = 724) -> DataFrame:
    """``pixels(prow, pcol, cost, marker, mask)`` -> ``(prow, pcol, label)`` for rasters of any size.

    Every masked pixel takes the marker reached over the path whose greatest cost is
    least, then by fewest steps at that level, then least marker: the state that follows
    from the least of its neighbours' states, which does not depend on the tiles.  Tiles
    hold up to ``tile`` squared pixels (of a narrow raster they are as high as that
    allows) and are solved on their own with the states just outside them.  Only states
    on borders are kept from round to round, and a round solves only the tiles next to a
    state that changed; at the end all are solved once more.  Basins agree with the
    flood wherever that path is unique.
    """
    spark = pixels.sparkSession
    schema = "t long, prow long, pcol long, level double, steps long, label long"
    with scope(spark) as own:
        base = pixels.where("mask").select("prow", "pcol", F.col("cost").cast("double").alias("cost"), F.greatest(F.coalesce("marker", F.lit(0)), F.lit(0)).cast("long").alias("marker"))
        base = materialize(base, "ws")
        r0, r1, c0, c1 = base.agg(F.min("prow"), F.max("prow"), F.min("pcol"), F.max("pcol")).first()
        if r0 is None:
            return keep(base.select("prow", "pcol", F.col("marker").alias("label")), "labels", own)
        wide = min(tile, c1 - c0 + 1)
        high, across = max(1, tile * tile // wide), -(-(c1 - c0 + 1) // wide)
        of = lambda r, c: (F.floor((r - r0) / high) * across + F.floor((c - c0) / wide)).cast("long")
        tiled = materialize(base.withColumn("t", of(F.col("prow"), F.col("pcol"))).repartitionByRange("t").sortWithinPartitions("t"), "ws-tiles")
        seed = F.col("marker") > 0
        start = tiled.select("t", "prow", "pcol", "cost", F.when(seed, F.col("cost")).otherwise(0.0).alias("level"), F.lit(0).cast("long").alias("steps"), F.col("marker").alias("label"), F.lit(False).alias("halo"))
        moves = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("m")

        def seen(edge: DataFrame) -> DataFrame:
            """States on borders, by the tile that lies next to them."""
            each = edge.select("*", moves).withColumns({"__r": F.col("prow") + F.col("m.r"), "__c": F.col("pcol") + F.col("m.c")})
            each = each.where(F.col("__r").between(r0, r1) & F.col("__c").between(c0, c1)).withColumn("__t", of(F.col("__r"), F.col("__c"))).where("__t <> t")
            return each.select(F.col("__t").alias("t"), "prow", "pcol", F.lit(0.0).alias("cost"), "level", "steps", "label", F.lit(True).alias("halo"))

        def solved(edge: DataFrame, some: list[int] | None, border: bool) -> DataFrame:
            rows = start.unionByName(seen(edge))
            rows = rows if some is None else rows.where(F.col("t").isin(some))
            return rows.groupBy("t").applyInPandas(_relax(border), schema)

        edge, active = spark.createDataFrame([], schema), [x.t for x in tiled.where("marker > 0").select("t").distinct().collect()]
        while active:
            new = materialize(solved(edge, active, True), "ws-new")
            moved = new.join(edge.where(F.col("t").isin(active)), ["t", "prow", "pcol", "level", "steps", "label"], "left_anti")
            after = [x.t for x in seen(moved).select("t").distinct().collect()]
            edge, active = materialize(edge.where(~F.col("t").isin(active)).unionByName(new), "ws-edge"), after
        return keep(solved(edge, None, False).select("prow", "pcol", "label"), "labels", own)
