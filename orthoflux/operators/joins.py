"""Joins between points, pixels and polygons, all written as equi-joins."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import GridMeta
from ..scratch import materialize
from .masks import in_grid


def raster_at_points(points: DataFrame, raster: DataFrame, grid: GridMeta, x: str = "x", y: str = "y") -> DataFrame:
    """The pixel under every point, as an equi-join on (row, column); points outside drop out."""
    return in_grid(points, grid, x, y).join(raster, ["prow", "pcol"])


def _patches(centres: DataFrame, raster: DataFrame, low: int, high: int, shift_low: bool) -> DataFrame:
    """Pixels of the patch around every ``(__r, __c)``: offsets are exploded and joined by equality, so no range join is planned.

    The size of exploded rows is estimated as that of the rows before; the hint keeps
    them from being broadcast.
    """
    r0, c0 = F.col("__r") + low, F.col("__c") + low
    if shift_low:
        r0, c0 = F.greatest(F.lit(0), r0), F.greatest(F.lit(0), c0)
    span = F.sequence(F.lit(0), F.lit(high - low))
    each = centres.select("*", r0.cast("long").alias("__r0"), c0.cast("long").alias("__c0")).withColumn("__i", F.explode(span)).withColumn("__j", F.explode(span))
    keyed = each.select("__r", "__c", (F.col("__r0") + F.col("__i")).alias("prow"), (F.col("__c0") + F.col("__j")).alias("pcol"))
    return keyed.hint("merge").join(raster, ["prow", "pcol"])


def patch_pixels(points: DataFrame, raster: DataFrame, grid: GridMeta, low: int, high: int, shift_low: bool = False) -> DataFrame:
    """Pixels of a square patch around every point: offsets ``low .. high`` in rows and columns.

    What lies outside the raster is clipped.  With ``shift_low`` a patch that would begin
    outside begins at the edge and keeps its size.  Points in one pixel have one patch,
    which is looked up once.
    """
    at = in_grid(points, grid).withColumnsRenamed({"prow": "__r", "pcol": "__c"})
    met = _patches(at.select("__r", "__c").distinct(), raster, low, high, shift_low)
    return at.hint("merge").join(met, ["__r", "__c"]).drop("__r", "__c")


def patch_stats(points: DataFrame, raster: DataFrame, grid: GridMeta, low: int, high: int, *stats: Column, shift_low: bool = False) -> DataFrame:
    """``points`` with aggregates ``stats`` of the pixels that ``patch_pixels`` gives; points without a pixel drop out.

    Points in one pixel share the aggregates, so pairs of points and pixels are never made.
    """
    at = in_grid(points, grid).withColumnsRenamed({"prow": "__r", "pcol": "__c"})
    met = _patches(at.select("__r", "__c").distinct(), raster, low, high, shift_low)
    return at.hint("merge").join(met.groupBy("__r", "__c").agg(*stats), ["__r", "__c"]).drop("__r", "__c")


def training_patch(points: DataFrame, raster: DataFrame, grid: GridMeta, buffer_px: int) -> DataFrame:
    """The half-open square [r - b, r + b) that training uses: 2b x 2b pixels."""
    return patch_pixels(points, raster, grid, -buffer_px, buffer_px - 1)


def stamp_markers(raster: DataFrame, points: DataFrame, grid: GridMeta, marker: str) -> DataFrame:
    """Adds ``marker``: the greatest marker id that falls on a pixel, else 0."""
    seeds = in_grid(points, grid).groupBy("prow", "pcol").agg(F.max(marker).alias("__m"))
    return raster.join(seeds, ["prow", "pcol"], "left").withColumn("marker", F.coalesce("__m", F.lit(0))).drop("__m")


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Grid cells (as structs) that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long"))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed ring (array of x, y structs)."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("p"), F.slice(ring, F.lit(2), n - 1).alias("q"))
    crosses = lambda s: ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & (x < (s["q"]["x"] - s["p"]["x"]) * (y - s["p"]["y"]) / F.when(s["q"]["y"] == s["p"]["y"], 1.0).otherwise(s["q"]["y"] - s["p"]["y"]) + s["p"]["x"])
    return F.aggregate(pairs, F.lit(False), lambda acc, s: acc != F.coalesce(crosses(s), F.lit(False)))


def _ring_pairs(near: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ``near(pid, x, y, gid)`` the pairs with an odd number of edges to the right of the point: plain columns, one row an edge."""
    met = near.join(edges.hint("merge"), "gid").where((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y")))
    right = F.col("x") < (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    return met.where(right).groupBy("pid", "gid").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("pid", "gid")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float | None = None, semi: bool = True) -> DataFrame:
    """Points inside a polygon (outside its holes): cell-bucketed equi-join of boxes, then an exact even-odd test.

    ``points(pid, x, y, ...)``, ``polygons(gid, rings)``, ids unique.  Only boxes are
    copied to the cells they touch (of their mean extent, unless ``cell`` is given) and
    a box test on plain columns precedes the rings, which are met by polygon id, edge by
    edge.  With ``semi`` every point comes back once: all points of a cell are first
    tested against one polygon, whose box holds the cell's centre deepest, then in cells
    of half the size what is left, and only what that does not settle meets all the
    others.  Else every (point, polygon) pair comes back.
    """
    outer = F.col("rings")[0]
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    ends = F.array_min(xs).alias("bx0"), F.array_min(ys).alias("by0"), F.array_max(xs).alias("bx1"), F.array_max(ys).alias("by1")
    boxes = polygons.select("gid", *ends, (F.size("rings") == 1).alias("plain"))
    if cell is None:
        mean = boxes.agg(F.avg(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")))).first()[0]
        cell = max(mean or 1.0, 1e-9)

    def in_cells(size: float) -> DataFrame:
        each = boxes.withColumn("k", F.explode(cells_of_box(F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), size)))
        return each.select("gid", "bx0", "by0", "bx1", "by1", "plain", F.col("k.cx").alias("cx"), F.col("k.cy").alias("cy"))

    def keyed(some: DataFrame, size: float) -> DataFrame:
        return some.withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})

    ring = F.explode("rings").alias("ring")
    n = F.size("ring") - 1
    sides = F.arrays_zip(F.slice("ring", F.lit(1), n).alias("p"), F.slice("ring", F.lit(2), n).alias("q"))

    def edges_of(some: DataFrame) -> DataFrame:
        each = some.select("gid", ring).select("gid", F.explode(sides).alias("s"))
        return each.select("gid", *(F.col(f"s.{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("pq") for c in "xy"))

    def near(some: DataFrame) -> DataFrame:
        boxed = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
        return keyed(some, cell).join(in_cells(cell).hint("merge"), ["cx", "cy"]).where(boxed).select("pid", "x", "y", "gid")

    bare = points.select("pid", "x", "y")
    if not semi:
        return points.join(_ring_pairs(near(bare), edges_of(polygons)), "pid")
    open_, hits = bare, []
    for size in (cell, cell / 2):
        x, y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
        depth = F.least(x - F.col("bx0"), F.col("bx1") - x, y - F.col("by0"), F.col("by1") - y)
        best = in_cells(size).groupBy("cx", "cy").agg(F.max(F.struct("plain", depth.alias("depth"), "gid")).alias("b")).select("cx", "cy", "b.gid")
        best = materialize(best, "deepest-box")
        edges = edges_of(polygons.join(best.select("gid").distinct(), "gid", "left_semi"))
        hits.append(materialize(_ring_pairs(keyed(open_, size).join(best, ["cx", "cy"]).select("pid", "x", "y", "gid"), edges).select("pid"), "hit"))
        open_ = materialize(open_.join(hits[-1], "pid", "left_anti"), "open")
        if open_.isEmpty():
            break
    else:
        hits.append(_ring_pairs(near(open_), edges_of(polygons)).select("pid").distinct())
    return points.join(functools.reduce(DataFrame.unionByName, hits), "pid", "left_semi")


#: Points of a tile that are compared at once, and pairs that are handed on at once.
BLOCK, PAIRS = 16, 1 << 18


def _by_tile(points: DataFrame, radius: float, run, schema: str) -> DataFrame:
    """``run`` over square tiles of the radius's size: a tile's own points of ``points(pid, x, y, z)`` and all others
    (``own`` false) that may be within ``radius`` of one of them.

    ``run`` takes a tile as a table and yields record batches.  A partition is a stream
    of tiles, of which one is held at a time.  The work is in pairs, not in bytes, so
    the number of partitions is fixed and small ones are not joined.
    """
    spark = points.sparkSession
    tile = lambda c: F.floor(c / radius).cast("long")
    far = radius * (1 + 1e-9)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    inf = float("inf")
    placed = points.select("pid", x.alias("x"), y.alias("y"), F.col("z").cast("double").alias("z")).where((F.abs("x") < inf) & (F.abs("y") < inf))
    wide = placed.withColumn("tx", F.explode(F.sequence(tile(F.col("x") - far), tile(F.col("x") + far)))).withColumn("ty", F.explode(F.sequence(tile(F.col("y") - far), tile(F.col("y") + far))))
    own = (F.col("tx") == tile(F.col("x"))) & (F.col("ty") == tile(F.col("y")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = wide.withColumn("own", own).repartition(n, "tx", "ty").sortWithinPartitions("tx", "ty")

    def stream(batches):
        held = []
        for batch in batches:
            tx, ty = batch.column("tx").to_numpy(), batch.column("ty").to_numpy()
            cuts = np.flatnonzero((tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])) + 1
            ends = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and part.num_rows and (held[0].column("tx")[0] != part.column("tx")[0] or held[0].column("ty")[0] != part.column("ty")[0]):
                    yield from run(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(stream, schema)


def _near(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float):
    """Blocks ``(which a, which b, squared distances)`` of a x b, which b in rising order: only points b in the box around a
    block are compared."""
    order, far = np.lexsort((ax, np.floor(ay / (radius / 4)))), radius * (1 + 1e-9)
    for at in range(0, len(order), BLOCK):
        a = order[at : at + BLOCK]
        x, y = ax[a], ay[a]
        b = np.flatnonzero((bx >= x.min() - far) & (bx <= x.max() + far) & (by >= y.min() - far) & (by <= y.max() + far))
        dx, dy = x[:, None] - bx[b], y[:, None] - by[b]
        dx *= dx
        dy *= dy
        dx += dy
        yield a, b, dx


def within_radius(points: DataFrame, radius: float, columns: tuple[str, ...] = ("a", "b", "d2", "z")) -> DataFrame:
    """``(a, b, d2, z)``, or ``columns`` of these: all pairs of ``points(pid, x, y, z)`` no further apart than ``radius``,
    each with itself too; z is that of b.

    Tiles of the radius's size, compared by numpy and handed on in batches of bounded size.
    """
    kinds = {"a": points.schema["pid"].dataType.simpleString(), "b": points.schema["pid"].dataType.simpleString(), "d2": "double", "z": "double"}

    def run(tile):
        pid, x, y, z = (tile.column(c).combine_chunks() for c in ("pid", "x", "y", "z"))
        x, y, mine = x.to_numpy(), y.to_numpy(), np.flatnonzero(tile.column("own").to_numpy())
        left, right, dist, n = [], [], [], 0

        def made():
            i, j = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
            have = {"a": lambda: pid.take(i), "b": lambda: pid.take(j), "d2": lambda: pa.array(np.concatenate(dist)), "z": lambda: z.take(j)}
            return pa.RecordBatch.from_arrays([have[c]() for c in columns], names=list(columns))

        for a, b, d2 in _near(x[mine], y[mine], x, y, radius):
            inside = d2 <= radius * radius
            at, each = np.flatnonzero(inside), np.count_nonzero(inside, axis=1)
            left.append(np.repeat(mine[a], each))
            right.append(b.take(at - np.repeat(np.arange(len(a)) * len(b), each)))
            if "d2" in columns:
                dist.append(d2.take(at))
            n += len(at)
            if n >= PAIRS:
                yield made()
                left, right, dist, n = [], [], [], 0
        if n:
            yield made()

    return _by_tile(points, radius, run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _local_spread(radius: float):
    """Median and population deviation of the known z within ``radius`` of a tile's own points; equal places are one."""

    def run(tile):
        x, y, z = (tile.column(c).to_numpy() for c in ("x", "y", "z"))
        mine = np.flatnonzero(tile.column("own").to_numpy())
        if not len(mine):
            return
        places, at = np.unique(np.c_[x[mine], y[mine]], axis=0, return_inverse=True)
        known = np.flatnonzero(tile.column("z").is_valid().to_numpy())
        known = known[np.argsort(z[known], kind="stable")]  # by z, so the middle ones of a place's neighbours give its median
        bx, by, bz = x[known], y[known], z[known]
        med, sd, n = (np.zeros(len(places)) for _ in range(3))
        with np.errstate(all="ignore"):
            for a, b, d2 in _near(places[:, 0], places[:, 1], bx, by, radius):
                zs = bz[b]
                for k, row in zip(a, d2 <= radius * radius, strict=True):
                    v = zs.take(np.flatnonzero(row))
                    n[k] = len(v)
                    if len(v):
                        med[k] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
                        d = v - v.mean()
                        sd[k] = np.sqrt(d.dot(d) / len(v))
        none = (n == 0)[at.ravel()]
        out = [tile.column("pid").combine_chunks().take(pa.array(mine)), *(pa.array(v[at.ravel()], mask=none) for v in (med, sd))]
        yield pa.RecordBatch.from_arrays(out, names=["a", "med", "sd"])

    return run


def local_outliers(points: DataFrame, radius: float, k: float = 1.5) -> DataFrame:
    """Points whose z is within ``k`` local deviations above the local median.

    Pairs of points are not made into rows: a tile's points and all that may be near them
    are one task's.  Points that share an id share the neighbours of all of them; these,
    as a rule none, go by pairs.
    """
    near = _by_tile(points, radius, _local_spread(radius), f"a {points.schema['pid'].dataType.simpleString()}, med double, sd double")
    again = points.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND pid IS NOT NULL").select(F.col("pid").alias("a"))
    if not again.isEmpty():
        pairs = within_radius(points, radius, ("a", "z")).join(again, "a", "left_semi")
        near = near.join(again, "a", "left_anti").unionByName(pairs.groupBy("a").agg(F.median("z").alias("med"), F.stddev_pop("z").alias("sd")))
    return points.join(near, points.pid == near.a).where(F.col("z") <= F.col("med") + F.col("sd") * k).drop("a", "med", "sd")


def cell_size(extent_area: float, n: int, per_cell: int = 4) -> float:
    """A cell that holds about ``per_cell`` of n evenly spread points."""
    return max(1e-9, math.sqrt(extent_area * per_cell / max(1, n)))
