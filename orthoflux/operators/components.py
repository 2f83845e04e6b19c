"""Connected components of pixels and of graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import keep, materialize, scope
from ..skew import own_exchange
from .geom import disc_union_area

FOUR = ((0, 1), (1, 0))
EIGHT = ((0, 1), (1, 0), (1, 1), (1, -1))
#: Edges that one task solves (about 100 bytes each there); a graph of more goes through star rounds.
TASK_EDGES = 1 << 20


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Each (u, v) of ``pairs`` with m, the least of u's neighbourhood; a node with very many neighbours may be split."""
    return pairs.join(own_exchange(least, "u"), "u").select("u", "v", "m")


def _solve(batches):
    """(node, component) of all edges of one task: roots hook on the least root next to them until no edge is open."""
    ends = [[batch.column(c).to_numpy() for batch in batches] for c in (0, 1)] if (batches := list(batches)) else [[], []]
    if not sum(map(len, ends[0])):
        return
    nodes, at = np.unique(np.concatenate([x for side in ends for x in side]), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while ((up := root[root]) != root).any():
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def graph_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: component is the least node reachable.

    Nodes that occur in no edge are not returned; self loops, repeated edges and null
    ends are harmless; an empty edge table gives an empty result.  Up to ``TASK_EDGES``
    edges are solved in one task, without a shuffle: star rounds would cost ten stages
    each, however small the graph.  Beyond, alternating large and
    small star contractions: each round is two aggregations with map-side minima and two
    equi-joins, written to the shared folder, and only three sums that tell whether the
    round changed anything reach the driver.  The number of rounds grows with the
    logarithm of the longest path.
    """
    spark = edges.sparkSession
    with scope(spark) as own:
        ends = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        cur = materialize(ends.where("u <> v"), "cc")
        if cur.count() <= TASK_EDGES:
            return keep(cur.coalesce(1).mapInArrow(_solve, "node long, component long"), "components", own)
        before = None
        while True:
            # large star: every neighbour above u moves to the least of u's neighbourhood
            both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
            large = _star(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            # small star: u and its lesser neighbours move to the least of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = _star(large, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            cur = materialize(moved.where("u <> v").distinct(), "cc")
            checks = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum("v")
            now = tuple(cur.agg(*checks).first())
            if now == before:
                break
            before = now
        roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", own)


def _label_tile(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, ids: np.ndarray, steps) -> np.ndarray:
    """Least id of each pixel's component inside one tile: pointer jumping over neighbour pairs."""
    order = np.lexsort((cols, rows))
    key = rows[order] * (1 << 31) + cols[order]
    pairs = []
    for dr, dc in steps:
        want = key + dr * (1 << 31) + dc
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        ok = (key[at] == want) & (value[order][at] == value[order])
        pairs.append((np.flatnonzero(ok), at[ok]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    lab = ids[order].copy()
    while True:
        old = lab.copy()
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        root = np.searchsorted(np.sort(ids), lab)
        lab = np.minimum(lab, lab[np.argsort(ids[order], kind="stable")][root])
        if (lab == old).all():
            break
    out = np.empty_like(lab)
    out[order] = lab
    return out


def label_components(pixels: DataFrame, id_col: str, eight: bool = True, value: str | None = None, tile: int = 512) -> DataFrame:
    """``pixels(prow, pcol, id[, value])`` with ``component``: the least id of the connected region.

    Pixels of one region share ``value`` where that is given.  Tiles are labelled on
    their own (one bounded group each); only label pairs across tile borders go into
    the graph fixpoint.  Diagonal neighbours count if ``eight``.
    """
    steps = EIGHT if eight else FOUR
    val = F.col(value).cast("long") if value else F.lit(0).cast("long")
    base = pixels.select("prow", "pcol", F.col(id_col).cast("long").alias("__id"), val.alias("__v"), F.floor(F.col("prow") / tile).alias("__tr"), F.floor(F.col("pcol") / tile).alias("__tc"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["__lab"] = _label_tile(pdf.prow.to_numpy(), pdf.pcol.to_numpy(), pdf["__v"].to_numpy(), pdf["__id"].to_numpy(), steps)
        return pdf[["prow", "pcol", "__id", "__v", "__lab"]]

    tiled = materialize(base.groupBy("__tr", "__tc").applyInPandas(run, "prow long, pcol long, __id long, __v long, __lab long"), "tiles")
    r, c = F.col("prow") % tile, F.col("pcol") % tile
    border = tiled.where((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)).select("prow", "pcol", "__v", "__lab")
    moves = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in steps]))
    there = border.select("*", moves.alias("m")).select((F.col("prow") + F.col("m.dr")).alias("prow"), (F.col("pcol") + F.col("m.dc")).alias("pcol"), "__v", F.col("__lab").alias("a"))
    edges = there.join(border.withColumnRenamed("__lab", "b"), ["prow", "pcol", "__v"]).select("a", "b").where("a <> b").distinct()
    merged = graph_components(edges)
    out = tiled.join(merged, tiled["__lab"] == merged.node, "left").select("prow", "pcol", F.col("__id").alias("__i"), F.coalesce("component", "__lab").alias("component"))
    # a row a pixel, in files that may be small enough to look like something to broadcast
    return pixels.hint("merge").join(out.select(F.col("__i").alias(id_col), "component"), id_col)


def group_filter(points: DataFrame, min_area_px: float, reach: float = 1.5) -> DataFrame:
    """Points of pixels whose buffered, dissolved group covers ``min_area_px`` square pixels or more.

    Every point becomes a disc of ``reach`` pixels and discs that overlap are one group.
    Discs overlap when their centres are nearer than twice the reach; on the pixel
    lattice this is a set of offsets, so groups are components.  The area is that of the
    union of the discs (``disc_union_area``), not a count of members.  Adds
    ``component`` and ``area_px``.
    """
    lim = 4 * reach * reach
    span = range(-int(2 * reach) - 1, int(2 * reach) + 2)
    moves = [(a, b) for a in span for b in span if a * a + b * b < lim and (a, b) > (0, 0)]
    m = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in moves]))
    at = points.select("prow", "pcol", F.col("id").cast("long").alias("id"))
    there = at.select(F.col("id").alias("a"), "prow", "pcol", m.alias("m"))
    there = there.select("a", (F.col("prow") + F.col("m.dr")).alias("prow"), (F.col("pcol") + F.col("m.dc")).alias("pcol"))
    comp = graph_components(there.join(at.withColumnRenamed("id", "b"), ["prow", "pcol"]).select("a", "b"))
    grouped = points.join(comp, points.id == comp.node, "left").withColumn("component", F.coalesce("component", F.col("id").cast("long"))).drop("node")
    big = disc_union_area(grouped, reach).where(F.col("area_px") >= min_area_px)
    return grouped.join(own_exchange(big, "component"), "component")
