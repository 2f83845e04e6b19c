"""Nearest neighbours by grid cells, no pairwise scan.

Queries and points are put into square cells.  A query is joined with the cells of a
ring-1 square; its k-th neighbour is final when it is no further than the edge of the
searched square.  What is not final goes on with a square twice as wide, so crowded
places are done at once and only sparse ones search far.  Ties go by (distance, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import materialize
from .joins import cell_size


def knn(queries: DataFrame, points: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """``(qid, pid, z, d2, rank)`` of the min(k, n) nearest of ``points(pid, x, y, z)`` to ``queries(qid, x, y)``.

    Null coordinates match nothing; ``qid`` is unique.  Each round holds only the
    queries that the one before left open and writes its result to the shared folder;
    their number is bounded by the logarithm of the extent over the cell.
    """
    pts = points.where("x IS NOT NULL AND y IS NOT NULL").select("pid", "x", "y", "z")
    q = queries.where("x IS NOT NULL AND y IS NOT NULL").select("qid", "x", "y")
    ends = pts.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    n = ends["n"]
    schema = "qid long, pid long, z double, d2 double, rank int"
    if not n:
        return queries.sparkSession.createDataFrame([], schema)
    k = min(k, n)
    wide, high = ends["x1"] - ends["x0"], ends["y1"] - ends["y0"]
    if cell is None:
        cell = cell_size(max(wide * high, 1e-6), n, max(4, k))
    qe = q.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if qe["x0"] is None:
        return queries.sparkSession.createDataFrame([], schema)
    reach = max(ends["x1"], qe["x1"]) - min(ends["x0"], qe["x0"]), max(ends["y1"], qe["y1"]) - min(ends["y0"], qe["y0"])
    parts, open_, size = [], q, cell
    while True:
        last = size >= max(reach) + 1e-9  # the ring of nine cells now holds everything
        key = lambda c, s=size: F.floor(F.col(c) / s).cast("long")
        near = F.sequence(F.lit(-1), F.lit(1))
        ring = open_.select("qid", "x", "y", key("x").alias("kx"), key("y").alias("ky")).withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
        ring = ring.select("qid", "x", "y", (F.col("kx") + F.col("i")).alias("cx"), (F.col("ky") + F.col("j")).alias("cy"))
        held = pts.select("pid", F.col("x").alias("px"), F.col("y").alias("py"), "z", key("x").alias("cx"), key("y").alias("cy"))
        dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
        pairs = ring.join(held, ["cx", "cy"]).select("qid", "x", "y", "pid", "z", (dx * dx + dy * dy).alias("d2"))
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("d2", "pid"))).where(F.col("rank") <= k)
        # distance from the query to the edge of its 3 x 3 square
        fx, fy = F.col("x") - F.floor(F.col("x") / size) * size, F.col("y") - F.floor(F.col("y") / size) * size
        edge = F.lit(size) + F.least(fx, F.lit(size) - fx, fy, F.lit(size) - fy)
        full = ranked.withColumn("__far", F.max("d2").over(W.partitionBy("qid"))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("qid")))
        done = full if last else full.where((F.col("__n") >= k) & (F.col("__far") < edge * edge))
        done = materialize(done.select("qid", "pid", "z", "d2", "rank"), "knn")  # else every later round would find it again
        parts.append(done)
        if last:
            break
        open_ = open_.join(done.where("rank = 1").select("qid"), "qid", "left_anti")
        if open_.isEmpty():
            break
        size *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest(queries: DataFrame, points: DataFrame, cell: float | None = None) -> DataFrame:
    """The single nearest point of every query."""
    return knn(queries, points, 1, cell).drop("rank")
