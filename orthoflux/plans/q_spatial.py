"""Queries of stencils, joins, neighbours, components and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import indices as X
from ..operators import components as C
from ..operators import geom as G
from ..operators import joins as J
from ..operators import masks as M
from ..operators import stencil as N
from ..operators.knn import knn, nearest
from . import fixtures as fx
from .fixtures import sql
from .registry import query, r6

H, V = "(PARTITION BY prow ORDER BY pcol)", "(PARTITION BY pcol ORDER BY prow)"


def _s3(v, w):
    return f"(coalesce(lag({v}) OVER {w}, {v}) + {v} + coalesce(lead({v}) OVER {w}, {v}))"


def _one(name, f, body, *ctes, out="v"):
    """A stencil query on px: id and the rounded output."""
    query(name, sql(body, *ctes))(lambda s, d: f(fx.px(s, d)).select("id", r6(out).alias("v")))


_one("n1_mean3", lambda p: N.mean3(p, "mds", "v"), f"SELECT id, round({_s3('hs', V)} / 9e0, 6) AS v FROM h", "px", f"h AS (SELECT *, {_s3('mds', H)} AS hs FROM px)")
_one(
    "n2_variance3", lambda p: N.variance3(p.withColumn("gr", X.gray().cast("double")), "gr", "v"), "SELECT id, round(greatest(0e0, m2 - m1 * m1), 6) + 0e0 AS v FROM m", "px",
    "gy AS (SELECT *, round(r * 0.299e0 + g * 0.587e0 + b * 0.114e0) AS gr FROM px)", f"h AS (SELECT *, {_s3('gr', H)} AS s1, {_s3('(gr * gr)', H)} AS s2 FROM gy)", f"m AS (SELECT *, {_s3('s1', V)} / 9e0 AS m1, {_s3('s2', V)} / 9e0 AS m2 FROM h)",
)
_SB = [
    "px", "gy AS (SELECT *, round(r * 0.299e0 + g * 0.587e0 + b * 0.114e0) AS gr FROM px)",
    f"ab AS (SELECT *, coalesce(lag(gr) OVER {H}, lead(gr) OVER {H}, gr) AS la, coalesce(lead(gr) OVER {H}, lag(gr) OVER {H}, gr) AS lb FROM gy)",
    "ds AS (SELECT *, lb - la AS dd, la + gr * 2e0 + lb AS ss FROM ab)",
    f"sb AS (SELECT *, coalesce(lag(dd) OVER {V}, lead(dd) OVER {V}, dd) + dd * 2e0 + coalesce(lead(dd) OVER {V}, lag(dd) OVER {V}, dd) AS gx, coalesce(lead(ss) OVER {V}, lag(ss) OVER {V}, ss) - coalesce(lag(ss) OVER {V}, lead(ss) OVER {V}, ss) AS gy2 FROM ds)",
]
query("n3_sobel_xy", sql("SELECT id, round(gx, 6) + 0e0 AS gx, round(gy2, 6) + 0e0 AS gy FROM sb", *_SB))(lambda s, d: N.sobel(fx.px(s, d).withColumn("gr", X.gray().cast("double")), "gr").select("id", r6("gx").alias("gx"), r6("gy").alias("gy")))
query("n4_sobel_magnitude", sql("SELECT id, round(sqrt(gx * gx + gy2 * gy2), 6) + 0e0 AS v FROM sb", *_SB))(lambda s, d: N.sobel(fx.px(s, d).withColumn("gr", X.gray().cast("double")), "gr").select("id", r6("sobel").alias("v")))


def _diff(w):
    return f"CASE WHEN lag(mds) OVER {w} IS NULL AND lead(mds) OVER {w} IS NULL THEN 0e0 WHEN lag(mds) OVER {w} IS NULL THEN (lead(mds) OVER {w} - mds) / 2e0 WHEN lead(mds) OVER {w} IS NULL THEN (mds - lag(mds) OVER {w}) / 2e0 ELSE (lead(mds) OVER {w} - lag(mds) OVER {w}) / 4e0 END"


query("n5_p13_gradient_slope", sql("SELECT id, round(dr, 9) + 0e0 AS d_row, round(dc, 9) + 0e0 AS d_col, round(sqrt(dr * dr + dc * dc) * 100e0, 6) + 0e0 AS slope FROM g", "px", f"g AS (SELECT id, {_diff(V)} AS dr, {_diff(H)} AS dc FROM px)"))(
    lambda s, d: N.gradient(fx.px(s, d), "mds", 2.0).select("id", (F.round("d_row", 9) + F.lit(0.0)).alias("d_row"), (F.round("d_col", 9) + F.lit(0.0)).alias("d_col"), r6(X.slope_percent(F.col("d_row"), F.col("d_col"))).alias("slope"))
)
_BOX = "bx AS (SELECT a.r AS dr, b.c AS dc FROM (SELECT unnest([-1, 0, 1]) AS r) a, (SELECT unnest([-1, 0, 1]) AS c) b)"
_ELL = "bx AS (SELECT a.r AS dr, b.c AS dc FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS r) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS c) b WHERE abs(a.r) < 2 OR b.c = 0)"


def _around(name, src, v, f):
    return f"{name} AS (SELECT p.id, p.prow, p.pcol, {f}(q.{v}) AS v FROM {src} p, bx JOIN {src} q ON q.prow = p.prow + bx.dr AND q.pcol = p.pcol + bx.dc GROUP BY p.id, p.prow, p.pcol)"


for _name, _f, _k, _bx, _fs in (
    ("n7_erode_ellipse", N.erode, N.ELLIPSE5, _ELL, ("min",)),
    ("n7_dilate_ellipse", N.dilate, N.ELLIPSE5, _ELL, ("max",)),
    ("n7_open_ellipse", N.opened, N.ELLIPSE5, _ELL, ("min", "max")),
    ("n7_close_ellipse", N.closed, N.ELLIPSE5, _ELL, ("max", "min")),
    ("n8_open_box", N.opened, N.BOX3, _BOX, ("min", "max")),
    ("n9_dilate_labels", N.dilate, N.BOX3, _BOX, ("max",)),
):
    _ctes = ["px", _bx, _around("s0", "px", "g", _fs[0])] + ([_around("s1", "s0", "v", _fs[1])] if len(_fs) > 1 else [])
    query(_name, sql(f"SELECT id, v FROM s{len(_fs) - 1}", *_ctes))(lambda s, d, f=_f, k=_k: f(fx.px(s, d), "g", "v", k).select("id", "v"))

_TAPS = "tp AS (SELECT i, w / sum(w) OVER () AS w FROM (SELECT i, exp(-(i * i) / 4.5e0) AS w FROM (SELECT unnest(range(-6, 7)) AS i)))"
_DIM = "dm AS (SELECT max(prow) AS hr, max(pcol) AS hc FROM px)"


def _gauss(src, v, name):
    a = f"{name}h AS (SELECT p.id, p.prow, p.pcol, sum(q.{v} * tp.w) AS {v} FROM {src} p, tp, dm JOIN {src} q ON q.prow = p.prow AND q.pcol = greatest(0, least(hc, p.pcol + tp.i)) GROUP BY 1, 2, 3)"
    b = f"{name} AS (SELECT p.id, p.prow, p.pcol, sum(q.{v} * tp.w) AS {v} FROM {name}h p, tp, dm JOIN {name}h q ON q.pcol = p.pcol AND q.prow = greatest(0, least(hr, p.prow + tp.i)) GROUP BY 1, 2, 3)"
    return a, b


_one("n10_gaussian", lambda p: N.gaussian(p, "mds", "v"), "SELECT id, round(mds, 6) AS v FROM gs", "px", _TAPS, _DIM, *_gauss("px", "mds", "gs"))
_one("n11_gaussian_gaps", lambda p: N.gaussian_with_gaps(p.withColumn("z", F.when(M.valid_alpha(), F.col("mds"))), "z", "v"), "SELECT a.id, CASE WHEN w > 0.01e0 THEN round(f / w, 6) END AS v FROM gf a JOIN gw b ON a.id = b.id", "px", _TAPS, _DIM, "fz AS (SELECT id, prow, pcol, CASE WHEN a >= 250 THEN mds ELSE 0e0 END AS f, CASE WHEN a >= 250 THEN 1e0 ELSE 0e0 END AS w FROM px)", *_gauss("fz", "f", "gf"), *_gauss("fz", "w", "gw"))
_SIZE = "size AS (SELECT max(prow) + 1 AS h, max(pcol) + 1 AS w FROM px)"
_DISC = "disc AS (SELECT dy, dx FROM (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx) WHERE dy * dy + dx * dx <= 16)"
_SEEN = "seen AS (SELECT p.id, r, g, b, dy * dy + dx * dx AS d2, abs((prow + dy + h - 1) % (2 * (h - 1)) - (h - 1)) AS nr, abs((pcol + dx + w - 1) % (2 * (w - 1)) - (w - 1)) AS nc FROM px p, size, disc)"
_WEIGHT = """near AS (SELECT s.id, q.r, q.g, q.b, exp(-pow(CAST(abs(q.r - s.r) + abs(q.g - s.g) + abs(q.b - s.b) AS DOUBLE), 2e0) / 11250e0 - d2 / 11250e0) AS wt
  FROM seen s JOIN px q ON q.prow = s.nr AND q.pcol = s.nc)"""
_MEANS = ", ".join(f"round(sum(wt * {c}) / sum(wt), 6) AS {c}" for c in "rgb")
query("n6_bilateral", sql(f"SELECT prow, pcol, n.* EXCLUDE (id) FROM (SELECT id, {_MEANS} FROM near GROUP BY id) n JOIN px USING (id)", "px", _SIZE, _DISC, _SEEN, _WEIGHT))(
    lambda s, d: N.bilateral(fx.px(s, d)).select("prow", "pcol", *[r6(c).alias(c) for c in "rgb"])
)

_AT = "onpx AS (SELECT pid, label, class, x, y, z, CAST(floor((f - y) / 2e0) AS BIGINT) AS pr, CAST(floor(x / 2e0) AS BIGINT) AS pc FROM train, grd WHERE x >= 0 AND x < 250 AND y <= f AND y > 0)"


def _meta(s, d):
    return fx.meta(fx.rows_of(s, d))


def _patch_sums(s, d, low, high, shift_low=False):
    """By point id: pixels of its patch, those with a green value, and the sum of these."""
    stats = F.count(F.lit(1)).alias("n"), F.count("g").alias("m"), F.sum("g").alias("sum_g")
    found = J.patch_stats(fx.train(s, d), fx.px(s, d), _meta(s, d), low, high, *stats, shift_low=shift_low)
    return found.groupBy("pid").agg(*(F.sum(c).alias(c) for c in ("n", "m", "sum_g")))


query("j1_raster_at_points", sql("SELECT pid, round(mds, 6) AS z FROM onpx JOIN px ON prow = pr AND pcol = pc", "train", "grd", "px", _AT))(lambda s, d: J.raster_at_points(fx.train(s, d).drop("z"), fx.px(s, d), _meta(s, d)).select("pid", r6("mds").alias("z")))
query("s2_windowed_read", sql("SELECT id FROM px WHERE prow >= 16 AND prow < 48 AND pcol < 64", "px"))(lambda s, d: fx.px(s, d).where("prow >= 16 AND prow < 48 AND pcol < 64").select("id"))
query("j2_n12_training_patch", sql("SELECT pid, count(*) AS n, round(avg(g), 6) AS mean_g FROM onpx JOIN px ON prow BETWEEN pr - 2 AND pr + 1 AND pcol BETWEEN pc - 2 AND pc + 1 GROUP BY pid", "train", "grd", "px", _AT))(
    lambda s, d: _patch_sums(s, d, -2, 1).select("pid", "n", r6(F.col("sum_g") / F.when(F.col("m") > 0, F.col("m"))).alias("mean_g"))
)
query("n13_inclusive_patch", sql("SELECT pid, count(*) AS n, CAST(sum(g) AS BIGINT) AS sum_g FROM onpx JOIN px ON prow BETWEEN pr - 5 AND pr + 5 AND pcol BETWEEN pc - 5 AND pc + 5 GROUP BY pid", "train", "grd", "px", _AT))(lambda s, d: _patch_sums(s, d, -5, 5).select("pid", "n", "sum_g"))
query("n14_shifted_patch", sql("SELECT pid, count(*) AS n, CAST(sum(g) AS BIGINT) AS sum_g FROM onpx JOIN px ON prow BETWEEN greatest(0, pr - 5) AND greatest(0, pr - 5) + 10 AND pcol BETWEEN greatest(0, pc - 5) AND greatest(0, pc - 5) + 10 GROUP BY pid", "train", "grd", "px", _AT))(
    lambda s, d: _patch_sums(s, d, -5, 5, shift_low=True).select("pid", "n", "sum_g")
)
query("j7_colocated", sql("SELECT a.id, round(a.p_tree + b.mds, 6) AS v FROM prob a JOIN px b ON a.prow = b.prow AND a.pcol = b.pcol", "prob"))(lambda s, d: fx.prob(s, d).select("prow", "pcol", "p_tree", "id").join(fx.px(s, d).select("prow", "pcol", "mds"), ["prow", "pcol"]).select("id", r6(F.col("p_tree") + F.col("mds")).alias("v")))
query("j8_stamp_markers", sql("SELECT id, coalesce(m, 0) AS marker FROM px LEFT JOIN (SELECT pr, pc, max(pid) AS m FROM onpx GROUP BY 1, 2) ON prow = pr AND pcol = pc", "train", "grd", "px", _AT))(lambda s, d: J.stamp_markers(fx.px(s, d), fx.train(s, d), _meta(s, d), "pid").select("id", "marker"))
query("a16_mean_at_points", sql("SELECT class, round(avg(p_tree), 6) AS mean_p FROM onpx JOIN prob ON prow = pr AND pcol = pc GROUP BY class", "train", "grd", "prob", _AT))(lambda s, d: J.raster_at_points(fx.train(s, d), fx.prob(s, d), _meta(s, d)).groupBy("class").agg(r6(F.avg("p_tree")).alias("mean_p")))
_SQ = "abs(p.x - q.x) < q.side / 2e0 AND abs(p.y - q.y) < q.side / 2e0"
_HO = "NOT (q.holes = 1 AND abs(p.x - q.x) < q.side / 4e0 AND abs(p.y - q.y) < q.side / 4e0)"
# quarter-unit shift: no point lies on an edge
query("j3_g15_points_in_polygons", sql(f"SELECT DISTINCT p.pid FROM sh p JOIN poly q ON {_SQ} AND {_HO}", "poly", "sh AS (SELECT pid, x + 0.037e0 AS x, y + 0.041e0 AS y FROM pts)"))(
    lambda s, d: J.points_in_polygons(fx.pts(s, d).select("pid", (F.col("x") + 0.037).alias("x"), (F.col("y") + 0.041).alias("y")), fx.poly(s, d).select("gid", "rings")).select("pid")
)
query("j9_radius_pairs", sql("SELECT a.pid AS a, b.pid AS b FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16e0", "pts"))(lambda s, d: J.within_radius(fx.pts(s, d), 4.0, ("a", "b")))
query("a20_local_outliers", sql("SELECT p.pid FROM pts p JOIN (SELECT a.pid, median(b.z) AS med, stddev_pop(b.z) AS sd FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64e0 GROUP BY a.pid) n ON p.pid = n.pid WHERE p.z <= med + sd * 1.5e0", "pts"))(lambda s, d: J.local_outliers(fx.pts(s, d), 8.0).select("pid"))

CELLS = "cells AS (SELECT a.i * 20 + b.j AS qid, (b.j + 0.5e0) * 10e0 AS x, 210e0 + (a.i + 0.5e0) * -10e0 AS y FROM (SELECT unnest(range(0, 21)) AS i) a, (SELECT unnest(range(0, 20)) AS j) b)"
NEAR = "nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM (SELECT c.qid, p.pid, p.z, (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) AS d2 FROM cells c, pts p))"


def cells(s):
    g = fx.GridMeta.over(0.0, 0.0, 200.0, 210.0, 10.0)
    return g.cells(s).select((F.col("prow") * 20 + F.col("pcol")).alias("qid"), "x", "y")


query("i11_grid", sql("SELECT qid, round(x, 6) AS x, round(y, 6) AS y FROM cells", CELLS))(lambda s, d: cells(s).select("qid", r6("x").alias("x"), r6("y").alias("y")))
query("j4_knn", sql("SELECT qid, pid, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nn WHERE rank <= 8", "pts", CELLS, NEAR))(lambda s, d: knn(cells(s), fx.pts(s, d), 8).select("qid", "pid", "rank", r6("d2").alias("d2")))
query("j5_nearest", sql("SELECT qid, pid FROM nn WHERE rank = 1", "pts", CELLS, NEAR))(lambda s, d: nearest(cells(s), fx.pts(s, d)).select("qid", "pid"))

# ---- components and polygons
_BIN = "bin AS (SELECT id, prow, pcol FROM px WHERE r < 60)"


def _reach(cond):
    return f"reach(id, cid) AS (SELECT id, id FROM bin UNION SELECT q.id, r.cid FROM reach r JOIN bin p ON p.id = r.id JOIN bin q ON {cond}), comp AS (SELECT id, min(cid) AS component FROM reach GROUP BY id)"


def _rec(body, cond, extra=""):
    return f"WITH RECURSIVE {fx.CTE['px']}, {_BIN}, {_reach(cond)}{extra} {body}"


_C8, _C4 = "abs(p.prow - q.prow) <= 1 AND abs(p.pcol - q.pcol) <= 1", "abs(p.prow - q.prow) + abs(p.pcol - q.pcol) <= 1"
_CG = "(p.prow - q.prow) * (p.prow - q.prow) + (p.pcol - q.pcol) * (p.pcol - q.pcol) < 9"


def _bin(s, d):
    return fx.px(s, d).where("r < 60").select("id", "prow", "pcol")


query("g4_components8", _rec("SELECT id, component FROM comp", _C8))(lambda s, d: C.label_components(_bin(s, d), "id", True, tile=64).select("id", "component"))
query("g10_components4_areas", _rec("SELECT component, count(*) AS n_pixels, round(count(*) * 4e0, 6) AS area FROM comp GROUP BY component", _C4))(lambda s, d: C.label_components(_bin(s, d), "id", False, tile=64).groupBy("component").agg(F.count(F.lit(1)).alias("n_pixels"), (F.count(F.lit(1)) * 4.0).alias("area")))
# groups of overlapping discs: the least id spreads to whatever is near, round by round
_MOVES = ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3) if 0 < a * a + b * b < 9)
_GROUPS = f"""mv(dr, dc) AS (VALUES {_MOVES}),
near AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM bin p, mv JOIN bin q ON q.prow = p.prow + dr AND q.pcol = p.pcol + dc),
comp(id, component) USING KEY (id) AS (
  SELECT id, id FROM bin
  UNION
  SELECT n.b, min(c.component) FROM comp c JOIN near n ON n.a = c.id JOIN recurring.comp r ON r.id = n.b WHERE c.component < r.component GROUP BY n.b),
area AS (
  SELECT component, count(*) / 64e0 AS area_px FROM (
    SELECT DISTINCT component, prow * 8 + i.i AS sr, pcol * 8 + j.i AS sc
    FROM comp JOIN bin USING (id), (SELECT unnest(range(-12, 12)) AS i) i, (SELECT unnest(range(-12, 12)) AS i) j
    WHERE (i.i + 0.5e0) * (i.i + 0.5e0) + (j.i + 0.5e0) * (j.i + 0.5e0) <= 144e0)
  GROUP BY component)"""


def _grouped(body):
    return f"WITH RECURSIVE {fx.CTE['px']}, {_BIN}, {_GROUPS} {body}"


query("g2_a11_dissolved_groups", _grouped("SELECT id, component FROM comp"))(lambda s, d: C.group_filter(_bin(s, d), 1).select("id", "component"))
query("f20_group_filter", _grouped("SELECT id FROM comp JOIN area USING (component) WHERE area_px >= 50"))(lambda s, d: C.group_filter(_bin(s, d), 50).select("id"))
query("g3_dissolved_area", _grouped("SELECT component, area_px FROM area"))(
    lambda s, d: G.disc_union_area(C.group_filter(_bin(s, d), 0), 1.5).select("component", "area_px")
)
query("o2_largest_per_label", sql("SELECT label, gid FROM (SELECT gid % 10 AS label, gid, row_number() OVER (PARTITION BY gid % 10 ORDER BY side * side DESC, gid) AS rn FROM poly) WHERE rn = 1", "poly"))(
    lambda s, d: fx.poly(s, d).select((F.col("gid") % 10).alias("label"), "gid", (F.col("side") * F.col("side")).alias("q")).withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("q"), "gid"))).where("rn = 1").select("label", "gid")
)
query("g1_k8_buffers", sql("SELECT pid, 65 AS n, round(x + 1.5e0, 6) AS x0, round(0.5e0 * 64 * 2.25e0 * sin(2 * pi() / 64), 6) AS area FROM pts", "pts"))(
    lambda s, d: fx.pts(s, d).select("pid", "x", G.disc(F.col("x"), F.col("y"), 1.5).alias("ring")).select("pid", F.size("ring").alias("n"), r6(F.col("ring")[0]["x"]).alias("x0"), r6(G.ring_area(F.col("ring"))).alias("area"))
)
query("g5_explode_parts", sql("SELECT gid, unnest(range(0, 1 + holes)) AS part FROM poly", "poly"))(lambda s, d: fx.poly(s, d).select("gid", F.posexplode("rings").alias("part", "ring")).select("gid", F.col("part").cast("long").alias("part")))
query("g7_polygon_area", sql("SELECT gid, round(side * side - holes * side * side / 4e0, 6) AS area FROM poly", "poly"))(lambda s, d: fx.poly(s, d).select("gid", r6(G.polygon_area(F.col("rings"))).alias("area")))
_KEPT = "CASE WHEN holes = 1 AND side * side / 4e0 >= 62.5e0 THEN 1 ELSE 0 END"
query("g6_f22_clean_polygons", sql(f"SELECT gid, holes - {_KEPT} AS holes_removed, round(side * side - {_KEPT} * side * side / 4e0, 6) AS area_m2 FROM poly WHERE side * side - {_KEPT} * side * side / 4e0 <= 312.5e0", "poly"))(lambda s, d: G.clean_polygons(fx.poly(s, d), 62.5, 312.5).select("gid", "holes_removed", r6("area_m2").alias("area_m2")))
query("a18_holes_removed", sql(f"SELECT CAST(sum(holes - {_KEPT}) AS BIGINT) AS removed FROM poly WHERE side * side - {_KEPT} * side * side / 4e0 <= 312.5e0", "poly"))(lambda s, d: G.clean_polygons(fx.poly(s, d), 62.5, 312.5).agg(F.sum("holes_removed").alias("removed")))
query("g9_contour_to_world", sql("SELECT gid, round((x - side / 2e0 + 0.5e0) * 2e0, 6) AS x0 FROM poly", "poly"))(lambda s, d: fx.poly(s, d).select("gid", F.transform(F.col("rings")[0], lambda p: (p["x"] + 0.5) * 2.0).alias("xs")).select("gid", r6(F.col("xs")[0]).alias("x0")))
query("f26_valid_rings", sql("SELECT gid FROM poly", "poly"))(lambda s, d: fx.poly(s, d).where(G.valid_ring(F.col("rings")[0])).select("gid"))
query("g14_convex_hull", sql("SELECT gid, round(side * side, 6) AS area FROM poly", "poly"))(lambda s, d: fx.poly(s, d).select("gid", r6(G.ring_area(G.convex_hull(F.flatten("rings")))).alias("area")))


def _sql_series(coefficients, of_xi: str, of_eta: str) -> str:
    return " + ".join(f"{c!r} * {of_xi}({2 * j} * xi) * {of_eta}({2 * j} * eta)" for j, c in enumerate(coefficients, 1))


def _sql_to_utm(name: str, source: str, lon0: float) -> list[str]:
    """CTEs: longitude and latitude of ``source`` to a southern UTM zone by the Krueger series."""
    e = math.sqrt(G.E2)
    east, north = _sql_series(G.ALPHA, "cos", "sinh"), _sql_series(G.ALPHA, "sin", "cosh")
    return [
        f"{name}_t AS (SELECT pid, radians(x - {lon0!r}) AS lam, sinh(atanh(sin(radians(y))) - {e!r} * atanh({e!r} * sin(radians(y)))) AS t FROM {source})",
        f"{name}_e AS (SELECT pid, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(t * t + 1e0)) AS eta FROM {name}_t)",
        f"{name} AS (SELECT pid, {G.RADIUS!r} * (eta + {east}) + 500000e0 AS x, {G.RADIUS!r} * (xi + {north}) + 10000000e0 AS y FROM {name}_e)",
    ]


def _sql_from_utm(name: str, source: str, lon0: float) -> list[str]:
    """CTEs: the inverse of ``_sql_to_utm``."""
    xi, eta = _sql_series(G.BETA, "sin", "cosh"), _sql_series(G.BETA, "cos", "sinh")
    lat = " + ".join(f"{c!r} * sin({2 * j} * chi)" for j, c in enumerate(G.DELTA, 1))
    return [
        f"{name}_e AS (SELECT pid, (y - 10000000e0) / {G.RADIUS!r} AS xi, (x - 500000e0) / {G.RADIUS!r} AS eta FROM {source})",
        f"{name}_s AS (SELECT pid, xi - ({xi}) AS xi, eta - ({eta}) AS eta FROM {name}_e)",
        f"{name}_c AS (SELECT pid, asin(sin(xi) / cosh(eta)) AS chi, degrees(atan2(sinh(eta), cos(xi))) + {lon0!r} AS x FROM {name}_s)",
        f"{name} AS (SELECT pid, x, degrees(chi + {lat}) AS y FROM {name}_c)",
    ]


_LL = "ll AS (SELECT pid, -36e0 + x / 100e0 AS x, -8e0 + y / 100e0 AS y FROM pts)"
_UTM = (*_sql_to_utm("u1", "ll", -33.0), *_sql_from_utm("l2", "u1", -33.0), *_sql_to_utm("u2", "l2", -33.0))
query("g13_reproject", sql("SELECT pid, round(x, 3) AS x, round(y, 3) AS y FROM u2", "pts", _LL, *_UTM))(
    lambda s, d: G.reproject(G.reproject(fx.pts(s, d).select("pid", (F.lit(-36.0) + F.col("x") / 100.0).alias("x"), (F.lit(-8.0) + F.col("y") / 100.0).alias("y")), 4326, 31985), 31985, 32725).select(
        "pid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")
    )
)

@query("g12_inversion_swap", sql("SELECT id, round(CASE WHEN (SELECT avg(p_tree) FROM onpx JOIN prob ON prow = pr AND pcol = pc WHERE label = 1) < 0.5e0 THEN p_soil ELSE p_tree END, 6) AS p FROM prob", "train", "grd", "prob", _AT))
def _(s, d):
    from ..operators.segment import swap_if_inverted

    return swap_if_inverted(fx.prob(s, d), fx.train(s, d).where("label = 1"), _meta(s, d)).select("id", r6("p_tree").alias("p"))
