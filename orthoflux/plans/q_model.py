"""Queries of interpolation, classification, segmentation and the end-to-end runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geom as G
from ..operators import interp as I
from ..operators import ml as L
from ..operators import segment as S
from ..operators import vectorize as VZ
from ..operators.masks import valid_alpha
from ..runlog import RunLog
from ..scratch import materialize, scratch
from ..sources.vector import read_shapefile, write_training_buffers
from . import fixtures as fx
from . import pipelines as P
from .fixtures import sql
from .q_spatial import CELLS, NEAR, _DIM, _bin, _gauss, _meta, cells
from .registry import query, r6


def _idw(k, extra=""):
    return f"iw AS (SELECT qid, coalesce(max(CASE WHEN d2 = 0 AND rank = 1 THEN z END), sum(1e0 / (pow(sqrt(d2), 2e0) + 1e-12) * z) / sum(1e0 / (pow(sqrt(d2), 2e0) + 1e-12))) AS v FROM nn WHERE rank <= {k} GROUP BY qid{extra})"


for _k, _name in ((16, "i1_idw"), (24, "i2_idw24"), (10, "i3_idw10")):
    query(_name, sql("SELECT qid, round(v, 6) AS value FROM iw", "pts", CELLS, NEAR, _idw(_k)))(lambda s, d, k=_k: I.idw(cells(s), fx.pts(s, d), k).select("qid", r6("value").alias("value")))
query("i9_nearest", sql("SELECT qid, z AS value FROM nn WHERE rank = 1", "pts", CELLS, NEAR))(lambda s, d: I.nearest_value(cells(s), fx.pts(s, d)))
_T15 = "tp AS (SELECT i, w / sum(w) OVER () AS w FROM (SELECT i, exp(-(i * i) / 4.5e0) AS w FROM (SELECT unnest(range(-6, 7)) AS i)))"
_GR = "rs AS (SELECT qid AS id, qid // 20 AS prow, qid % 20 AS pcol, v AS f, 1e0 AS w FROM iw)"
query("i14_interpolate_idw_smoothed", sql("SELECT a.prow, a.pcol, round(f / w, 6) AS value FROM gf a JOIN gw b ON a.id = b.id", "pts", CELLS, NEAR, _idw(24), _GR, _T15, _DIM.replace("px", "rs"), *_gauss("rs", "f", "gf"), *_gauss("rs", "w", "gw")))(
    lambda s, d: I.interpolate(fx.pts(s, d), I.InterpolationConfig(method="idw", resolution=10.0, idw_k_neighbors=24, idw_smooth_sigma=1.5, outlier_method="none"), (0.0, 0.0, 200.0, 210.0)).select("prow", "pcol", r6("value").alias("value"))
)
query("i13_bounds_stats", sql("SELECT count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM iw", "pts", CELLS, NEAR, _idw(16)))(
    lambda s, d: I.interpolate(fx.pts(s, d), I.InterpolationConfig(method="idw", resolution=10.0, idw_smooth_sigma=0.0, outlier_method="none"), (0.0, 0.0, 200.0, 210.0)).agg(F.count("value").alias("n"), r6(F.min("value")).alias("lo"), r6(F.max("value")).alias("hi"))
)


def _holes(s, d):
    return I.nearest_value(cells(s), fx.pts(s, d)).select("qid", F.floor(F.col("qid") / 20).alias("prow"), (F.col("qid") % 20).alias("pcol"), F.when(F.col("qid") % 3 > 0, F.col("value")).alias("value"))


query("n15_nearest_fill", sql("SELECT t.qid, coalesce(t.v, (SELECT u.v FROM t u WHERE u.v IS NOT NULL ORDER BY (u.pr - t.pr) * (u.pr - t.pr) + (u.pc - t.pc) * (u.pc - t.pc), u.qid LIMIT 1)) AS value FROM t", "pts", CELLS, NEAR, "t AS (SELECT qid, qid // 20 AS pr, qid % 20 AS pc, CASE WHEN qid % 3 > 0 THEN z END AS v FROM nn WHERE rank = 1)"))(
    lambda s, d: I.fill_nodata(_holes(s, d), "nearest").select("qid", "value")
)


def _surface(s):
    """The analytic surface that every method is measured on: 1,000 pseudo-random points in 1000 x 1000."""
    k = F.col("id")
    x, y = (k * 7919 % 100003) / 100.003, (k * 104729 % 99991) / 99.991
    return s.range(1000).select(k.alias("pid"), x.alias("x"), y.alias("y"), (F.sin(x / 200.0) * F.cos(y / 200.0) * 100.0).alias("z"))


for _m, _name in (("kriging_ordinary", "i4_kriging"), ("kriging_universal", "i5_kriging_universal"), ("rbf", "i7_rbf"), ("linear", "i8_linear"), ("spline", "i10_spline")):
    query(_name)(lambda s, d, m=_m: I.interpolate(_surface(s), I.InterpolationConfig(method=m, resolution=50.0, outlier_method="none"), (0.0, 0.0, 1000.0, 1000.0)))
# the same methods over the whole customer table
for _m, _name in (("kriging_ordinary", "i4_kriging_points"), ("kriging_universal", "i5_kriging_universal_points"), ("rbf", "i7_rbf_points"), ("linear", "i8_linear_points"), ("spline", "i10_spline_points")):
    query(_name)(lambda s, d, m=_m: I.interpolate(fx.pts(s, d), I.InterpolationConfig(method=m, resolution=10.0, outlier_method="none"), (0.0, 0.0, 200.0, 210.0)))
_PAIRS = "pairs AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, (a.z - b.z) * (a.z - b.z) / 2e0 AS g FROM pts a JOIN pts b ON a.pid < b.pid)"
_LAGS = "lags AS (SELECT least(19, CAST(floor((h - lo) * 20 / (hi - lo)) AS INTEGER)) AS lag, h, g FROM pairs, (SELECT min(h) AS lo, max(h) AS hi FROM pairs))"
query("i6_kriging_lags", sql("SELECT lag, count(*) AS n, round(avg(h), 6) AS h, round(avg(g), 2) AS gamma FROM lags GROUP BY lag", "pts", _PAIRS, _LAGS))(
    lambda s, d: I.empirical_variogram(fx.pts(s, d), 20).select("lag", "n", r6("h").alias("h"), F.round("gamma", 2).alias("gamma"))
)
query("i6_kriging_t17")(lambda s, d: I.interpolate(fx.pts(s, d), I.InterpolationConfig(method="kriging_ordinary", resolution=10.0, outlier_method="none", kriging_max_points=50_000), (0.0, 0.0, 200.0, 210.0)))


def _features(s, d, full):
    return L.pixel_features(fx.px(s, d), 2.0, full)


query("p20_l6_features", sql("SELECT pid, count(*) AS n, round(avg(r), 6) AS mean_r FROM (SELECT pid, CAST(floor((f - y) / 2e0) AS BIGINT) AS pr, CAST(floor(x / 2e0) AS BIGINT) AS pc FROM train, grd WHERE x >= 0 AND x < 250 AND y <= f AND y > 0) JOIN px ON prow BETWEEN pr - 1 AND pr AND pcol BETWEEN pc - 1 AND pc GROUP BY pid", "train", "grd", "px"))(
    lambda s, d: L.training_features(fx.train(s, d), _features(s, d, False), _meta(s, d), 0.85).groupBy("pid").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("R")).alias("mean_r"))
)


def _model(s, d, full=False):
    """A forest of the operator's size, fitted on the patches around the training points; pixels are labelled by their greenness."""
    names = L.FEATURES14 if full else L.FEATURES7
    rows = materialize(_features(s, d, full).withColumn("label", F.when(F.col("ExG") > 0.05, 1).otherwise(0)), "features")
    near = L.training_features(fx.train(s, d).select("x", "y"), rows, _meta(s, d), 2.0).dropDuplicates(["id"])
    return L.fit_forest(near, names), rows, names


@query("l1_l2_l3_forest")
def _(s, d):
    model, rows, names = _model(s, d)
    return L.predict(model, rows, names).select("id", "p0", "p1", "prediction", "label")


@query("l4_o1_importances")
def _(s, d):
    model, rows, names = _model(s, d, True)
    return L.importances(model, names, rows)


def _flood_input(s, d):
    marker = F.when((F.col("prow") % 9 == 4) & (F.col("pcol") % 9 == 4), F.col("id") + 1).otherwise(0)
    return fx.prob(s, d).select("prow", "pcol", F.least("p_tree", "p_soil").alias("cost"), marker.alias("marker"), F.lit(True).alias("mask"))


query("g11_watershed_image")(lambda s, d: S.watershed_image(_flood_input(s, d).withColumn("image", F.lit(0).cast("long"))))
query("g11_watershed")(lambda s, d: S.watershed(_flood_input(s, d)))
query("g8_contours")(lambda s, d: VZ.contours(_bin(s, d), tile=64))
query("g10_polygons")(lambda s, d: VZ.polygons(_bin(s, d), _meta(s, d), tile=64).select("component", F.size("rings").alias("n_rings"), "area"))
_TERRAIN = P.TerrainConfig(buffer_m=2.0, confidence=0.5, min_group_px=2, terrain=I.InterpolationConfig(method="idw", resolution=20.0, idw_k_neighbors=8))
query("pipeline_a_terrain")(lambda s, d: P.terrain_run(fx.px(s, d), fx.train(s, d), _meta(s, d), _TERRAIN)["terrain"])


@query("k8_training_buffers", sql("SELECT class, count(*) AS n, round(count(*) * 32e0 * sin(pi() / 32e0) * 0.7225e0, 3) AS area FROM train GROUP BY class", "train"))
def _(s, d):
    """Buffers written as Shapefiles, a folder a class, and read back."""
    folder, found = scratch(s, "buffers"), []
    write_training_buffers(fx.train(s, d), folder, 0.85, ("forest", "soil")).agg(F.sum("n")).collect()
    for c in ("forest", "soil"):
        back = read_shapefile(s, f"{folder}/val_buffer_{c}/*.shp")
        found.append(back.agg(F.lit(c).alias("class"), F.count(F.lit(1)).alias("n"), F.round(F.sum(G.polygon_area(F.col("rings"))), 3).alias("area")))
    return found[0].unionByName(found[1])


@query("k9_a19_run_log", sql("SELECT 'all pixels' AS step, count(*) AS rows FROM px UNION ALL SELECT 'usable pixels', count(*) FROM px WHERE a >= 250", "px"))
def _(s, d):
    """Rows of two steps as the run log saw them; times and throughput differ from run to run and are left out."""
    log = RunLog()
    with log.step("all pixels") as step:
        px = step.wrote(materialize(fx.px(s, d), "px"))
    with log.step("usable pixels") as step:
        step.wrote(materialize(px.where(valid_alpha()), "usable"))
    return log.table(s).select("step", "rows")


query("pipeline_c_crowns")(lambda s, d: P.crowns_run(fx.prob(s, d), fx.train(s, d).where("label = 1"), fx.train(s, d).where("label = 0"), _meta(s, d))["polygons"])
