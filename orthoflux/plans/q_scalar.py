"""Queries of the scalar expressions, filters, samples and statistics."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import indices as X
from ..operators import masks as M
from ..operators import sampling as S
from ..operators import stats as A
from . import fixtures as fx
from .fixtures import sql
from .registry import query, r6

EXG = "2e0 * gn - rn - bn"
EXR = "1.4e0 * rn - gn"
DEG = """CASE WHEN mx = mn THEN 0e0 WHEN mx = r THEN (CAST(g AS DOUBLE) - b) * 60e0 / (mx - mn) WHEN mx = g THEN (CAST(b AS DOUBLE) - r) * 60e0 / (mx - mn) + 120e0 ELSE (CAST(r AS DOUBLE) - g) * 60e0 / (mx - mn) + 240e0 END"""
HSV = f"""mm AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM px),
 hd AS (SELECT *, {DEG} AS deg FROM mm),
 hsv AS (SELECT id, prow, pcol, CAST(round(CASE WHEN deg < 0 THEN deg + 360e0 ELSE deg END / 2e0) AS INTEGER) % 180 AS h,
  CAST(CASE WHEN mx = 0 THEN 0e0 ELSE round((mx - mn) * 255e0 / mx) END AS INTEGER) AS s, mx AS v FROM hd)"""


@query("x0_masked_exg_stats", sql(f"SELECT CASE WHEN {EXG} > 0.05e0 THEN 'plant' ELSE 'other' END AS class, count(*) AS n, round(avg({EXG}), 6) + 0e0 AS mean_exg FROM norm WHERE a >= 250 GROUP BY 1", "norm"))
def _(s, d):
    v = fx.px(s, d).where(M.valid_alpha()).select(X.exg().alias("exg"))
    return v.groupBy(F.when(F.col("exg") > 0.05, "plant").otherwise("other").alias("class")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("exg")).alias("mean_exg"))


def _px_query(name, exprs, body, *ctes):
    """A query of per-pixel expressions: id and the named columns."""
    query(name, sql(body, *ctes))(lambda s, d: fx.px(s, d).select("id", *[v().alias(k) for k, v in exprs.items()]))


_px_query("p1_chromatic", {k: (lambda i=i: r6(X.chromatic()[i])) for i, k in enumerate(("rn", "gn", "bn"))}, "SELECT id, round(rn, 6) AS rn, round(gn, 6) AS gn, round(bn, 6) AS bn FROM norm", "norm")
_px_query("p2_exg", {"exg": lambda: r6(X.exg())}, f"SELECT id, round({EXG}, 6) + 0e0 AS exg FROM norm", "norm")
_px_query("p3_exr", {"exr": lambda: r6(X.exr())}, f"SELECT id, round({EXR}, 6) + 0e0 AS exr FROM norm", "norm")
_px_query("p4_exb", {"exb": lambda: r6(X.exb())}, "SELECT id, round(1.4e0 * bn - gn, 6) + 0e0 AS exb FROM norm", "norm")
_px_query("p5_exgr", {"exgr": lambda: r6(X.exgr())}, f"SELECT id, round(({EXG}) - ({EXR}), 6) + 0e0 AS exgr FROM norm", "norm")
_px_query("p6_exg255", {"exg": lambda: r6(X.exg255())}, "SELECT id, round(2e0 * g / 255e0 - r / 255e0 - b / 255e0, 6) + 0e0 AS exg FROM px", "px")
_px_query("p8_hsv", {k: (lambda i=i: X.hsv8()[i]) for i, k in enumerate(("h", "s", "v"))}, "SELECT id, h, s, v FROM hsv", "px", HSV)
_px_query("p9_gray", {"gray": lambda: X.gray()}, "SELECT id, CAST(round(r * 0.299e0 + g * 0.587e0 + b * 0.114e0) AS INTEGER) AS gray FROM px", "px")
_px_query("p10_band_order", {"c0": lambda: F.col("b"), "c1": lambda: F.col("g"), "c2": lambda: F.col("r")}, "SELECT id, b AS c0, g AS c1, r AS c2 FROM px", "px")
_px_query("p11_clip8", {"v": lambda: X.clip8(F.col("r") * 2 - 100)}, "SELECT id, greatest(0, least(255, r * 2 - 100)) AS v FROM px", "px")
_px_query("p12_ndvi_proxy", {"v": lambda: r6(X.ndvi_proxy("r", "b"))}, "SELECT id, round((CAST(b AS DOUBLE) - r) / (CAST(b AS DOUBLE) + r + 1e0), 6) + 0e0 AS v FROM px", "px")
_px_query("p16_p33_band_select", {"r": lambda: F.col("r"), "g": lambda: F.col("g"), "b": lambda: F.col("b")}, "SELECT id, r, g, b FROM px", "px")
_px_query("p17_cost_index", {"cost": lambda: r6(X.cost_index(X.exg()))}, f"SELECT id, round(-({EXG}), 6) + 0e0 AS cost FROM norm", "norm")
_px_query("p24_las_scaled", {"x": lambda: r6(X.las_scaled(F.col("id"), 0.01, 500.0))}, "SELECT id, round(id * 0.01e0 + 500e0, 6) AS x FROM px", "px")
_px_query("p25_las_quantised", {"z": lambda: r6(X.las_quantised(F.col("mds"), 0.01, 10.0))}, "SELECT id, round(round((mds - 10e0) / 0.01e0) * 0.01e0 + 10e0, 6) AS z FROM px", "px")
_px_query("p26_constant_z", {"z": lambda: F.lit(0.0)}, "SELECT id, 0e0 AS z FROM px", "px")
_px_query("p27_idw_weight", {"w": lambda: r6(X.idw_weight(F.col("mds")))}, "SELECT id, round(1e0 / (pow(sqrt(mds), 2e0) + 1e-12), 6) AS w FROM px", "px")
_px_query("p28_units", {"m2": lambda: r6(X.px_to_m2(F.col("r"), 0.5)), "ha": lambda: r6(X.m2_to_ha(X.px_to_m2(F.col("r"), 0.5)))}, "SELECT id, round(r * 0.25e0, 6) AS m2, round(r * 0.25e0 / 10000e0, 6) AS ha FROM px", "px")
_px_query("p29_nodata", {"z": lambda: M.nodata_to_null("mds", 100.0)}, "SELECT id, CASE WHEN mds <> 100e0 THEN mds END AS z FROM px", "px")
_px_query("s4_gray_to_rgb", {"r": lambda: F.col("r"), "g": lambda: F.coalesce(F.lit(None).cast("int"), "r"), "b": lambda: F.coalesce(F.lit(None).cast("int"), "r")}, "SELECT id, r, r AS g, r AS b FROM px", "px")
_px_query("f7_threshold", {"bw": lambda: F.when(F.col("g") > 70, 255).otherwise(0)}, "SELECT id, CASE WHEN g > 70 THEN 255 ELSE 0 END AS bw FROM px", "px")
_px_query("f25_label_split", {"side": lambda: F.when(F.col("r") < 100, "tree").otherwise("soil")}, "SELECT id, CASE WHEN r < 100 THEN 'tree' ELSE 'soil' END AS side FROM px", "px")
_px_query("u3_mask_logic", {"m": lambda: (F.col("a") >= 250) & ((F.col("r") < 60) | (F.col("g") < 60))}, "SELECT id, a >= 250 AND (r < 60 OR g < 60) AS m FROM px", "px")


@query("p7_exg_8bit", sql("SELECT id, CAST(CASE WHEN hi > lo THEN round((v - lo) * 255e0 / (hi - lo)) ELSE 0e0 END AS INTEGER) AS exg8 FROM e, m", "px", "e AS (SELECT id, 2e0 * g / 255e0 - r / 255e0 - b / 255e0 AS v FROM px)", "m AS (SELECT min(v) AS lo, max(v) AS hi FROM e)"))
def _(s, d):
    v = fx.px(s, d).select("id", X.exg255().alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).select("id", X.to_8bit(F.col("v"), F.col("lo"), F.col("hi")).alias("exg8"))


@query("p14_pixel_to_world", sql("SELECT id, round((pcol + 0.5e0) * 2e0, 6) AS x, round(f + (prow + 0.5e0) * -2e0, 6) AS y FROM px, grd", "px", "grd"))
def _(s, d):
    x, y = fx.meta(fx.rows_of(s, d)).pixel_to_world(F.col("prow"), F.col("pcol"))
    return fx.px(s, d).select("id", r6(x).alias("x"), r6(y).alias("y"))


@query("p15_world_to_pixel", sql("SELECT pid, CAST(floor((f - y) / 2e0) AS BIGINT) AS prow, CAST(floor(x / 2e0) AS BIGINT) AS pcol FROM pts, grd", "pts", "grd"))
def _(s, d):
    row, col = fx.meta(fx.rows_of(s, d)).world_to_pixel(F.col("x"), F.col("y"))
    return fx.pts(s, d).select("pid", row.alias("prow"), col.alias("pcol"))


def _prob_query(name, cols, body, *ctes):
    query(name, sql(body, *ctes))(lambda s, d: fx.prob(s, d).select("id", *[v().alias(k) for k, v in cols.items()]))


_prob_query("p18_cost_two_class", {"cost": lambda: r6(X.cost_two_class(F.col("p_tree"), F.col("p_soil")))}, "SELECT id, round(least(1e0 - p_tree, 1e0 - p_soil), 6) + 0e0 AS cost FROM prob", "prob")
_prob_query("p19_cost_one_class", {"cost": lambda: r6(X.cost_one_class(F.col("p_tree")))}, "SELECT id, round(1e0 - abs(p_tree), 6) + 0e0 AS cost FROM prob", "prob")
_prob_query("p30_probability_sum", {"total": lambda: r6(F.col("p_tree") + F.col("p_soil"))}, "SELECT id, round(p_tree + p_soil, 6) AS total FROM prob", "prob")


@query("p21_class_label", sql("SELECT pid, t.class, cls.label FROM train t JOIN cls ON t.class = cls.class", "train", "cls"))
def _(s, d):
    return fx.train(s, d).drop("label").join(F.broadcast(fx.classes(s).select("class", "label")), "class").select("pid", "class", "label")


@query("p22_class_probability", sql("SELECT id, CASE WHEN id % 2 = 1 THEN p_tree ELSE p_soil END AS p FROM prob", "prob"))
def _(s, d):
    probs = F.array("p_soil", "p_tree")  # in the order of the model's classes 0, 1
    return fx.prob(s, d).select("id", F.element_at(probs, (F.col("id") % 2 + 1).cast("int")).alias("p"))


@query("p23_circularity", sql("SELECT gid, round(4e0 * pi() * (side * side) / ((4e0 * side) * (4e0 * side)), 6) AS circ FROM poly", "poly"))
def _(s, d):
    side = F.col("side")
    return fx.poly(s, d).select("gid", r6(X.circularity(side * side, side * 4.0)).alias("circ"))


@query("p31_adaptive_thresholds", sql("SELECT CAST(trunc(q75 * 0.8e0) AS INTEGER) AS t_scaled, greatest(30, least(200, CAST(trunc(q50 / 255e0 * 255e0 * 0.85e0) AS INTEGER))) AS t_clamped FROM (SELECT median(a) AS q75, median(b) AS q50 FROM (SELECT quantile_cont(CAST(g AS DOUBLE), 0.75) AS a, quantile_cont(CAST(g AS DOUBLE), 0.5) AS b FROM px GROUP BY prow))", "px"))
def _(s, d):
    v = fx.px(s, d).withColumn("v", F.col("g").cast("double"))
    q75 = A.median_of_groups(v, "prow", "v", 0.75).select(F.col("median_q").alias("q75"))
    q50 = A.median_of_groups(v, "prow", "v", 0.5).select(F.col("median_q").alias("q50"))
    return q75.crossJoin(F.broadcast(q50)).select(X.adaptive_threshold_scaled(F.col("q75")).alias("t_scaled"), X.adaptive_threshold_clamped(F.col("q50") / 255.0).alias("t_clamped"))


@query("p32_a7_hsv_ranges", sql("SELECT greatest(0, CAST(trunc(quantile_cont(CAST(h AS DOUBLE), 0.05) - 10e0) AS INTEGER)) AS h_lo, least(179, CAST(trunc(quantile_cont(CAST(h AS DOUBLE), 0.95) + 10e0) AS INTEGER)) AS h_hi, greatest(0, CAST(trunc(quantile_cont(CAST(s AS DOUBLE), 0.1) - 20e0) AS INTEGER)) AS s_lo, least(255, CAST(trunc(quantile_cont(CAST(s AS DOUBLE), 0.9) + 20e0) AS INTEGER)) AS s_hi FROM hsv", "px", HSV))
def _(s, d):
    h, sat, _v = X.hsv8()
    q = fx.px(s, d).select(h.cast("double").alias("h"), sat.cast("double").alias("s")).agg(*[F.percentile(c, F.lit(p)).alias(n) for n, c, p in (("h5", "h", 0.05), ("h95", "h", 0.95), ("s10", "s", 0.1), ("s90", "s", 0.9))])
    (hl, hh), (sl, sh) = X.hsv_range(F.col("h5"), F.col("h95"), 10, 179), X.hsv_range(F.col("s10"), F.col("s90"), 20, 255)
    return q.select(hl.alias("h_lo"), hh.alias("h_hi"), sl.alias("s_lo"), sh.alias("s_hi"))


def _px_filter(name, cond, where, *ctes):
    query(name, sql(f"SELECT id FROM {ctes[-1].split(' ')[0] if ctes else 'px'} WHERE {where}", *(ctes or ("px",))))(lambda s, d: fx.px(s, d).where(cond()).select("id"))


_px_filter("f1_alpha_mask", M.valid_alpha, "a >= 250")
_px_filter("f2_nodata_mask", lambda: M.valid_mask(["r", "g", "b"], nodata=0), "r <> 0 AND g <> 0 AND b <> 0")
_px_filter("f6_exg_mask", lambda: X.exg() > 0.05, f"{EXG} > 0.05e0", "norm")
_px_filter("f11_valid_values", lambda: M.usable("mds"), "mds IS NOT NULL")
_px_filter("f24_positive", lambda: F.col("g") > 0, "g > 0")
query("f8_hsv_in_range", sql("SELECT id FROM hsv WHERE h BETWEEN 35 AND 85 AND s BETWEEN 50 AND 255 AND v BETWEEN 40 AND 255", "px", HSV))(
    lambda s, d: fx.px(s, d).select("id", *[c.alias(n) for n, c in zip("hsv", X.hsv8(), strict=True)]).where(M.in_range({"h": (35, 85), "s": (50, 255), "v": (40, 255)})).select("id")
)
query("f9_watershed_mask", sql("SELECT id FROM prob WHERE p_tree > 0.3e0 OR p_soil > 0.3e0", "prob"))(lambda s, d: fx.prob(s, d).where("p_tree > 0.3D OR p_soil > 0.3D").select("id"))


@query("f4_j6_low_probability", sql("SELECT id, cls.class, CASE cls.class WHEN 'forest' THEN p_tree ELSE p_soil END AS p FROM prob JOIN cls ON confidence IS NOT NULL WHERE a >= 250 AND CASE cls.class WHEN 'forest' THEN p_tree ELSE p_soil END < confidence", "prob", "cls"))
def _(s, d):
    return M.by_confidence(fx.prob(s, d), fx.classes(s), {"forest": "p_tree", "soil": "p_soil"}, M.valid_alpha()).select("id", "class", "p")


@query("f5_confidence_with_suffix", sql("SELECT id, p_soil AS p FROM prob WHERE a >= 250 AND p_soil >= 0.25e0", "prob"))
def _(s, d):
    return M.by_confidence(fx.prob(s, d), fx.classes(s), {"forest": "p_tree", "soil": "p_soil"}, M.valid_alpha(), direction="above", need_suffix=True).select("id", "p")


@query("f10_a9_in_bounds", sql("SELECT count(*) FILTER (WHERE x >= 0 AND x < 250 AND y <= f AND y > 0) AS n_valid, count(*) FILTER (WHERE NOT (x >= 0 AND x < 250 AND y <= f AND y > 0)) AS n_outside FROM pts, grd", "pts", "grd"))
def _(s, d):
    g = fx.meta(fx.rows_of(s, d))
    row, col = g.world_to_pixel(F.col("x"), F.col("y"))
    ok = g.inside(row, col)
    return fx.pts(s, d).agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_outside"))


query("f12_points_only", sql("SELECT pid FROM pts WHERE CASE WHEN pid % 7 = 0 THEN 'MultiPoint' ELSE 'Point' END = 'Point'", "pts"))(lambda s, d: fx.pts(s, d).withColumn("kind", F.when(F.col("pid") % 7 == 0, "MultiPoint").otherwise("Point")).where("kind = 'Point'").select("pid"))
query("f13_las_classes", sql("SELECT id, CAST(r % 12 AS INTEGER) AS classification FROM px WHERE r % 12 IN (2, 9)", "px"))(lambda s, d: fx.px(s, d).select("id", (F.col("r") % 12).cast("int").alias("classification")).where(F.col("classification").isin(2, 9)))
_Z = "z AS (SELECT avg({v}) AS m, stddev_pop({v}) AS sd FROM {t})"
query("f14_zscore", sql("SELECT pid FROM pts, z WHERE abs(pts.z - m) / CASE WHEN sd = 0 THEN 1e0 ELSE sd END <= 1e0", "pts", _Z.format(v="z", t="pts")))(lambda s, d: M.drop_zscore_outliers(fx.pts(s, d), "z", 1.0).select("pid"))
query("f15_zscore_strict", sql("SELECT id FROM px, z WHERE abs(mds - m) / CASE WHEN sd = 0 THEN 1e0 ELSE sd END < 1.5e0", "px", _Z.format(v="mds", t="px")))(lambda s, d: M.drop_zscore_outliers(fx.px(s, d), "mds", 1.5, strict=True).select("id"))
query("f16_iqr", sql("SELECT id FROM px, q WHERE mds >= q1 - (q3 - q1) * 0.1e0 AND mds <= q3 + (q3 - q1) * 0.1e0", "px", "q AS (SELECT quantile_cont(mds, 0.25) AS q1, quantile_cont(mds, 0.75) AS q3 FROM px)"))(lambda s, d: M.drop_iqr_outliers(fx.px(s, d), "mds", 0.1).select("id"))
query("f17_contour_filter", sql("SELECT gid FROM poly WHERE side * side > 100e0 AND side * side < 800e0 AND 4e0 * pi() * (side * side) / ((4e0 * side) * (4e0 * side)) > 0.4e0", "poly"))(
    lambda s, d: fx.poly(s, d).withColumn("area", F.col("side") * F.col("side")).where((F.col("area") > 100) & (F.col("area") < 800) & (X.circularity(F.col("area"), F.col("side") * 4.0) > 0.4)).select("gid")
)
query("f18_f19_min_area", sql("SELECT gid FROM poly WHERE side * side >= 10e0 AND 4e0 * side <> 0 AND gid <> 0", "poly"))(lambda s, d: fx.poly(s, d).where("side * side >= 10 AND 4 * side <> 0 AND gid <> 0").select("gid"))
query("f20_group_min", sql("SELECT prow, count(*) AS n FROM px WHERE r < 60 GROUP BY prow HAVING count(*) >= 20", "px"))(lambda s, d: fx.px(s, d).where("r < 60").groupBy("prow").agg(F.count(F.lit(1)).alias("n")).where("n >= 20"))
query("f21_area_limits", sql("SELECT gid FROM poly WHERE side * side > 0 AND side * side <= 312.5e0", "poly"))(lambda s, d: fx.poly(s, d).where("side * side > 0 AND side * side <= 312.5D").select("gid"))
query("f23_calibration_sample", sql(f"SELECT prow, count(*) AS n, round(median({EXG}), 6) + 0e0 AS med FROM norm WHERE {EXG} > 0.05e0 GROUP BY prow HAVING count(*) > 2", "norm"))(
    lambda s, d: fx.px(s, d).select("prow", X.exg().alias("v")).where(M.usable("v") & (F.col("v") > 0.05)).groupBy("prow").agg(F.count(F.lit(1)).alias("n"), r6(F.median("v")).alias("med")).where("n > 2")
)

query("o4_sample_n", sql("SELECT pid FROM pts ORDER BY md5('42:' || pid), pid LIMIT 100", "pts"))(lambda s, d: S.sample_n(fx.pts(s, d), "pid", 100).select("pid"))
query("o5_cap_per_group", sql("SELECT pid, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('0:' || pid), pid) AS rn FROM train) WHERE rn <= 40", "train"))(lambda s, d: S.cap_per_group(fx.train(s, d), "class", "pid", 40).select("pid", "class"))
query("o6_subsample_cap", sql("SELECT id FROM px ORDER BY md5('42:' || id), id LIMIT 500", "px"))(lambda s, d: S.sample_n(fx.px(s, d), "id", 500).select("id"))
query("s6_load_points_capped", sql("SELECT pid, x, y FROM pts ORDER BY pid LIMIT 50", "pts"))(lambda s, d: S.first_n(fx.pts(s, d), "pid", 50).select("pid", "x", "y"))
query("o7_split", sql("SELECT pid, CASE WHEN row_number() OVER (ORDER BY md5('42:' || pid)) <= ceil(0.2e0 * (SELECT count(*) FROM pts)) THEN 'test' ELSE 'train' END AS split FROM pts", "pts"))(lambda s, d: S.split(fx.pts(s, d), "pid").select("pid", "split"))
query("o3_first_class", sql("SELECT class, label FROM cls WHERE las_suffix IS NOT NULL ORDER BY label LIMIT 1", "cls"))(lambda s, d: fx.classes(s).where("las_suffix IS NOT NULL").orderBy("label").limit(1).select("class", "label"))
query("u1_concat_classes", sql("SELECT pid, label FROM train WHERE label = 1 UNION ALL SELECT pid, label FROM train WHERE label = 0", "train"))(lambda s, d: fx.train(s, d).where("label = 1").select("pid", "label").unionByName(fx.train(s, d).where("label = 0").select("pid", "label")))
query("u2_distinct", sql("SELECT DISTINCT r, g FROM px", "px"))(lambda s, d: fx.px(s, d).select("r", "g").dropDuplicates())

_ST = "round(min({v}), 6) AS min_v, round(max({v}), 6) AS max_v, round(avg({v}), 6) AS mean_v, round(stddev_pop({v}), 6) AS std_v"


def _round_all(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("a1_raster_stats", sql(f"SELECT {_ST.format(v='mds')} FROM px", "px"))(lambda s, d: _round_all(A.raster_stats(fx.px(s, d), "mds")))
query("a2_coverage", sql("SELECT count(*) AS n_cells, count(v) AS n_valid, round(count(v) * 100e0 / count(*), 6) AS pct FROM (SELECT CASE WHEN a >= 250 THEN mds END AS v FROM px)", "px"))(lambda s, d: _round_all(A.coverage(fx.px(s, d).withColumn("v", F.when(M.valid_alpha(), F.col("mds"))), "v")))
query("a3_class_counts", sql("SELECT class, count(*) AS n FROM train GROUP BY class", "train"))(lambda s, d: fx.train(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")))
query("a4_split_distribution", sql("SELECT split, label, count(*) AS n FROM (SELECT label, CASE WHEN row_number() OVER (ORDER BY md5('42:' || pid)) <= ceil(0.2e0 * (SELECT count(*) FROM train)) THEN 'test' ELSE 'train' END AS split FROM train) GROUP BY 1, 2", "train"))(lambda s, d: S.split(fx.train(s, d), "pid").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))
query("a5_share", sql("SELECT round(avg(CASE WHEN p_tree > 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM prob", "prob"))(lambda s, d: _round_all(A.share(fx.prob(s, d), F.col("p_tree") > 0.5)))
query("a6_median_of_medians", sql("SELECT round(median(q), 6) AS median_q FROM (SELECT quantile_cont(mds, 0.75) AS q FROM px GROUP BY prow)", "px"))(lambda s, d: _round_all(A.median_of_groups(fx.px(s, d), "prow", "mds", 0.75)))
query("a7_percentiles", sql("SELECT round(quantile_cont(mds, 0.05), 6) AS p5, round(quantile_cont(mds, 0.1), 6) AS p10, round(quantile_cont(mds, 0.9), 6) AS p90, round(quantile_cont(mds, 0.95), 6) AS p95 FROM px", "px"))(lambda s, d: _round_all(A.percentiles(fx.px(s, d), "mds", (0.05, 0.1, 0.9, 0.95))))
query("a8_extent", sql('SELECT min(x) AS "left", min(y) AS bottom, max(x) AS "right", max(y) AS top FROM pts', "pts"))(lambda s, d: A.extent(fx.pts(s, d)))
query("a12_labels", sql("SELECT count(DISTINCT r) AS n_labels FROM px WHERE r > 0", "px"))(lambda s, d: fx.px(s, d).where("r > 0").agg(F.count_distinct("r").alias("n_labels")))
query("a13_polygon_areas", sql("SELECT round(min(side * side), 6) AS min_a, round(avg(side * side), 6) AS mean_a, round(max(side * side), 6) AS max_a, round(sum(side * side), 6) AS total_a FROM poly", "poly"))(lambda s, d: _round_all(fx.poly(s, d).withColumn("q", F.col("side") * F.col("side")).agg(F.min("q").alias("min_a"), F.avg("q").alias("mean_a"), F.max("q").alias("max_a"), F.sum("q").alias("total_a"))))
query("a14_accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM labels")(lambda s, d: _round_all(A.accuracy(fx.table(s, d, "labels"), "quality", "toxic")))
query(
    "a15_classification_report",
    """WITH c AS (SELECT unnest([0, 1]) AS c), m AS (SELECT c, (SELECT count(*) FROM labels WHERE quality = c) AS support, (SELECT count(*) FROM labels WHERE toxic = c) AS predicted, (SELECT count(*) FROM labels WHERE toxic = c AND quality = c) AS tp FROM c),
 p AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN predicted = 0 THEN 0e0 ELSE tp / CAST(predicted AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0e0 ELSE tp / CAST(support AS DOUBLE) END AS recall, support FROM m),
 f AS (SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END AS f1, support FROM p),
 u AS (SELECT * FROM f UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)
 SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""",
)(lambda s, d: _round_all(A.classification_report(fx.table(s, d, "labels"), "quality", "toxic")))
query("a17_i12_mean_fill", sql("SELECT id, round(coalesce(v, (SELECT avg(v) FROM t)), 6) AS v FROM t", "px", "t AS (SELECT id, CASE WHEN a >= 250 THEN mds END AS v FROM px)"))(lambda s, d: A.fill_mean(fx.px(s, d).select("id", F.when(M.valid_alpha(), F.col("mds")).alias("v")), "v").select("id", r6("v").alias("v")))
