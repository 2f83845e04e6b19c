"""Hand-checked cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflux.functions import indices as X
from orthoflux.grid import GridMeta
from orthoflux.operators import geom as G
from orthoflux.operators import interp as I
from orthoflux.operators import masks as M
from orthoflux.operators import stencil as N
from orthoflux.operators.knn import knn
from orthoflux.operators.sampling import split
from orthoflux.operators.segment import flood
from orthoflux.operators.vectorize import trace_outline, trace_rings


def grid_df(spark, rows):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "prow long, pcol long, v double")


def as_array(df, col):
    p = df.toPandas()
    out = np.zeros((p.prow.max() + 1, p.pcol.max() + 1))
    out[p.prow, p.pcol] = p[col].to_numpy(float)
    return out


def test_exg(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 255, 0)], "r int, g int, b int")
    assert [r.v for r in df.select(X.exg().alias("v")).collect()] == [0.0, 2.0]


def test_mean_corner(spark):
    assert as_array(N.mean3(grid_df(spark, [[1, 2], [3, 4]]), "v", "m"), "m")[0, 0] == pytest.approx(2.0)


def test_sobel_of_constant(spark):
    assert (as_array(N.sobel(grid_df(spark, [[7] * 4] * 4), "v"), "sobel") == 0).all()


def test_gradient_edges(spark):
    assert as_array(N.gradient(grid_df(spark, [[1, 4, 9]]), "v", 1.0), "d_col").tolist() == [[3, 4, 5]]


def test_opening_is_idempotent(spark):
    rng = np.random.default_rng(0)
    once = N.opened(grid_df(spark, rng.integers(0, 2, (12, 12))), "v", "o")
    twice = N.opened(once.select("prow", "pcol", F.col("o").alias("v")), "v", "o")
    assert (as_array(once, "o") == as_array(twice, "o")).all()


def test_bilateral_against_numpy(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 255, (14, 11, 3)).astype(float)
    df = spark.createDataFrame([(r, c, *map(float, img[r, c])) for r in range(14) for c in range(11)], "prow long, pcol long, r double, g double, b double")
    got = N.bilateral(df, tile=6).toPandas()
    pad = np.pad(img, ((4, 4), (4, 4), (0, 0)), mode="reflect")
    for r, c in ((0, 0), (5, 6), (13, 10), (7, 0)):
        num, den = np.zeros(3), 0.0
        for dy in range(-4, 5):
            for dx in range(-4, 5):
                if dy * dy + dx * dx <= 16:
                    near = pad[r + 4 + dy, c + 4 + dx]
                    w = math.exp(-(np.abs(near - img[r, c]).sum() ** 2) / (2 * 75**2) - (dy * dy + dx * dx) / (2 * 75**2))
                    num, den = num + w * near, den + w
        row = got[(got.prow == r) & (got.pcol == c)].iloc[0]
        assert np.allclose([row.r, row.g, row.b], num / den)


def test_split_size(spark):
    df = split(spark.range(1003).withColumnRenamed("id", "k"), "k")
    assert df.where("split = 'test'").count() == math.ceil(0.2 * 1003)


def test_zscore_limit(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "z double")  # both lie one deviation from the mean
    assert M.drop_zscore_outliers(df, "z", 1.0).count() == 2 and M.drop_zscore_outliers(df, "z", 1.0, strict=True).count() == 0


def test_hole_at_threshold(spark):
    square = lambda s: [(0.0, 0.0), (s, 0.0), (s, s), (0.0, s), (0.0, 0.0)]
    df = spark.createDataFrame([(1, [square(10.0), square(2.0), square(1.9)])], f"gid long, rings array<{G.RING}>")
    r = G.clean_polygons(df, 4.0, 1000.0).first()
    assert (r.holes_removed, r.area_m2) == (1, 96.0)


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(-36.5, -8.1), (-35.0, -9.9)], "x double, y double")
    there = G.reproject(df, 4326, 31984)
    back = [tuple(r) for r in G.reproject(there, 31984, 4326).collect()]
    assert np.allclose(sorted(back), [(-36.5, -8.1), (-35.0, -9.9)], atol=1e-9)
    x, y = spark.createDataFrame([(-39.0, -8.0)], "x double, y double").transform(lambda d: G.reproject(d, 4326, 31984)).first()
    assert x == pytest.approx(500000.0, abs=1e-6) and y == pytest.approx(9115677.0, abs=300)


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p, q = rng.random((300, 2)) ** 3 * 100, rng.random((60, 2)) * 140 - 20
    pts = spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(p)], "pid long, x double, y double, z double")
    qs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "qid long, x double, y double")
    got = knn(qs, pts, 5).toPandas()
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    for i in range(60):
        assert got[got.qid == i].sort_values("rank").pid.tolist() == np.argsort(d2[i], kind="stable")[:5].tolist()


def test_idw_bounds_and_hit(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 5.0), (1, 3.0, 4.0, 9.0)], "pid long, x double, y double, z double")
    qs = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], "qid long, x double, y double")
    got = {r.qid: r.value for r in I.idw(qs, pts, 16).collect()}
    assert got[0] == 5.0 and 5.0 < got[1] < 9.0


def test_kriging_is_exact_at_points():
    rng = np.random.default_rng(3)
    x, y, z = rng.random(20), rng.random(20), rng.random(20)
    assert I.krige_weights(x, y, z, x[4], y[4], "spherical", (1.0, 0.5, 0.0)) == pytest.approx(z[4])
    assert I.rbf_value(x, y, z, x[7], y[7], "thin_plate_spline", 0.0, 1.0) == pytest.approx(z[7])


def test_variogram_bins_all_pairs(spark):
    rng = np.random.default_rng(5)
    p = rng.random((2300, 3)) * 100
    i, j = np.triu_indices(len(p), 1)
    h, g = np.hypot(*(p[i] - p[j])[:, :2].T), (p[i, 2] - p[j, 2]) ** 2 / 2
    lag = np.minimum(19, np.floor((h - h.min()) * 20 / (h.max() - h.min())).astype(int))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "pid long, x double, y double, z double")
    got = I.empirical_variogram(df, 20).toPandas().sort_values("lag")
    n = np.bincount(lag)
    assert got.n.sum() == len(h) and (got.n.to_numpy() == n).all()
    assert np.allclose(got.h, np.bincount(lag, h) / n) and np.allclose(got.gamma, np.bincount(lag, g) / n)
    assert I.empirical_variogram(df.limit(0), 20).count() == I.empirical_variogram(df.limit(1), 20).count() == 0


def test_variogram_query_reads_all(spark, sf_dir):
    from orthoflux.plans.catalog import QUERIES

    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert QUERIES["i6_kriging_lags"](spark, sf_dir).agg(F.sum("n")).first()[0] == n * (n - 1) // 2
    assert QUERIES["i6_kriging_t17"](spark, sf_dir).where("value IS NOT NULL").count() == 420


def test_delaunay_square():
    x, y = np.array([0.0, 1, 0, 1]), np.array([0.0, 0, 1, 1])
    assert I.delaunay_value(x, y, x + y, 0.3, 0.4) == pytest.approx(0.7)
    assert math.isnan(I.delaunay_value(x, y, x, 2.0, 2.0))


def _brute_delaunay(p, qx, qy):
    """The value at a cell by trying all triangles."""
    from itertools import combinations

    x, y, z = p[:, 0] - qx, p[:, 1] - qy, p[:, 2]
    i, j, k = np.array(list(combinations(range(len(p)), 3))).T
    w = np.array([x[j] * y[k] - x[k] * y[j], x[k] * y[i] - x[i] * y[k], x[i] * y[j] - x[j] * y[i]])
    area = w.sum(0)
    for t in np.flatnonzero((np.abs(area) > 1e-9) & (w / np.where(area == 0, 1, area) >= 0).all(0)):
        a = np.array([[x[v], y[v], 1.0] for v in (i[t], j[t], k[t])])
        c = np.linalg.solve(a, (a[:, :2] ** 2).sum(1))
        if (x**2 + y**2 - c[0] * x - c[1] * y - c[2] >= -1e-7).all():
            return float((w[:, t] @ z[[i[t], j[t], k[t]]]) / area[t])
    return math.nan


def test_linear_is_delaunay_of_all_points(spark):
    rng = np.random.default_rng(8)
    hot = np.c_[50 + rng.random((40, 2)) * 0.5, rng.random(40)]  # more than 24 points at one place, and a gap around
    p = np.r_[hot, rng.random((30, 3)) * [100, 100, 1], [[0, 0, 1], [100, 0, 2], [0, 100, 3], [100, 100, 4]]]
    same = [(900 + i, 50.25, 50.25, 9.0 + i) for i in range(30)]
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)] + same, "pid long, x double, y double, z double")
    q = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * 110 - 5)]
    got = {r.qid: r.value for r in I.linear(spark.createDataFrame(q, "qid long, x double, y double"), pts).collect()}
    every = np.r_[p, [[50.25, 50.25, 9.0]]]
    for i, x, y in q:
        want = _brute_delaunay(every, x, y)
        assert (got[i] is None) == math.isnan(want) == (not (0 <= x <= 100 and 0 <= y <= 100))
        assert got[i] is None or got[i] == pytest.approx(want, abs=1e-9)
    line = spark.createDataFrame([(i, float(i), float(i), 1.0) for i in range(30)], "pid long, x double, y double, z double")
    assert all(r.value is None for r in I.linear(spark.createDataFrame(q, "qid long, x double, y double"), line).collect())


def test_unknown_options_raise():
    with pytest.raises(ValueError):
        I.InterpolationConfig(method="magic")
    with pytest.raises(TypeError):
        I.InterpolationConfig(nonsense=1)


def test_flood_two_basins():
    cost = np.array([[0, 1, 5, 1, 0.0]])
    assert flood(cost, np.array([[1, 0, 0, 0, 2]]), np.ones((1, 5), bool)).tolist()[0] in ([1, 1, 1, 2, 2], [1, 1, 2, 2, 2])


def test_rings_with_hole():
    r, c = np.nonzero(np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]]))
    rings = trace_rings(r, c)
    assert len(rings) == 2 and len(rings[0]) == 5 and len(rings[1]) == 5
    assert len(trace_outline(r, c)) == 8


def test_grid():
    g = GridMeta.over(0, 0, 10.1, 5, 1.0)
    assert (g.width, g.height) == (11, 5) and GridMeta(0.5, 0, -0.5, 0, 1, 1).buffer_px(0.85) == 2


def test_stencils_beside_gaps(spark):
    """A null inside is a gap, not the raster's border: as with NaN in arrays."""
    line = [0.0, 1.0, 4.0, None, 16.0, 25.0, 36.0]
    df = spark.createDataFrame([(r, c, v if r == 0 else 1.0) for r in range(3) for c, v in enumerate(line)], "prow long, pcol long, v double")
    arr = np.array([[np.nan if x is None else x for x in line], [1.0] * 7, [1.0] * 7])
    got = N.gradient(df, "v", 1.0).toPandas().sort_values(["prow", "pcol"])
    want = np.gradient(arr)
    for name, w in zip(("d_row", "d_col"), want, strict=True):
        assert np.allclose(got[name].to_numpy(float).reshape(3, 7), w, equal_nan=True), name
    pad = np.pad(arr, 1, mode="edge")
    mean = sum(pad[i : i + 3, j : j + 7] for i in range(3) for j in range(3)) / 9
    assert np.allclose(as_array(N.mean3(df, "v", "m"), "m"), mean, equal_nan=True)
    mirror = np.pad(arr, 1, mode="reflect")
    gx = sum(k * (mirror[i : i + 3, 2:9] - mirror[i : i + 3, 0:7]) for i, k in ((0, 1), (1, 2), (2, 1)))
    assert np.allclose(as_array(N.sobel(df, "v"), "gx"), gx, equal_nan=True)
    ones = spark.createDataFrame([(0, c, None if c == 5 else 1000.0 if c == 0 else 1.0) for c in range(30)], "prow long, pcol long, v double")
    out = N.gaussian(ones, "v", "g").toPandas().sort_values("pcol").g
    assert out[:12].isna().all() and np.allclose(out[12:], 1)


def test_group_filter_by_area(spark):
    """Ten points two pixels apart are ten members, but their dissolved discs cover 56 square pixels."""
    from orthoflux.operators.components import group_filter

    row = [(0, 2 * k, k) for k in range(10)] + [(40, 40, 99), (40, 41, 98)]
    df = spark.createDataFrame(row, "prow long, pcol long, id long")
    kept = {r.id: (r.component, r.area_px) for r in group_filter(df, 50).collect()}
    assert set(kept) == set(range(10)) and {c for c, _ in kept.values()} == {0}
    cells = {(8 * p + i, 8 * q + j) for p, q, k in row[:10] for i in range(-12, 12) for j in range(-12, 12) if (i + 0.5) ** 2 + (j + 0.5) ** 2 <= 144}
    assert kept[0][1] == len(cells) / 64 == pytest.approx(56.4, abs=0.4)
    assert {r.id for r in group_filter(df, 7).collect()} == set(range(10)) | {98, 99} and group_filter(df, 57).count() == 0
    assert group_filter(df.limit(0), 1).count() == 0


@pytest.mark.parametrize("fetch", [10_000, 3])
def test_ranks_against_numpy(spark, monkeypatch, fetch):
    from orthoflux.operators import ranks

    monkeypatch.setattr(ranks, "FETCH", fetch)
    monkeypatch.setattr(ranks, "BUCKETS", 8)
    rng = np.random.default_rng(5)
    for v in (rng.normal(size=500), np.r_[np.zeros(300), 1e9, rng.random(50)], np.array([7.0]), np.r_[np.full(9, 2.0), -np.inf, np.inf], rng.integers(0, 4, 200).astype(float)):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        order = np.sort(v)
        some = sorted({0, len(v) // 3, len(v) - 1})
        assert ranks.values_at(df, "v", some) == order[some].tolist()
        if np.isfinite(v).all():
            assert np.allclose(ranks.quantiles(df, "v", (0.0, 0.05, 0.5, 0.75, 1.0)), np.quantile(v, (0.0, 0.05, 0.5, 0.75, 1.0)))
    assert ranks.quantiles(df.limit(0), "v", (0.5,)) == [None]


def test_split_plans_no_exchange_of_rows(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    plan = split(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan
    assert split(df.limit(0), "k").count() == 0 and split(spark.createDataFrame([(None,), (1,)], "k long"), "k").count() == 2


def test_points_in_polygons_against_brute_force(spark):
    """Concave rings, holes and overlaps, as pairs and as a semi-join, with small and large cells."""
    from orthoflux.operators.joins import points_in_polygons

    rng = np.random.default_rng(7)

    def star(x, y, r, n):
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        k = r * (0.4 + 0.6 * rng.random(n))
        p = [(float(x + q * np.cos(t)), float(y + q * np.sin(t))) for q, t in zip(k, a, strict=True)]
        return [*p, p[0]]

    polys = []
    for g in range(25):
        x, y = rng.random(2) * 100
        polys.append((g, [star(x, y, rng.random() * 25 + 1, 11)] + ([star(x, y, 0.5, 5)] if g % 3 == 0 else [])))
    pts = [(i, *map(float, rng.random(2) * 120 - 10)) for i in range(400)] + [(400 + g, *ring[0][0]) for g, ring in polys]

    def inside(x, y, rings):
        odd = False
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
                odd ^= (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
        return odd

    want = {(i, g) for i, x, y in pts for g, rings in polys if inside(x, y, rings)}
    pdf = spark.createDataFrame(pts, "pid long, x double, y double").withColumn("tag", F.col("pid") * 2)
    gdf = spark.createDataFrame(polys, f"gid long, rings array<{G.RING}>")
    for cell in (None, 3.0, 500.0):
        assert {(r.pid, r.gid) for r in points_in_polygons(pdf, gdf, cell, semi=False).collect()} == want
        assert sorted((r.pid, r.tag) for r in points_in_polygons(pdf, gdf, cell).collect()) == sorted((i, 2 * i) for i in {i for i, _ in want})
    assert points_in_polygons(pdf, gdf.limit(0)).count() == 0


def test_prediction_keeps_pixels_with_gaps(spark):
    from orthoflux.operators import ml

    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4)) for i in range(60)] + [(98, None, 0), (99, float("nan"), 1)], "id long, f double, label int")
    model = ml.fit_forest(rows, ("f",), trees=3, depth=3)
    out = {r.id: r for r in ml.predict(model, rows, ("f",)).collect()}
    assert len(out) == 62 and out[98].p0 is None and out[99].prediction is None and all(out[i].prediction == out[i].label for i in range(60))


def test_trees_are_grown_whole(spark):
    """Labels that do not part make deep trees: few jobs all the same, equal forests whatever the partitions, rows learned by heart."""
    from orthoflux.operators import ml

    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(rng.integers(0, 256, 3000), rng.random(3000), rng.integers(0, 2, 3000), strict=True))]
    rows = spark.createDataFrame(pts, "id long, f double, g double, label int")
    sc = spark.sparkContext
    sc.setJobGroup("forest", "whole trees")
    model = ml.fit_forest(rows, ("f", "g"), trees=30, depth=25)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("forest")) <= 6
    got = {r.id: (r.p0, r.p1, r.prediction) for r in ml.predict(model, rows, ("f", "g")).collect()}
    assert len(got) == 3000 and np.mean([got[i][2] == y for i, _, _, y in pts]) > 0.9
    assert all(p0 + p1 == pytest.approx(1) and best == (p1 > p0) for p0, p1, best in got.values())
    # bins of one value each depend on no partition
    coarse = rows.withColumn("g", F.floor(F.col("g") * 50).cast("double"))
    one, other = (ml.predict(ml.fit_forest(d, ("f", "g"), trees=5, depth=8), coarse, ("f", "g")).orderBy("id").collect() for d in (coarse, coarse.orderBy(F.desc("g")).repartition(7)))
    assert one == other


def test_trees_take_the_best_splits():
    """Every node of a tree over all features, against all splits tried one by one."""
    from orthoflux.operators import forest

    rng = np.random.default_rng(2)
    x, y = forest.in_order(rng.integers(0, 6, (300, 3)).astype(np.uint8), rng.integers(0, 3, 300).astype(np.uint8))
    depth, seed = 6, (5, 1)
    nodes, leaves, share = forest.grow(x, y, 3, depth, 3, seed)
    copies = np.random.default_rng(seed).poisson(1.0, 300)
    leaf = np.cumsum((nodes & 255) == forest.LEAF) - 1

    def worth(rows):
        n = np.bincount(y[rows], copies[rows], 3)
        return (n**2).sum() / n.sum() if n.sum() else 0.0

    def walk(k, rows, level):
        tried = [worth(rows[x[rows, f] <= b]) + worth(rows[x[rows, f] > b]) for f in range(3) for b in range(5)]
        at, f, b = nodes[k] >> 16, (nodes[k] >> 8) & 255, nodes[k] & 255
        if b == forest.LEAF:
            assert level == depth or max(tried) <= worth(rows) + 1e-6
            assert leaves[leaf[k]].tolist() == np.bincount(y[rows], copies[rows], 3).tolist()
            return 1
        left, right = rows[x[rows, f] <= b], rows[x[rows, f] > b]
        assert worth(left) + worth(right) == pytest.approx(max(tried))
        return walk(at, left, level + 1) + walk(at + 1, right, level + 1)

    assert walk(0, np.flatnonzero(copies), 0) == len(leaves) and share.sum() == pytest.approx(1)


def test_rbf_over_all_points(spark):
    """One system over all points meets the points, reproduces a plane, and is what many neighbours give."""
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y), float(2 * x - y + 7)) for i, (x, y) in enumerate(rng.random((60, 2)) * 100)]
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    cells = spark.createDataFrame([(i, p[1], p[2]) for i, p in enumerate(pts)] + [(900, 31.0, 47.0)], "qid long, x double, y double")
    whole = I.InterpolationConfig(method="rbf", rbf_neighbors=None)
    got = {r.qid: r.value for r in I.rbf(cells, df, whole).collect()}
    assert all(got[i] == pytest.approx(p[3], abs=1e-5) for i, p in enumerate(pts)) and got[900] == pytest.approx(22.0, abs=1e-5)
    bumpy = df.withColumn("z", F.sin(F.col("x") / 9) * F.col("y"))
    for kernel in I.KERNELS:
        a, b = (I.rbf(cells.where("qid = 900"), bumpy, I.InterpolationConfig(method="rbf", rbf_kernel=kernel, rbf_epsilon=0.1, rbf_smoothing=1e-6, rbf_neighbors=n)).first()["value"] for n in (None, 60))
        assert a == pytest.approx(b, rel=1e-3, abs=1e-3), kernel
    assert I.rbf(cells, df.limit(0), whole).where("value IS NOT NULL").count() == 0


def test_spline_smoothing(spark):
    """A bound on the residuals ends the growth of knots; none, or one that cannot be met, gives the most knots."""
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y), float(np.sin(x / 10) * 10 + rng.normal() * 0.1)) for i, (x, y) in enumerate(rng.random((800, 2)) * 100)]
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    at = df.select(F.col("pid").alias("qid"), "x", "y")

    def residual(bound):
        got = I.spline(at, df, I.InterpolationConfig(method="spline", spline_smoothing=bound)).toPandas().set_index("qid").value
        return float(sum((got[p[0]] - p[3]) ** 2 for p in pts))

    best, loose = residual(None), residual(1e9)
    assert best < 10 and loose > 1000 and residual(0.0) == pytest.approx(best)
    middle = residual(100.0)
    assert best <= middle <= 100


def test_run_log(spark, tmp_path):
    from orthoflux.runlog import RunLog, elapsed

    log = RunLog()
    with log.step("rows") as step:
        step.wrote(spark.range(70))
    with log.step("none"):
        pass
    with pytest.raises(ValueError), log.step("broken"):
        raise ValueError
    got = log.table(spark).collect()
    assert [(r.step, r.rows) for r in got] == [("rows", 70), ("none", None)] and got[0].rows_per_second > 0 and got[1].rows_per_second is None
    log.write(str(tmp_path / "run.txt"))
    lines = (tmp_path / "run.txt").read_text().splitlines()
    assert len(lines) == 3 and lines[0].startswith("rows: 0:00:0") and lines[2].startswith("total")
    assert elapsed(3723.9) == "1:02:03"


def test_reprojection_there_and_back(spark):
    """A point 3 degrees from the meridian returns to under a tenth of a micrometre's worth of degrees."""
    df = spark.createDataFrame([(float(x), float(y)) for x in (-36, -33, -30.5) for y in (-79, -8, 0, 40)], "x double, y double")
    there = df.select(F.col("x").alias("lon"), F.col("y").alias("lat"), "x", "y")
    back = G.reproject(G.reproject(there, 4326, 31985), 31985, 4326).toPandas()
    assert (back.x - back.lon).abs().max() < 1e-10 and (back.y - back.lat).abs().max() < 1e-10


def test_terrain_run_reports(spark, sf_dir):
    """A fifth of the training pixels is judged by the forest of the others, and the log knows every step."""
    from orthoflux.plans import fixtures as fx
    from orthoflux.plans import pipelines as P
    from orthoflux.runlog import RunLog

    log, grid = RunLog(), fx.meta(fx.rows_of(spark, sf_dir))
    cfg = P.TerrainConfig(buffer_m=2.0, trees=5, depth=4, confidence=0.5, min_group_px=2, terrain=I.InterpolationConfig(method="nearest", resolution=20.0))
    out = P.terrain_run(fx.px(spark, sf_dir), fx.train(spark, sf_dir), grid, cfg, log=log)
    rows = {s.name: s.rows for s in log.steps}
    assert list(rows) == ["features", "training rows", "forest", "probability", "heights"] and rows["features"] == rows["probability"] == 1500
    report = {r["class"]: r for r in out["report"].collect()}
    assert set(report) == {"0", "1", "macro", "weighted"} and 0 < report["macro"].support <= 0.4 * rows["training rows"]
    assert 0 <= out["accuracy"].first()[0] <= 1 and out["importances"].count() == 14
    assert out["points"].count() == rows["heights"]


def crowd(spark, n=400):
    """A raster of 12 x 12 pixels of 2 units with some values null, and ``n`` points in few of its pixels, edges included."""
    px = spark.createDataFrame([(r, c, None if (r + c) % 5 == 0 else r * 12 + c) for r in range(12) for c in range(12)], "prow long, pcol long, g int")
    pts = spark.createDataFrame([(i, (i % 3) * 11.5 + i / 1000, 24.0 - (i % 2) * 20 - i / 1000) for i in range(n)], "pid long, x double, y double")
    return pts, px, GridMeta(2.0, 0.0, -2.0, 24.0, 12, 12)


def explained(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("shift", [False, True])
def test_patch_pixels_are_looked_up_once_a_pixel(spark, tmp_path, shift):
    """Offsets are exploded over distinct pixels, and neither they nor the points are broadcast."""
    from orthoflux.operators import joins as J

    pts, px, grid = crowd(spark)
    pts.write.parquet(f"{tmp_path}/points")  # files, so that a size is known
    px.write.parquet(f"{tmp_path}/pixels")
    pts, px = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/pixels")
    found = J.patch_pixels(pts, px, grid, -2, 1, shift)
    assert "BroadcastHashJoin" not in explained(found)
    got = sorted((r.pid, r.prow, r.pcol) for r in found.collect())
    want = []
    for p in pts.collect():
        r0, c0 = math.floor((24 - p.y) / 2) - 2, math.floor(p.x / 2) - 2
        r0, c0 = (max(0, r0), max(0, c0)) if shift else (r0, c0)
        want += [(p.pid, r, c) for r in range(r0, r0 + 4) for c in range(c0, c0 + 4) if 0 <= r < 12 and 0 <= c < 12]
    assert got == sorted(want)


@pytest.mark.parametrize("shift", [False, True])
def test_patch_stats_make_no_pairs(spark, shift):
    """The aggregates of all pairs of points and pixels, without making these."""
    from orthoflux.operators import joins as J

    pts, px, grid = crowd(spark)
    stats = F.count(F.lit(1)).alias("n"), F.count("g").alias("m"), F.sum("g").alias("s")
    want = sorted(map(tuple, J.patch_pixels(pts, px, grid, -5, 5, shift).groupBy("pid").agg(*stats).collect()))
    found = J.patch_stats(pts, px, grid, -5, 5, *stats, shift_low=shift)
    assert sorted(map(tuple, found.select("pid", "n", "m", "s").collect())) == want
    assert "BroadcastHashJoin" not in explained(found)


def test_shifted_patch_of_repeated_ids(spark, sf_dir, tmp_path):
    """A customer that stands twice counts its patch twice, as the SQL does."""
    import duckdb

    from orthoflux.plans.catalog import ORACLE_SQL, QUERIES

    for t in ("customer", "orders"):
        twice = f"SELECT * FROM '{sf_dir}/{t}.parquet'" + (f" UNION ALL SELECT * FROM '{sf_dir}/{t}.parquet' WHERE c_custkey < 9" if t == "customer" else "")
        duckdb.sql(f"COPY ({twice}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("j2_n12_training_patch", "n13_inclusive_patch", "n14_shifted_patch"):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(ORACLE_SQL[name]).fetchall())


def scattered(spark, n=300):
    """Points in a small square with copies of places, heights and ids, and rows with null or NaN coordinates, heights and ids."""
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(rng.uniform(-9, 9, n).round(1), rng.uniform(-9, 9, n).round(1), rng.integers(0, 50, n), strict=True))]
    rows += [(5, 1.0, 1.0, 3.0), (5, -8.0, 8.0, 4.0), (None, 0.0, 0.0, 7.0), (n, None, 0.0, 1.0), (n + 1, math.nan, 0.0, 1.0), (n + 2, 0.5, 0.5, None), (n + 3, 1e300, 0.0, 2.0), (n + 4, 50.0, 50.0, math.nan), (n + 5, 51.0, 50.0, 9.0)]
    return rows, spark.createDataFrame(rows, "pid long, x double, y double, z double")


def near(a, b, radius):
    if None in (*a[1:3], *b[1:3]):
        return False
    dx, dy = a[1] - b[1], a[2] - b[2]
    return dx * dx + dy * dy <= radius * radius


def test_local_outliers_against_brute_force(spark, monkeypatch):
    """Without rows for the pairs; points of one id share all their neighbours, as in the SQL."""
    from orthoflux.operators import joins as J

    rows, pts = scattered(spark)
    want = []
    for p in rows:
        z = [q[3] for a in rows if a[0] == p[0] and a[0] is not None for q in rows if q[3] is not None and near(a, q, 3.0)]
        if z and p[3] is not None:
            limit = np.median(z) + 1.5 * np.std(z)
            if np.isnan(limit) or p[3] <= limit:  # NaN is the greatest
                want.append(p[0])
    assert sorted(r.pid for r in J.local_outliers(pts, 3.0).collect()) == sorted(want)
    once = pts.where("pid IS NOT NULL").dropDuplicates(["pid"])
    monkeypatch.setattr(J, "within_radius", None)
    assert J.local_outliers(once, 3.0).count() > 0


@pytest.mark.parametrize("radius", [0.3, 3.0])
def test_pairs_within_radius_against_brute_force(spark, monkeypatch, radius):
    """In batches of any size; only the columns asked for are made."""
    from orthoflux.operators import joins as J

    rows, pts = scattered(spark)
    monkeypatch.setattr(J, "PAIRS", 100)
    want = sorted((str(a[0]), str(b[0]), str(b[3])) for a in rows for b in rows if near(a, b, radius))
    got = J.within_radius(pts, radius).collect()
    assert sorted((str(r.a), str(r.b), str(r.z)) for r in got) == want and max(r.d2 for r in got) <= radius**2
    lean = J.within_radius(pts, radius, ("a", "b"))
    assert lean.columns == ["a", "b"] and sorted((str(r.a), str(r.b)) for r in lean.collect()) == sorted(w[:2] for w in want)


def joined_rows(plan):
    """Rows that the joins of an executed plan gave."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0) + sum(map(joined_rows, inner))


def test_points_in_many_polygons_make_few_pairs(spark, monkeypatch):
    """Each of 300 points lies in all of 100 squares: one of these settles it, the others are not met."""
    from orthoflux.operators import joins as J

    made = []

    def spy(df, name):
        rows = df.collect()
        made.append(joined_rows(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(J, "materialize", spy)
    pts = spark.createDataFrame([(i, 40.0 + i / 20, 60.0 - i / 20) for i in range(300)], "pid long, x double, y double")
    square = lambda h: [[(50.0 - h, 50.0 - h), (50.0 + h, 50.0 - h), (50.0 + h, 50.0 + h), (50.0 - h, 50.0 + h), (50.0 - h, 50.0 - h)]]
    polys = spark.createDataFrame([(i, square(40.0 + i / 10)) for i in range(100)], f"gid long, rings array<{G.RING}>")
    assert J.points_in_polygons(pts, polys).count() == 300
    assert made and sum(made) <= 300 * 10


def test_watershed_does_not_depend_on_tiles(spark, monkeypatch):
    """Ties in plenty: the result is the state that follows from the least neighbour's, whatever the tiles."""
    from orthoflux.operators import segment as S

    rng = np.random.default_rng(5)
    h, w = 23, 14
    cost, mask = rng.integers(0, 4, (h, w)) / 4, rng.random((h, w)) < 0.9
    marker = np.where(rng.random((h, w)) < 0.04, rng.permutation(h * w).reshape(h, w) + 1, 0)
    state, heap = {}, [(cost[r, c], 0, int(marker[r, c]), r, c) for r, c in np.argwhere(mask & (marker > 0)).tolist()]
    while heap:
        lv, st, lb, r, c = min(heap)
        heap.remove((lv, st, lb, r, c))
        if (r, c) in state:
            continue
        state[r, c] = lb
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < h and 0 <= x < w and mask[y, x] and (y, x) not in state:
                heap.append((cost[y, x], 0, lb, y, x) if cost[y, x] > lv else (lv, st + 1, lb, y, x))
    df = spark.createDataFrame([(r, c, float(cost[r, c]), int(marker[r, c]), bool(mask[r, c])) for r in range(h) for c in range(w)], "prow long, pcol long, cost double, marker long, mask boolean")
    for tile in (4, 9, 100):
        got = {(r.prow, r.pcol): r.label for r in S.watershed(df, tile).collect()}
        assert got == {(r, c): state.get((r, c), 0) for r, c in np.argwhere(mask).tolist()}
    assert S.watershed(df.where("cost < 0")).count() == 0


def test_watershed_rounds_of_a_narrow_raster(spark, monkeypatch):
    """One marker at the end of 4,000 rows of 3 columns: a tile is as high as its size allows."""
    from orthoflux.operators import segment as S

    names = []
    real = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: names.append(name) or real(df, name))
    at = F.col("id")
    df = spark.range(12_000).select(F.floor(at / 3).alias("prow"), (at % 3).alias("pcol"), (at * 37 % 101 / 101).alias("cost"), F.when(at == 0, 7).otherwise(0).alias("marker"), F.lit(True).alias("mask"))
    assert {r.label for r in S.watershed(df, tile=64).select("label").distinct().collect()} == {7}
    assert len(names) <= 14
