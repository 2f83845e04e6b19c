"""Scattered points to grid cells: inverse distance, nearest, kriging, radial basis, linear, spline."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import idw_weight
from ..grid import GridMeta
from ..scratch import materialize
from .knn import knn, nearest
from .masks import drop_iqr_outliers, drop_zscore_outliers, usable
from .sampling import sample_n
from .stats import extent, fill_mean, raster_stats
from .stencil import gaussian_with_gaps

METHODS = ("idw", "nearest", "kriging_ordinary", "kriging_universal", "rbf", "linear", "spline")
VARIOGRAMS = ("linear", "power", "gaussian", "spherical", "exponential", "hole-effect")
#: Points of one block of the variogram.
VARIOGRAM_BLOCK = 1024
#: Cells of ``linear`` that are settled over all points at once.
OPEN_CELLS = 4096
KERNELS = ("linear", "thin_plate_spline", "cubic", "quintic", "multiquadric", "inverse_multiquadric", "gaussian")


@dataclass(frozen=True)
class InterpolationConfig:
    """Options of ``interpolate``; unknown ones are an error."""

    method: str = "kriging_ordinary"
    resolution: float = 1.0
    epsg: int = 4326
    nodata_strategy: str = "leave_nan"  # or "nearest", "mean"
    outlier_method: str = "zscore"  # or "iqr", "none"
    outlier_zscore_thresh: float = 3.5
    outlier_iqr_k: float = 2.5
    idw_k_neighbors: int = 16
    idw_power: float = 2.0
    idw_smooth_sigma: float = 1.0
    kriging_variogram: str = "spherical"
    kriging_nlags: int = 20
    kriging_weight: bool = True
    kriging_max_points: int = 60_000
    kriging_neighbors: int = 32
    rbf_kernel: str = "thin_plate_spline"
    rbf_smoothing: float = 0.0
    rbf_epsilon: float = 1.0
    rbf_neighbors: int | None = 50  # None: one system over all (sampled) points
    rbf_max_points: int = 30_000
    spline_kx: int = 3
    spline_ky: int = 3
    spline_knots: int = 16
    spline_smoothing: float | None = None  # bound on the residual sum of squares; None: as many knots as the data carry
    seed: int = 42

    def __post_init__(self):
        for value, known in ((self.method, METHODS), (self.kriging_variogram, VARIOGRAMS), (self.rbf_kernel, KERNELS), (self.nodata_strategy, ("leave_nan", "nearest", "mean")), (self.outlier_method, ("zscore", "iqr", "none"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")


# ---- inverse distance and nearest


def idw(cells: DataFrame, points: DataFrame, k: int = 16, power: float = 2.0) -> DataFrame:
    """``(qid, value)``: weighted mean of the k nearest; a point at no distance gives its own value."""
    near = knn(cells, points.where(usable("z")), k)
    w = idw_weight(F.col("d2"), power)
    hit = F.min(F.when(F.col("d2") == 0, F.struct("rank", "z")))
    out = near.groupBy("qid").agg(F.sum(w * F.col("z")).alias("wz"), F.sum(w).alias("w"), hit.alias("hit"))
    return out.select("qid", F.coalesce(F.col("hit.z"), F.col("wz") / F.col("w")).alias("value"))


def nearest_value(cells: DataFrame, points: DataFrame) -> DataFrame:
    return nearest(cells, points.where(usable("z"))).select("qid", F.col("z").alias("value"))


# ---- kriging


def variogram(kind: str, h: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    """Semivariance at distance h; p is (slope, nugget), (scale, exponent, nugget) or (psill, range, nugget)."""
    if kind == "linear":
        return p[0] * h + p[1]
    if kind == "power":
        return p[0] * h ** p[1] + p[2]
    psill, rng, nugget = p
    if kind == "gaussian":
        return psill * (1 - np.exp(-(h**2) / (4 * rng / 7) ** 2)) + nugget
    if kind == "exponential":
        return psill * (1 - np.exp(-3 * h / rng)) + nugget
    if kind == "hole-effect":
        return psill * (1 - (1 - 3 * h / rng) * np.exp(-3 * h / rng)) + nugget
    return np.where(h <= rng, psill * (1.5 * h / rng - h**3 / (2 * rng**3)), psill) + nugget


def _pair_blocks(pdf: pd.DataFrame):
    """Distances and half squared differences of the pairs of two blocks of points, some rows at a time; a block with itself gives each pair once."""
    for r in pdf.itertuples():
        ax, ay, az, bx, by, bz = (np.asarray(v, float) for v in (r.ax, r.ay, r.az, r.bx, r.by, r.bz))
        for at in range(0, len(ax), 256):
            s = slice(at, at + 256)
            keep = np.ones((len(ax[s]), len(bx)), bool) if r.i != r.j else np.arange(len(bx))[None] > np.arange(at, at + len(ax[s]))[:, None]
            h = np.sqrt((ax[s, None] - bx) ** 2 + (ay[s, None] - by) ** 2)[keep]
            if len(h):
                yield h, ((az[s, None] - bz) ** 2 / 2.0)[keep]


def empirical_variogram(points: DataFrame, lags: int, max_points: int = InterpolationConfig.kriging_max_points, seed: int = 42) -> DataFrame:
    """``(lag, n, h, gamma)`` over all pairs: mean distance and half mean squared difference per equal-width lag.

    Points beyond ``max_points`` are sampled, as for the kriging itself.  Points go into
    blocks of about ``VARIOGRAM_BLOCK``; every two blocks meet in one row, and their pairs
    are reduced there, first to the ends of the distances and then to one row per lag.
    """
    s = sample_n(points.where(usable("z")), "pid", max_points, seed).select("pid", "x", "y", "z")
    blocks = max(1, math.ceil(s.count() / VARIOGRAM_BLOCK))
    held = s.groupBy(F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("i")).agg(F.array_sort(F.collect_list(F.struct("pid", "x", "y", "z"))).alias("p"))
    held = materialize(held.select("i", *[F.col(f"p.{c}").alias(c) for c in "xyz"]), "variogram")
    side = lambda i, c: held.select(F.col("i").alias(i), *[F.col(v).alias(c + v) for v in "xyz"])
    met = side("i", "a").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1)))).join(side("j", "b"), "j").repartition(min(blocks * (blocks + 1) // 2, 200), "i", "j")

    def ends(frames):
        for pdf in frames:
            for h, _ in _pair_blocks(pdf):
                yield pd.DataFrame({"lo": [h.min()], "hi": [h.max()]})

    e = met.mapInPandas(ends, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    lo, width = e["lo"] or 0.0, (e["hi"] - e["lo"] if e["lo"] is not None and e["hi"] > e["lo"] else 1.0)

    def sums(frames):
        n, sh, sg = np.zeros(lags, np.int64), np.zeros(lags), np.zeros(lags)
        for pdf in frames:
            for h, g in _pair_blocks(pdf):
                lag = np.minimum(lags - 1, np.floor((h - lo) * lags / width)).astype(int)
                n += np.bincount(lag, minlength=lags)
                sh += np.bincount(lag, h, lags)
                sg += np.bincount(lag, g, lags)
        yield pd.DataFrame({"lag": np.arange(lags, dtype=np.int32), "n": n, "h": sh, "g": sg})

    total = met.mapInPandas(sums, "lag int, n long, h double, g double").groupBy("lag").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    return total.where("n > 0").select("lag", "n", (F.col("h") / F.col("n")).alias("h"), (F.col("g") / F.col("n")).alias("gamma"))


def fit_variogram(kind: str, h: np.ndarray, g: np.ndarray, weight: bool = True) -> tuple[float, ...]:
    """Least squares, short lags weighted more if ``weight``: linear in all but one parameter, which is searched."""
    order = np.argsort(h)
    h, g = h[order], g[order]
    w = np.ones(len(h))
    if weight and len(h) > 1:
        span = h.max() - h.min()
        # a falling logistic of the distance: half at 70 % of the span, 0.9 to 0.1 within 20 % of it (log 9 either way)
        x = (h - h.min() - 0.7 * span) / (0.1 * span) if span > 0 else np.zeros(len(h))
        w = 1 / (1 + np.exp(np.log(9) * x)) + 1e-3

    def solve(shape):
        a = np.column_stack([shape, np.ones(len(h))]) * np.sqrt(w)[:, None]
        x = np.linalg.lstsq(a, g * np.sqrt(w), rcond=None)[0]
        best = None
        for c in (x, np.array([max((w * shape * g).sum() / max((w * shape * shape).sum(), 1e-30), 0), 0.0]), np.array([0.0, (w * g).sum() / w.sum()])):
            if (c >= 0).all():
                e = (w * (c[0] * shape + c[1] - g) ** 2).sum()
                if best is None or e < best[0]:
                    best = (e, c)
        return best

    if kind == "linear":
        return tuple(solve(h)[1])
    grid = np.linspace(0.05, 1.95, 77) if kind == "power" else np.linspace(0.05, 1.5, 117) * max(h.max(), 1e-12)
    found = []
    for v in grid:
        shape = h**v if kind == "power" else variogram(kind, h, (1.0, v, 0.0))
        e, c = solve(shape)
        found.append((e, float(c[0]), float(v), float(c[1])))
    least = min(found)[0]
    # ranges below the first lag fit alike: the shortest, whatever the rounding of the sums
    return min((f for f in found if f[0] <= least * (1 + 1e-9)), key=lambda f: f[2])[1:]


def krige_weights(px: np.ndarray, py: np.ndarray, z: np.ndarray, qx: float, qy: float, kind: str, params: tuple[float, ...], drift: bool = False) -> float:
    """Ordinary kriging of one cell from its neighbours, with a linear drift if asked for."""
    n = len(z)
    d = np.hypot(px[:, None] - px[None], py[:, None] - py[None])
    cols = [np.ones(n)] + ([px - qx, py - qy] if drift and n > 3 else [])
    m = n + len(cols)
    a, b = np.zeros((m, m)), np.zeros(m)
    a[:n, :n] = variogram(kind, d, params)
    np.fill_diagonal(a[:n, :n], 0.0)
    for i, c in enumerate(cols):
        a[:n, n + i] = a[n + i, :n] = c
    dq = np.hypot(px - qx, py - qy)
    b[:n] = np.where(dq < 1e-10, 0.0, variogram(kind, dq, params))
    b[n] = 1.0
    try:
        w = np.linalg.solve(a, b)[:n]
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(a, b, rcond=None)[0][:n]
    return float(w @ z)


def _local(cells: DataFrame, points: DataFrame, k: int, solve, schema: str = "value double") -> DataFrame:
    """``solve(px, py, z, qx, qy)`` on the k nearest of each cell, in Arrow batches after one grouping.

    Neighbours are gathered per cell (k of them at most), so a row holds all it needs.
    """
    pts = points.where(usable("z")).select("pid", "x", "y", "z")
    near = knn(cells, pts, k).select("qid", "pid", "z", "rank").join(pts.select("pid", F.col("x").alias("px"), F.col("y").alias("py")), "pid")
    rows = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "px", "py", "z"))).alias("n")).join(cells.select("qid", "x", "y"), "qid")
    flat = rows.select("qid", "x", "y", *[F.col(f"n.{c}").alias(c) for c in ("px", "py", "z")])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            out = [solve(np.array(a), np.array(b), np.array(c), x, y) for a, b, c, x, y in zip(pdf.px, pdf.py, pdf.z, pdf.x, pdf.y, strict=True)]
            if names == ["value"]:
                yield pd.DataFrame({"qid": pdf.qid, "value": np.array(out, float)})
            else:
                yield pd.DataFrame({"qid": pdf.qid, **{c: pd.Series([v[i] for v in out], index=pdf.index, dtype=object) for i, c in enumerate(names)}})

    return flat.mapInPandas(run, f"qid long, {schema}")


def kriging(cells: DataFrame, points: DataFrame, cfg: InterpolationConfig) -> DataFrame:
    """``(qid, value)`` from the nearest neighbours under one fitted variogram."""
    pts = sample_n(points.where(usable("z")), "pid", cfg.kriging_max_points, cfg.seed)
    bins = [r for r in empirical_variogram(pts, cfg.kriging_nlags, cfg.kriging_max_points, cfg.seed).collect() if r["n"] > 0]  # one row per lag
    if not bins:
        return nearest_value(cells, points)
    params = fit_variogram(cfg.kriging_variogram, np.array([r["h"] for r in bins]), np.array([r["gamma"] for r in bins]), cfg.kriging_weight)
    kind, drift = cfg.kriging_variogram, cfg.method == "kriging_universal"
    return _local(cells, pts, cfg.kriging_neighbors, lambda px, py, z, x, y: krige_weights(px, py, z, x, y, kind, params, drift))


# ---- radial basis


def rbf_kernel(kind: str, rho: np.ndarray) -> np.ndarray:
    if kind == "linear":
        return -rho
    if kind == "thin_plate_spline":
        return np.where(rho > 0, rho**2 * np.log(np.where(rho > 0, rho, 1.0)), 0.0)
    if kind == "cubic":
        return rho**3
    if kind == "quintic":
        return -(rho**5)
    if kind == "multiquadric":
        return -np.sqrt(1 + rho**2)
    if kind == "inverse_multiquadric":
        return 1 / np.sqrt(1 + rho**2)
    return np.exp(-(rho**2))


DEGREE = {"thin_plate_spline": 1, "cubic": 1, "quintic": 2, "linear": 0, "multiquadric": 0}


def _rbf_solve(px, py, z, ux, uy, kind: str, smoothing: float, epsilon: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Coefficients of the points, then of the least polynomial the kernel needs (in ``ux, uy``), and its exponents."""
    n, deg = len(z), DEGREE.get(kind, -1)
    while deg >= 0 and (deg + 1) * (deg + 2) // 2 > n:
        deg -= 1
    powers = [(i, j) for i in range(deg + 1) for j in range(deg + 1 - i)]
    poly = [ux**i * uy**j for i, j in powers]
    m = n + len(poly)
    a, b = np.zeros((m, m)), np.zeros(m)
    a[:n, :n] = rbf_kernel(kind, epsilon * np.hypot(px[:, None] - px[None], py[:, None] - py[None])) + smoothing * np.eye(n)
    for i, c in enumerate(poly):
        a[:n, n + i] = a[n + i, :n] = c
    b[:n] = z
    try:
        x = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        x = np.linalg.lstsq(a, b, rcond=None)[0]
    return x, powers


def rbf_value(px, py, z, qx, qy, kind: str, smoothing: float, epsilon: float) -> float:
    """Radial-basis value at one cell from its neighbours."""
    scale = max(np.abs(px - qx).max(), np.abs(py - qy).max(), 1e-12)
    # powers of shifted, scaled coordinates: the query is the origin, where only the constant is left
    x, powers = _rbf_solve(px, py, z, (px - qx) / scale, (py - qy) / scale, kind, smoothing, epsilon)
    n = len(z)
    return float(rbf_kernel(kind, epsilon * np.hypot(px - qx, py - qy)) @ x[:n] + (x[n] if powers else 0.0))


def _rbf_global(cells: DataFrame, pts: DataFrame, cfg: InterpolationConfig) -> DataFrame:
    """One system over all points: ``rbf_max_points`` rows and their square in numbers on the driver, one sum a cell."""
    kind, eps = cfg.rbf_kernel, cfg.rbf_epsilon
    p = pts.select("pid", "x", "y", "z").toPandas().sort_values("pid")  # bounded by rbf_max_points
    if not len(p):
        return cells.select("qid", F.lit(None).cast("double").alias("value"))
    px, py, z = (p[c].to_numpy(float) for c in "xyz")
    cx, cy = px.mean(), py.mean()
    scale = max(np.abs(px - cx).max(), np.abs(py - cy).max(), 1e-12)
    coef, powers = _rbf_solve(px, py, z, (px - cx) / scale, (py - cy) / scale, kind, cfg.rbf_smoothing, eps)
    held = cells.sparkSession.sparkContext.broadcast((px, py, coef))

    def run(frames):
        ax, ay, c = held.value
        for pdf in frames:
            qx, qy = pdf.x.to_numpy(), pdf.y.to_numpy()
            out = sum((((qx - cx) / scale) ** i * ((qy - cy) / scale) ** j * c[len(ax) + k] for k, (i, j) in enumerate(powers)), np.zeros(len(pdf)))
            for at in range(0, len(pdf), 64):
                s = slice(at, at + 64)
                out[s] += rbf_kernel(kind, eps * np.hypot(qx[s, None] - ax, qy[s, None] - ay)) @ c[: len(ax)]
            yield pd.DataFrame({"qid": pdf.qid, "value": out})

    return cells.select("qid", "x", "y").mapInPandas(run, "qid long, value double")


def rbf(cells: DataFrame, points: DataFrame, cfg: InterpolationConfig) -> DataFrame:
    pts = sample_n(points.where(usable("z")), "pid", cfg.rbf_max_points, cfg.seed)
    if cfg.rbf_neighbors is None:
        return _rbf_global(cells, pts, cfg)
    kind, smooth, eps = cfg.rbf_kernel, cfg.rbf_smoothing, cfg.rbf_epsilon
    return _local(cells, pts, cfg.rbf_neighbors, lambda px, py, z, x, y: rbf_value(px, py, z, x, y, kind, smooth, eps))


# ---- linear


def _start(px: np.ndarray, py: np.ndarray) -> np.ndarray | None:
    """Three points whose triangle holds the origin, or None where it is outside their hull."""
    angle = np.arctan2(py, px)
    turn = np.sort((angle - angle[0]) % (2 * math.pi))
    if len(px) < 3 or np.diff(np.r_[turn, 2 * math.pi]).max() > math.pi + 1e-9:
        return None
    turn = (angle - angle[0]) % (2 * math.pi)
    b = int(np.argmax(np.where(turn <= math.pi, turn, -1)))
    beyond = np.where(turn > math.pi, turn, np.inf)
    c = int(np.argmin(beyond)) if np.isfinite(beyond).any() else 0
    pick = [0, b, c]
    if abs(_area(px, py, pick)) <= 1e-12 * (px[pick] ** 2 + py[pick] ** 2).max():  # the origin is on an edge: any point beside it
        u, v = (0, b) if np.hypot(px[0] - px[b], py[0] - py[b]) >= np.hypot(px[0] - px[c], py[0] - py[c]) else (0, c)
        off = np.abs((px[v] - px[u]) * (py - py[u]) - (py[v] - py[u]) * (px - px[u]))
        w = int(np.argmax(off))
        if off[w] <= 1e-12 * (px**2 + py**2).max():
            return None
        pick = [u, v, w]
    return np.array(pick)


def _area(px, py, t) -> float:
    a, b, c = t
    return (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a])


def _shares(px, py, t, x: float, y: float) -> np.ndarray:
    """Barycentric coordinates of (x, y) in the triangle t."""
    a, b, c = t
    wb = (x - px[a]) * (py[c] - py[a]) - (y - py[a]) * (px[c] - px[a])
    wc = (px[b] - px[a]) * (y - py[a]) - (py[b] - py[a]) * (x - px[a])
    w = np.array([0.0, wb, wc]) / _area(px, py, t)
    w[0] = 1 - w[1] - w[2]
    return w


def _circle(px, py, t) -> tuple[float, float, float]:
    """Centre and squared radius of the circle through the triangle t."""
    a, b, c = t
    bx, by, cx, cy = px[b] - px[a], py[b] - py[a], px[c] - px[a], py[c] - py[a]
    d, sb, sc = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * sb - by * sc) / d, (bx * sc - cx * sb) / d
    return px[a] + ux, py[a] + uy, ux * ux + uy * uy


def delaunay_triangle(px: np.ndarray, py: np.ndarray, start=None) -> np.ndarray | None:
    """The Delaunay triangle of the points that holds the origin, or None outside their hull.

    From any triangle that holds the origin, the point deepest inside its circle takes the
    place of the corner that keeps the origin inside, until no point is inside the circle.
    Lifted to x^2 + y^2, the triangle sinks at the origin with every step, so this ends.
    """
    t = _start(px, py) if start is None else np.array(start)
    for _ in range(20 * len(px) + 100 if t is not None else 0):
        ox, oy, r2 = _circle(px, py, t)
        power = (px - ox) ** 2 + (py - oy) ** 2 - r2
        power[t] = 0
        p = int(np.argmin(power))
        if power[p] >= -1e-9 * r2:
            break
        own, other = np.maximum(_shares(px, py, t, 0.0, 0.0), 0), _shares(px, py, t, px[p], py[p])
        out = int(np.argmin(np.where(other > 1e-12, own / np.where(other > 1e-12, other, 1.0), np.inf)))
        t[out] = p
    return t


def delaunay_value(px: np.ndarray, py: np.ndarray, z: np.ndarray, qx: float, qy: float) -> float:
    """Linear value at a cell from the Delaunay triangle that holds it, NaN outside the hull of the points."""
    order = np.argsort(np.hypot(px - qx, py - qy), kind="stable")
    px, py, z = px[order] - qx, py[order] - qy, z[order]
    if len(z) and px[0] == 0 and py[0] == 0:
        return float(z[0])
    t = delaunay_triangle(px, py)
    return float("nan") if t is None else float(_shares(px, py, t, 0.0, 0.0) @ z[t])


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of rows (x, y, z)."""
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    both = []
    for rows in (p, p[::-1]):
        chain: list = []
        for r in rows.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (r[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (r[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(r)
        both += chain[:-1] if len(chain) > 1 else chain
    return np.unique(np.array(both).reshape(-1, 3), axis=0)


def _hull_of(points: DataFrame) -> np.ndarray:
    """Corners of the hull of all points; a task sends the corners of its own."""

    def run(frames):
        kept = np.zeros((0, 3))
        for pdf in frames:
            kept = _hull(np.r_[kept, pdf[["x", "y", "z"]].to_numpy(float)])
        yield pd.DataFrame(kept, columns=["x", "y", "z"])

    return _hull(points.select("x", "y", "z").mapInPandas(run, "x double, y double, z double").toPandas().to_numpy(float).reshape(-1, 3))


def _settle(found: dict[int, np.ndarray], cells: dict[int, tuple[float, float]], points: DataFrame) -> dict[int, float]:
    """Values of the cells whose triangle is not proved, by looking at all points.

    ``found`` has a triangle (rows x, y, z) of each cell.  Every task moves it to the
    Delaunay triangle of its own points and the given corners; the driver does so with
    the corners that came back, until no task has a point inside a circle.
    """
    done: dict[int, float] = {}
    while found:
        held = [(q, *cells[q], c) for q, c in sorted(found.items())]

        def run(frames, held=held):
            best = {q: c for q, _, _, c in held}
            for pdf in frames:
                p = pdf[["x", "y", "z"]].to_numpy(float)
                for q, x, y, _ in held:
                    both = np.r_[best[q], p]
                    best[q] = both[delaunay_triangle(both[:, 0] - x, both[:, 1] - y, (0, 1, 2))]
            moved = [(q, *row) for q, _, _, c in held if best[q] is not c for row in best[q] if not (c == row).all(1).any()]
            yield pd.DataFrame(moved, columns=["qid", "x", "y", "z"]).astype({"qid": "int64", "x": float, "y": float, "z": float})

        more = {q: g[["x", "y", "z"]].to_numpy(float) for q, g in points.select("x", "y", "z").mapInPandas(run, "qid long, x double, y double, z double").toPandas().sort_values(["qid", "x", "y"]).groupby("qid")}
        for q, x, y, c in held:
            both = np.r_[c, more.get(q, np.zeros((0, 3)))]
            t = delaunay_triangle(both[:, 0] - x, both[:, 1] - y, (0, 1, 2))
            found[q] = both[t]
            if (t < 3).all():  # no point of any task is inside the circle
                done[q] = float(_shares(c[:, 0] - x, c[:, 1] - y, (0, 1, 2), 0.0, 0.0) @ c[:, 2])
                del found[q]
    return done


def linear(cells: DataFrame, points: DataFrame, neighbors: int = 24) -> DataFrame:
    """``(qid, value)`` on the Delaunay triangles of all points, null outside their hull; of points at one place the least ``pid`` counts.

    A triangle of the nearest ``neighbors`` is proved when its circle reaches no farther
    than they do.  The other cells inside the hull start from a triangle of neighbours
    and hull corners and are settled over all points, ``OPEN_CELLS`` at a time.
    """
    pts = points.where(usable("z")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min("pid").alias("pid"), F.min_by("z", "pid").alias("z"))
    pts = materialize(pts.select("pid", "x", "y", "z"), "linear")
    hull, n = _hull_of(pts), pts.count()

    def solve(px, py, z, qx, qy):
        p = np.column_stack([px, py, z])
        if px[0] == qx and py[0] == qy:
            return float(z[0]), None
        reach = np.inf if len(z) == n else np.hypot(px - qx, py - qy).max()
        for rows in (p, np.r_[p, hull]):
            t = delaunay_triangle(rows[:, 0] - qx, rows[:, 1] - qy)
            if t is not None:
                ox, oy, r2 = _circle(rows[:, 0] - qx, rows[:, 1] - qy, t)
                if math.hypot(ox, oy) + math.sqrt(r2) <= reach:
                    return float(_shares(rows[:, 0] - qx, rows[:, 1] - qy, t, 0.0, 0.0) @ rows[t, 2]), None
        return (None, rows[t].ravel().tolist()) if t is not None else (None, None)

    first = materialize(_local(cells, pts, neighbors, solve, "value double, corners array<double>"), "linear-first")
    out = first.where("corners IS NULL").select("qid", "value")
    n_open = first.where("corners IS NOT NULL").count()
    blocks = math.ceil(n_open / OPEN_CELLS)
    for k in range(blocks):
        rows = first.where("corners IS NOT NULL").where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).join(cells.select("qid", "x", "y"), "qid").collect()  # about OPEN_CELLS rows
        found = _settle({r["qid"]: np.array(r["corners"]).reshape(3, 3) for r in rows}, {r["qid"]: (r["x"], r["y"]) for r in rows}, pts)
        if found:
            out = out.unionByName(cells.sparkSession.createDataFrame(sorted(found.items()), "qid long, value double"))
    return out


# ---- spline


def _basis(t: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """All B-spline basis values at t (Cox-de Boor)."""
    n = len(knots) - degree - 1
    t = np.clip(t, knots[degree], knots[n])
    b = np.zeros((len(t), len(knots) - 1))
    last = np.searchsorted(knots, knots[n], side="left") - 1
    cell = np.clip(np.searchsorted(knots, t, side="right") - 1, degree, last)
    b[np.arange(len(t)), cell] = 1.0
    for d in range(1, degree + 1):
        nb = np.zeros((len(t), len(knots) - 1 - d))
        for i in range(len(knots) - 1 - d):
            l, r = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            nb[:, i] = ((t - knots[i]) / l * b[:, i] if l > 0 else 0) + ((knots[i + d + 1] - t) / r * b[:, i + 1] if r > 0 else 0)
        b = nb
    return b


def _fit_spline(pts: DataFrame, tx: np.ndarray, ty: np.ndarray, kx: int, ky: int):
    """(design, coefficients) on given knots: normal equations are summed on the executors.

    A partition reduces to one matrix of (knots x knots)^2 numbers, bounded by the
    configuration; the driver adds them and solves once.
    """
    m = (len(tx) - kx - 1) * (len(ty) - ky - 1)

    def design(x, y):
        return (_basis(x, tx, kx)[:, :, None] * _basis(y, ty, ky)[:, None, :]).reshape(len(x), -1)

    def normal(frames):
        a, b = np.zeros((m, m)), np.zeros(m)
        for pdf in frames:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                d = design(part.x.to_numpy(), part.y.to_numpy())
                a += d.T @ d
                b += d.T @ part.z.to_numpy()
        yield pd.DataFrame({"i": np.arange(m), "a": list(a), "b": b})

    sums = pts.mapInPandas(normal, "i int, a array<double>, b double").select("i", "b", F.posexplode("a").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("b").alias("b"))
    a, b = np.zeros((m, m)), np.zeros(m)
    got = sums.toPandas()  # (knots x knots)^2 rows, whatever the number of points
    a[got.i, got.j], b[got.i] = got.v, got.b
    coef = np.linalg.solve(a + 1e-8 * np.trace(a) / m * np.eye(m), b)
    return design, coef


def _evaluate(rows: DataFrame, design, coef: np.ndarray, keep: str) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({keep: pdf[keep], "value": design(pdf.x.to_numpy(), pdf.y.to_numpy()) @ coef})

    return rows.select(keep, "x", "y").mapInPandas(run, f"{keep} {dict(rows.dtypes)[keep]}, value double")


def spline(cells: DataFrame, points: DataFrame, cfg: InterpolationConfig) -> DataFrame:
    """Tensor-product B-spline least squares on equal knots.

    With ``spline_smoothing`` the knots grow by half from the fewest, until the residual
    sum of squares is no more than that or ``spline_knots`` (or what the data carry) is
    reached; each step is a scan for the equations and one for the residuals.
    """
    pts = points.where(usable("z")).select("x", "y", "z")
    e = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not e[4]:
        return cells.select("qid", F.lit(None).cast("double").alias("value"))
    kx, ky = cfg.spline_kx, cfg.spline_ky
    most = min(cfg.spline_knots, int(math.sqrt(e[4] / 2)) + 1)

    def knots(lo, hi, n, d):
        hi = hi if hi > lo else lo + 1.0
        return np.r_[[lo] * d, np.linspace(lo, hi, n - d + 1), [hi] * d]

    n = most if cfg.spline_smoothing is None else min(most, max(kx, ky) + 1)
    while True:
        design, coef = _fit_spline(pts, knots(e[0], e[1], max(kx + 1, n), kx), knots(e[2], e[3], max(ky + 1, n), ky), kx, ky)
        if n >= most:
            break
        off = _evaluate(pts, design, coef, "z").agg(F.sum((F.col("z") - F.col("value")) ** 2)).first()[0]
        if off <= cfg.spline_smoothing:
            break
        n = min(most, n + max(1, n // 2))
    return _evaluate(cells, design, coef, "qid")


# ---- the dispatcher


def fill_nodata(grid: DataFrame, strategy: str) -> DataFrame:
    """Null cells stay, get the nearest valid cell's value, or the mean."""
    if strategy == "mean":
        return fill_mean(grid, "value")
    if strategy == "nearest":
        holes = grid.where("value IS NULL").select(F.col("qid"), F.col("pcol").cast("double").alias("x"), F.col("prow").cast("double").alias("y"))
        full = grid.where("value IS NOT NULL").select(F.col("qid").alias("pid"), F.col("pcol").cast("double").alias("x"), F.col("prow").cast("double").alias("y"), F.col("value").alias("z"))
        got = nearest(holes, full, cell=4.0).select("qid", "z")
        return grid.join(got, "qid", "left").withColumn("value", F.coalesce("value", "z")).drop("z")
    return grid


def drop_outliers(points: DataFrame, cfg: InterpolationConfig) -> DataFrame:
    if cfg.outlier_method == "zscore":
        return drop_zscore_outliers(points, "z", cfg.outlier_zscore_thresh)
    if cfg.outlier_method == "iqr":
        return drop_iqr_outliers(points, "z", cfg.outlier_iqr_k)
    return points.where(usable("z"))


def interpolate(points: DataFrame, cfg: InterpolationConfig, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``points(pid, x, y, z)`` -> ``(prow, pcol, x, y, value)`` over bounds (left, bottom, right, top) or the points' extent."""
    clean = drop_outliers(points, cfg)
    if bounds is None:
        e = extent(clean).first()
        if e["left"] is None:
            raise ValueError("no points to interpolate")
        bounds = (e["left"], e["bottom"], e["right"], e["top"])
    grid = GridMeta.over(*bounds, cfg.resolution, cfg.epsg)
    cells = grid.cells(points.sparkSession).withColumn("qid", F.col("prow") * grid.width + F.col("pcol"))
    if cfg.method == "idw":
        out = idw(cells, clean, cfg.idw_k_neighbors, cfg.idw_power)
    elif cfg.method == "nearest":
        out = nearest_value(cells, clean)
    elif cfg.method == "linear":
        out = linear(cells, clean)
    elif cfg.method == "rbf":
        out = rbf(cells, clean, cfg)
    elif cfg.method == "spline":
        out = spline(cells, clean, cfg)
    else:
        out = kriging(cells, clean, cfg)
    whole = cells.join(out, "qid", "left")
    if cfg.method == "idw" and cfg.idw_smooth_sigma > 0:
        whole = gaussian_with_gaps(whole, "value", "__v", cfg.idw_smooth_sigma).drop("value").withColumnRenamed("__v", "value")
    return fill_nodata(whole, cfg.nodata_strategy).select("prow", "pcol", "x", "y", "value")


def summary(raster: DataFrame) -> DataFrame:
    """What is reported of a finished raster."""
    return raster_stats(raster, "value")


def with_method(cfg: InterpolationConfig, method: str) -> InterpolationConfig:
    return replace(cfg, method=method)
