"""Polygons as arrays of closed rings (ring 0 is the exterior), in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area of a closed ring."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("p"), F.slice(ring, F.lit(2), n - 1).alias("q"))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])) / 2.0


def ring_length(ring: Column) -> Column:
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("p"), F.slice(ring, F.lit(2), n - 1).alias("q"))
    d = lambda s, c: s["p"][c] - s["q"][c]
    return F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + F.sqrt(d(s, "x") * d(s, "x") + d(s, "y") * d(s, "y")))


def polygon_area(rings: Column) -> Column:
    """Area of the exterior less that of the holes."""
    holes = F.aggregate(F.slice(rings, F.lit(2), F.greatest(F.lit(0), F.size(rings) - 1)), F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return ring_area(rings[0]) - holes


def keep_holes(rings: Column, min_area: float) -> Column:
    """The exterior and the holes of at least ``min_area``."""
    return F.filter(rings, lambda r, i: (i == 0) | (ring_area(r) >= min_area))


def valid_ring(ring: Column) -> Column:
    """Three different vertices or more."""
    return F.size(F.array_distinct(ring)) >= 3


def disc(x: Column, y: Column, radius: float, segments: int = 64) -> Column:
    """A buffer ring around a point, closed."""
    step = 2 * math.pi / segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: F.struct((x + F.cos((i % segments) * step) * radius).alias("x"), (y + F.sin((i % segments) * step) * radius).alias("y")))


def buffers(points: DataFrame, radius: float, segments: int = 64) -> DataFrame:
    """``points`` with ``rings``: a disc of ``radius`` around each (``x, y``); points without coordinates have none and go."""
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return placed.withColumn("rings", F.array(disc(F.col("x"), F.col("y"), radius, segments)))


def convex_hull(points: Column) -> Column:
    """Closed hull, counter-clockwise from the least point (monotone chain, pure expressions)."""
    pts = F.array_sort(F.array_distinct(points))

    def half(seq):
        def add(chain, p):
            def pop(c):
                n = F.size(c)
                a, b = F.element_at(c, n - 1), F.element_at(c, n)
                return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) <= 0

            # at most all earlier points are dropped: fold over the chain from its end
            drop = F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chain))),
                F.struct(chain.alias("c"), F.lit(True).alias("go")),
                lambda s, _: F.when(s["go"] & (F.size(s["c"]) >= 2), F.when(pop(s["c"]), F.struct(F.slice(s["c"], F.lit(1), F.size(s["c"]) - 1).alias("c"), F.lit(True).alias("go"))).otherwise(F.struct(s["c"].alias("c"), F.lit(False).alias("go")))).otherwise(s),
            )["c"]
            return F.concat(drop, F.array(p))

        return F.aggregate(seq, F.slice(seq, F.lit(1), F.lit(0)), add)

    lower, upper = half(pts), half(F.reverse(pts))
    return F.when(F.size(pts) < 3, pts).otherwise(F.concat(F.slice(lower, F.lit(1), F.size(lower) - 1), upper))


def clean_polygons(polygons: DataFrame, min_hole: float, max_area: float) -> DataFrame:
    """Small holes filled, then polygons of positive area up to ``max_area``; adds ``area_m2`` and ``holes_removed``."""
    kept = polygons.withColumn("__r", keep_holes(F.col("rings"), min_hole))
    out = kept.withColumn("holes_removed", F.size("rings") - F.size("__r")).drop("rings").withColumnRenamed("__r", "rings").withColumn("area_m2", polygon_area(F.col("rings")))
    return out.where((F.col("area_m2") > 0) & (F.col("area_m2") <= max_area))


def _disc_masks(radius: float) -> list[tuple[int, int, int]]:
    """(row offset, column offset, mask) of the pixels that a disc around a pixel's corner point touches: one bit for
    each of 8 x 8 cells of the pixel whose centre the disc covers."""
    n = int(math.ceil(radius))
    out = []
    for dr in range(-n, n):
        for dc in range(-n, n):
            bits = 0
            for k in range(64):
                y, x = dr + (k // 8 + 0.5) / 8, dc + (k % 8 + 0.5) / 8
                bits |= (y * y + x * x <= radius * radius) << k
            if bits:
                out.append((dr, dc, bits - (1 << 64) if bits >> 63 else bits))
    return out


def disc_union_area(groups: DataFrame, radius: float, group: str = "component") -> DataFrame:
    """``(group, area_px)``: area of the union of discs around pixel centres, by group.

    A pixel's 8 x 8 cells are the bits of one long.  A disc sets bits of the few pixels
    it touches; a partial aggregate joins them by OR, so overlaps count once and a group
    is never gathered.  A cell counts where its centre is covered.
    """
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(b).alias("bits")) for r, c, b in _disc_masks(radius)])
    each = groups.select(group, "prow", "pcol", F.explode(moves).alias("m"))
    at = each.select(group, (F.col("prow") + F.col("m.dr")).alias("r"), (F.col("pcol") + F.col("m.dc")).alias("c"), "m.bits")
    pixels = at.groupBy(group, "r", "c").agg(F.bit_or("bits").alias("bits"))
    return pixels.groupBy(group).agg((F.sum(F.bit_count("bits")) / 64.0).alias("area_px"))


_A, _F = 6378137.0, 1 / 298.257222101  # GRS80; differs from WGS84 by under a millimetre here
E2 = _F * (2 - _F)
_N = _F / (2 - _F)
#: Scaled radius of the rectifying sphere, and the coefficients of Krueger's series in the third flattening (fixed values).
RADIUS = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_zone(epsg: int) -> tuple[float, bool]:
    """Central meridian (degrees) and whether southern, of a UTM code: 326xx, 327xx, or SIRGAS 2000 319xx."""
    if 32601 <= epsg <= 32660:
        zone, south = epsg - 32600, False
    elif 32701 <= epsg <= 32760:
        zone, south = epsg - 32700, True
    elif 31965 <= epsg <= 31976:
        zone, south = epsg - 31954, False
    elif 31977 <= epsg <= 31985:
        zone, south = epsg - 31960, True
    else:
        raise ValueError(f"EPSG:{epsg} is neither 4326 nor a supported UTM zone")
    return zone * 6.0 - 183.0, south


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series to fourth order (a few micrometres inside a zone)."""
    lon0, south = utm_zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    e = math.sqrt(E2)
    atanh = lambda v: F.log((F.lit(1.0) + v) / (F.lit(1.0) - v)) / 2.0
    t = F.sinh(atanh(F.sin(phi)) - atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    x, y = eta, xi
    for j, al in enumerate(ALPHA, 1):
        x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * al
        y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * al
    return x * RADIUS + 500000.0, y * RADIUS + (1e7 if south else 0.0)


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude, the inverse of ``to_utm``."""
    lon0, south = utm_zone(epsg)
    xi, eta = (y - (1e7 if south else 0.0)) / RADIUS, (x - 500000.0) / RADIUS
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        eta1 = eta1 - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + F.sin(chi * (2 * j)) * d
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + lon0, F.degrees(phi)


def reproject(points: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """Points between EPSG:4326 (x = longitude) and UTM zones, or zone to zone."""
    if source == target:
        return points
    px, py = F.col(x), F.col(y)
    if source != 4326:
        px, py = from_utm(px, py, source)
    if target != 4326:
        px, py = to_utm(px, py, target)
    return points.withColumns({x: px, y: py})
