"""Per-pixel expressions: colour indices, colour spaces, costs and unit conversions.

Everything is a column expression inside whole-stage codegen; doubles throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.col(x)).cast("double")


def chromatic(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """Shares of the three bands; a black pixel divides by one."""
    r, g, b = _d(r), _d(g), _d(b)
    s = F.when(r + g + b == 0, F.lit(1.0)).otherwise(r + g + b)
    return r / s, g / s, b / s


def exg(r="r", g="g", b="b") -> Column:
    """Excess green of chromatic shares: 2g - r - b."""
    rn, gn, bn = chromatic(r, g, b)
    return F.lit(2.0) * gn - rn - bn


def exr(r="r", g="g", b="b") -> Column:
    """Excess red: 1.4r - g."""
    rn, gn, _ = chromatic(r, g, b)
    return F.lit(1.4) * rn - gn


def exb(r="r", g="g", b="b") -> Column:
    """Excess blue: 1.4b - g."""
    _, gn, bn = chromatic(r, g, b)
    return F.lit(1.4) * bn - gn


def exgr(r="r", g="g", b="b") -> Column:
    """Excess green less excess red."""
    return exg(r, g, b) - exr(r, g, b)


def exg255(r="r", g="g", b="b") -> Column:
    """Excess green of bands divided by 255."""
    k = F.lit(255.0)
    return F.lit(2.0) * _d(g) / k - _d(r) / k - _d(b) / k


def to_8bit(v: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..255, rounded; a flat image is 0."""
    return F.when(high > low, F.round((v - low) * 255.0 / (high - low))).otherwise(F.lit(0.0)).cast("int")


def hsv8(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """8-bit hue (0..179), saturation and value."""
    r, g, b = _d(r), _d(g), _d(b)
    v, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    deg = F.when(d == 0, F.lit(0.0)).when(v == r, (g - b) * 60.0 / d).when(v == g, (b - r) * 60.0 / d + 120.0).otherwise((r - g) * 60.0 / d + 240.0)
    hue = F.round(F.when(deg < 0, deg + 360.0).otherwise(deg) / 2.0).cast("int") % 180
    sat = F.when(v == 0, F.lit(0.0)).otherwise(F.round(d * 255.0 / F.when(v == 0, F.lit(1.0)).otherwise(v)))
    return hue, sat.cast("int"), v.cast("int")


def gray(r="r", g="g", b="b") -> Column:
    """Luma, rounded to 8 bits."""
    return F.round(_d(r) * 0.299 + _d(g) * 0.587 + _d(b) * 0.114).cast("int")


def clip8(x) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x if isinstance(x, Column) else F.col(x))).cast("int")


def ndvi_proxy(band1: str, band3: str) -> Column:
    """(b3 - b1) / (b3 + b1 + 1): band 3 is blue here, so this is no true vegetation index."""
    return (_d(band3) - _d(band1)) / (_d(band3) + _d(band1) + 1.0)


def slope_percent(gx: Column, gy: Column) -> Column:
    """Tangent of the steepest angle, in percent."""
    return F.sqrt(gx * gx + gy * gy) * 100.0


def cost_index(v: Column) -> Column:
    """Watershed cost from a vegetation index: its negative."""
    return -v


def cost_two_class(p_tree: Column, p_soil: Column) -> Column:
    """Watershed cost from two probabilities: distance of the nearer one from certainty."""
    return F.least(F.lit(1.0) - p_tree, F.lit(1.0) - p_soil)


def cost_one_class(p: Column) -> Column:
    return F.lit(1.0) - F.abs(p)


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P squared: 1 for a disc."""
    return F.lit(4.0 * math.pi) * area / (perimeter * perimeter)


def las_scaled(raw: Column, scale: float, offset: float) -> Column:
    return raw * F.lit(float(scale)) + F.lit(float(offset))


def las_quantised(v: Column, scale: float, offset: float) -> Column:
    """What a value becomes when stored as a scaled integer."""
    return F.round((v - offset) / scale) * F.lit(float(scale)) + F.lit(float(offset))


def idw_weight(d2: Column, power: float = 2.0) -> Column:
    """Inverse-distance weight from a squared distance."""
    return F.lit(1.0) / (F.pow(F.sqrt(d2), F.lit(float(power))) + 1e-12)


def px_to_m2(n: Column, gsd: float) -> Column:
    return n * F.lit(gsd * gsd)


def m2_to_ha(m2: Column) -> Column:
    return m2 / 10000.0


def adaptive_threshold_scaled(median_p75: Column) -> Column:
    """int(0.8 * median of the patches' upper quartiles)."""
    return (median_p75 * 0.8).cast("int")


def adaptive_threshold_clamped(median: Column) -> Column:
    """int(0.85 * 255 * median), from 30 to 200."""
    return F.greatest(F.lit(30), F.least(F.lit(200), (median * 255.0 * 0.85).cast("int")))


def hsv_range(p_low: Column, p_high: Column, margin: int, top: int) -> tuple[Column, Column]:
    """A hue, saturation or value range widened by ``margin`` and clamped to 0..top."""
    return F.greatest(F.lit(0), (p_low - float(margin)).cast("int")), F.least(F.lit(top), (p_high + float(margin)).cast("int"))
