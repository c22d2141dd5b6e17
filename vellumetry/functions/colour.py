"""Colour of pixels, as column expressions over channels from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumetry.functions.pages import bound

#: Linear sRGB to XYZ under D65, its white, and the knees of the gamma and Lab curves.  Fixed values of the standards.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
GAMMA_KNEE, LAB_KNEE, LAB_SLOPE, LAB_START = 0.04045, 0.008856451679, 7.787037037, 0.13793103448


def luma(r: Column, g: Column, b: Column) -> Column:
    return (r * 299 + g * 587 + b * 114) / 1000


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top == 0, 0.0).otherwise((top - F.least(r, g, b)) * 255 / F.when(top == 0, 1).otherwise(top))


def linear(c: Column) -> Column:
    s = c / 255
    return F.when(s <= GAMMA_KNEE, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> Column:
    """L from 0 to 100, a and b around 0, and the chroma."""
    curve = lambda t: F.when(t > LAB_KNEE, F.cbrt(t)).otherwise(t * LAB_SLOPE + LAB_START)
    each = lambda part: F.array(*(sum((part[k] * v for k, v in enumerate(row)), F.lit(0.0)) / w for row, w in zip(TO_XYZ, WHITE, strict=True)))

    def made(f: Column) -> Column:
        return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))

    # each step is bound, so that what the next one mentions is computed once
    xyz = bound(F.array(*(linear(c) for c in (r, g, b))), each)
    whole = lambda v: F.struct(v["l"].alias("l"), v["a"].alias("a"), v["b"].alias("b"), F.hypot(v["a"], v["b"]).alias("chroma"))
    return bound(bound(F.transform(xyz, curve), made), whole)
