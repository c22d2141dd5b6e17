"""Boxes (x, y, w, h): half-open rectangles, as column expressions.  Non-finite inputs never pass a gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def intersection_area(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((w > 0) & (h > 0) & ~F.isnan(w) & ~F.isnan(h), w * h).otherwise(0.0)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; touching boxes share nothing, and a union of no area gives 0."""
    both = intersection_area(*a, *b)
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when((union > 0) & ~F.isnan(union), both / union).otherwise(0.0)


def containment(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    area = a[2] * a[3]
    return F.when(area > 0, intersection_area(*a, *b) / area).otherwise(0.0)


def normalized(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Corners in fractions, thousandths or pixels, told apart by their greatest number, to (x, y, w, h) in fractions:
    reversed corners are swapped, all is clamped to the page, and an empty box is null."""
    top = F.greatest(x1, y1, x2, y2)
    sx = F.when(top <= 1, F.lit(1.0)).when(top > 1000, F.greatest(F.lit(1.0), w.cast("double"))).otherwise(1000.0)
    sy = F.when(top <= 1, F.lit(1.0)).when(top > 1000, F.greatest(F.lit(1.0), h.cast("double"))).otherwise(1000.0)
    into = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    left, right = into(F.least(x1, x2) / sx), into(F.greatest(x1, x2) / sx)
    upper, lower = into(F.least(y1, y2) / sy), into(F.greatest(y1, y2) / sy)
    finite = lambda v: F.abs(v) < float("inf")  # noqa: E731  (not-a-number is above infinity)
    ok = (right - left > 0) & (lower - upper > 0) & finite(x1) & finite(y1) & finite(x2) & finite(y2)
    return F.when(ok, F.struct(left.alias("x"), upper.alias("y"), (right - left).alias("w"), (lower - upper).alias("h")))


def padded(x: Column, y: Column, w: Column, h: Column, by: Column, page_w: Column, page_h: Column) -> Column:
    """Grown by `by` on each side, to whole pixels outwards, clipped to the page."""
    x0, y0 = F.greatest(F.lit(0), F.floor(x - by)), F.greatest(F.lit(0), F.floor(y - by))
    x1, y1 = F.least(page_w, F.ceil(x + w + by)), F.least(page_h, F.ceil(y + h + by))
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(0), x1 - x0).alias("w"), F.greatest(F.lit(0), y1 - y0).alias("h"))


def bands(length: Column, count: int, overlap: float) -> Column:
    """Overlapping bands along the long side: an array of (band, start, size)."""
    size = round_half_up(length * (1 + overlap) / count)
    one = lambda i: F.struct(i.alias("band"), round_half_up(i / F.lit(max(1, count - 1)) * (length - size)).alias("start"), size.alias("size"))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)


def through_homography(m: list[float], x: Column, y: Column) -> Column:
    w = m[6] * x + m[7] * y + m[8]
    flat = F.abs(w) < 1e-12
    px, py = (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w
    return F.struct(F.when(flat, 0.0).otherwise(px).alias("x"), F.when(flat, 0.0).otherwise(py).alias("y"))


def quad_order(points: Column) -> Column:
    """Corners of a quad clockwise from the top left: least and greatest x + y and x - y, of equal ones the first or the last
    point.  Null where one point would be two corners: the quad is turned too far."""
    by = lambda key: F.array_sort(F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    total, apart = by(lambda p: p["x"] + p["y"]), by(lambda p: p["x"] - p["y"])
    pick = lambda a, k: F.struct(F.element_at(a, k)["x"].alias("x"), F.element_at(a, k)["y"].alias("y"))
    at = F.array(*(F.element_at(a, k)["i"] for a, k in ((total, 1), (apart, -1), (total, -1), (apart, 1))))
    return F.when(F.size(F.array_distinct(at)) == 4, F.array(pick(total, 1), pick(apart, -1), pick(total, -1), pick(apart, 1)))


def inset(q: Column, share: float) -> Column:
    """A quad's points pulled towards their mean by a share of the way."""
    mean = lambda c: F.aggregate(q, F.lit(0.0), lambda s, p: s + p[c]) / 4
    return F.transform(q, lambda p: F.struct(*((p[c] + (mean(c) - p[c]) * share).alias(c) for c in ("x", "y"))))


def _corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clamped to the unit square; null if nothing is left."""
    into = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    c = [into(v) for v in (x1, y1, x2, y2)]
    return F.when((c[2] > c[0]) & (c[3] > c[1]), F.struct(*(v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True))))


def from_canvas(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, edge: Column) -> Column:
    """Corners on a square canvas, in fractions of the image at its top left; null in the padding."""
    sx, sy = edge / F.greatest(F.lit(1), w), edge / F.greatest(F.lit(1), h)
    return _corners(x1 * sx, y1 * sy, x2 * sx, y2 * sy)


def from_band(on_band: Column, bx: Column, by: Column, bw: Column, bh: Column, w: Column, h: Column) -> Column:
    """Corners in fractions of a band (x, y, w, h of the image), in fractions of the image."""
    to = lambda c, start, size, whole: (start + on_band[c] * size) / F.greatest(F.lit(1), whole)
    return _corners(to("x1", bx, bw, w), to("y1", by, bh, h), to("x2", bx, bw, w), to("y2", by, bh, h))


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Null where the two don't overlap."""
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, bottom = F.least(a[0] + a[2], b[0] + b[2]), F.least(a[1] + a[3], b[1] + b[3])
    return F.when((right > x) & (bottom > y), rect(x, y, right - x, bottom - y))


def united(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    x, y = F.least(a[0], b[0]), F.least(a[1], b[1])
    return rect(x, y, F.greatest(a[0] + a[2], b[0] + b[2]) - x, F.greatest(a[1] + a[3], b[1] + b[3]) - y)


def clipped(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """To whole pixels outwards, inside the page."""
    x0, y0 = (F.greatest(F.lit(0), F.least(p, F.floor(v))) for v, p in ((x, page_w), (y, page_h)))
    x1, y1 = F.greatest(x0, F.least(page_w, F.ceil(x + w))), F.greatest(y0, F.least(page_h, F.ceil(y + h)))
    return rect(x0, y0, x1 - x0, y1 - y0)


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Four points, clockwise from the corner nearest the top left; angle in radians."""
    at = lambda sx, sy: F.struct((cx + sx * w / 2 * F.cos(angle) - sy * h / 2 * F.sin(angle)).alias("x"), (cy + sx * w / 2 * F.sin(angle) + sy * h / 2 * F.cos(angle)).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def bounds(points: Column) -> Column:
    """The box around an array of points; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(points) > 0, rect(x, y, F.array_max(xs) - x, F.array_max(ys) - y))


def gaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """How far two boxes are apart across and down; 0 where they overlap on that axis."""
    apart = lambda p, q, pl, ql: F.greatest(F.lit(0.0), p - (q + ql), q - (p + pl))
    return F.struct(apart(a[0], b[0], a[2], b[2]).alias("x"), apart(a[1], b[1], a[3], b[3]).alias("y"))
