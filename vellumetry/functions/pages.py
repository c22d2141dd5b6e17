"""Millimetres of the page, pixels, projective maps and lines, as column expressions.  Boxes are (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumetry.functions.boxes import rect, round_half_up

#: Dots per inch of the page raster, of details and of what is delivered; paper and photo sizes (mm).  Fixed values.
PAGE_DPI, DETAIL_DPI, OUT_DPI, MM_PER_INCH = 200, 300, 300, 25.4
A4 = (210.0, 297.0)
PAGE_SIZES = {"A4": A4, "A5": (148.0, 210.0), "LETTER": (215.9, 279.4), "LEGAL": (215.9, 355.6), "FOOLSCAP": (215.9, 330.2)}


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is mentioned: as the element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def to_pixels(mm: Column, dpi: int = PAGE_DPI) -> Column:
    return mm * (dpi / MM_PER_INCH)


def to_mm(pixels: Column, dpi: int = PAGE_DPI) -> Column:
    return pixels / (dpi / MM_PER_INCH)


def pixel_size(w: Column, h: Column, dpi: int = PAGE_DPI) -> Column:
    """Whole pixels of a size in millimetres."""
    return F.struct(round_half_up(to_pixels(w, dpi)).cast("long").alias("w"), round_half_up(to_pixels(h, dpi)).cast("long").alias("h"))


def expanded(x: Column, y: Column, w: Column, h: Column, least: float, share: float) -> Column:
    """Grown on each side by a share of the size, by `least` at least."""
    px, py = F.greatest(F.lit(least), w * share), F.greatest(F.lit(least), h * share)
    return rect(x - px, y - py, w + px * 2, h + py * 2)


def on_page(box: Column, page: tuple[float, float]) -> Column:
    """Clipped to the page, without rounding."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(most), v))
    x, y = inside(box["x"], page[0]), inside(box["y"], page[1])
    right, bottom = F.greatest(x, inside(box["x"] + box["w"], page[0])), F.greatest(y, inside(box["y"] + box["h"], page[1]))
    return rect(x, y, right - x, bottom - y)


def sides(q: Column) -> Column:
    """Lengths of a quad's sides (an array of four points): top, right, bottom, left."""
    return F.array(*(F.hypot(q[a]["x"] - q[b]["x"], q[a]["y"] - q[b]["y"]) for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))))


def output_size(q: Column, most: int = 2400) -> Column:
    """Whole pixels (w, h) that a quad is taken to: the longer of each pair of sides, shrunk to `most` at the longest."""
    top, right, bottom, left = (sides(q)[k] for k in range(4))
    w, h = F.greatest(top, bottom), F.greatest(left, right)
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    return F.struct(F.greatest(F.lit(1), round_half_up(w * scale)).cast("int").alias("w"), F.greatest(F.lit(1), round_half_up(h * scale)).cast("int").alias("h"))


def quad_of_lines(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The corners in which four lines meet, clockwise from the top left; null if neighbours are parallel."""
    points = [crossing(left, top), crossing(right, top), crossing(right, bottom), crossing(left, bottom)]
    whole = F.lit(True)
    for p in points:
        whole &= p.isNotNull()
    return F.when(whole, F.array(*points))


def rotation(q: Column) -> Column:
    """Degrees: the mean of the angles of the top and the bottom side."""
    along = lambda a, b: F.atan2(q[b]["y"] - q[a]["y"], q[b]["x"] - q[a]["x"])
    return F.degrees((along(0, 1) + along(3, 2)) / 2)


def inverse(m: Column) -> Column:
    """Of a 3 x 3 matrix, row by row: the adjugate over the determinant; null if that is below 1e-15."""
    minor = lambda a, b, c, d: m[a] * m[b] - m[c] * m[d]
    adjugate = F.array(minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3))
    over = lambda q, det: F.when(F.abs(det) >= 1e-15, F.transform(q, lambda a: a / det))
    return bound(adjugate, lambda q: bound(m[0] * q[0] + m[1] * q[3] + m[2] * q[6], lambda det: over(q, det)))


def product(a: Column, b: Column) -> Column:
    return F.array(*(a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)))


def through(m: Column, x: Column, y: Column) -> Column:
    """A point through a homography held in a column; the origin where it goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    flat = F.abs(w) < 1e-12
    safe = F.when(flat, 1.0).otherwise(w)
    return F.struct(F.when(flat, 0.0).otherwise((m[0] * x + m[1] * y + m[2]) / safe).alias("x"), F.when(flat, 0.0).otherwise((m[3] * x + m[4] * y + m[5]) / safe).alias("y"))


def effective_dpi(to_page: Column, page: tuple[float, float] = A4) -> Column:
    """Dots per inch of paper in the original: how far ten millimetres across the page's middle reach there."""
    return dpi_through(inverse(to_page), page)


def dpi_through(back: Column, page: tuple[float, float] = A4) -> Column:
    """effective_dpi() from the map back to the original.  It is mentioned many times: better a column than an expression."""
    y = to_pixels(F.lit(page[1] / 2))
    a, b = (through(back, to_pixels(F.lit(page[0] / 2 + d)), y) for d in (-5, 5))
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / 10 * MM_PER_INCH


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The line a x + b y + c = 0 with a unit normal; null through one point."""
    dx, dy = x2 - x1, y2 - y1
    n = F.hypot(dx, dy)
    a, b = -dy / n, dx / n
    return F.when(n >= 1e-9, F.struct(a.alias("a"), b.alias("b"), (-(a * x1 + b * y1)).alias("c")))


def crossing(p: Column, q: Column) -> Column:
    """Where two lines meet; null if they are parallel."""
    d = p["a"] * q["b"] - q["a"] * p["b"]
    return F.when(F.abs(d) >= 1e-9, F.struct(((p["b"] * q["c"] - q["b"] * p["c"]) / d).alias("x"), ((q["a"] * p["c"] - p["a"] * q["c"]) / d).alias("y")))


def line_angle(line: Column) -> Column:
    """Degrees from 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(-line["a"], line["b"])), F.lit(180.0))


def angle_between(a: Column, b: Column) -> Column:
    apart = F.abs(a - b) % 180
    return F.least(apart, 180 - apart)


def fitted_line(x: Column, y: Column) -> Column:
    """An aggregate: the line of least perpendicular distances, from the moments of a group's points; null below two."""
    n, mx, my = F.count(x), F.avg(x), F.avg(y)
    sxx, syy, sxy = F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n
    b = (sxx + syy - F.sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2 - sxx
    norm = F.hypot(sxy, b)
    level = F.when(sxx >= syy, 0.0).otherwise(1.0)
    na, nb = F.when(norm < 1e-12, level).otherwise(sxy / norm), F.when(norm < 1e-12, 1 - level).otherwise(b / norm)
    return F.when(n >= 2, F.struct(na.alias("a"), nb.alias("b"), (-(na * mx + nb * my)).alias("c")))


def polygon_area(points: Column) -> Column:
    """Of a closed polygon, from an array of its corners in order."""

    def area(q: Column) -> Column:
        following = F.concat(F.slice(q, 2, F.size(q)), F.slice(q, 1, 1))
        crossed = F.zip_with(q, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.abs(F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v)) / 2

    return bound(points, area)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest point of a segment, which may be a single point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length >= 1e-12, length))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))
