"""Raster operators on packed rasters: raster_id, width, height, values (row by row), one row a raster.

A raster is one row from its source on, so each operator is a narrow map with an array kernel: no pixel meets a shuffle.
Box sums are differences of prefix sums, so their cost doesn't grow with the box.  Kernels take and give two-dimensional
arrays; what is stored as bytes is rounded half to even and clamped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], dict[str, np.ndarray]]


def mapped(rasters: DataFrame, kernel: Kernel, layers: str) -> DataFrame:
    """raster_id, width, height and the layers (DDL of arrays) that kernel makes of each raster; the size is theirs."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(layers)
    schema = StructType([rasters.schema["raster_id"]] + StructType.fromDDL("width int, height int").fields + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        for batch in batches:
            for k in range(len(batch)):  # a raster a batch: a scan may have millions of pixels
                one = batch.slice(k, 1)
                h, w = one.column("height")[0].as_py(), one.column("width")[0].as_py()
                image = one.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(h, w)
                found = kernel(image)
                shape = next(iter(found.values())).shape
                columns = [one.column("raster_id"), pa.array([shape[1]], pa.int32()), pa.array([shape[0]], pa.int32())]
                for f, t in zip(made.fields, types[3:], strict=True):
                    flat = pa.array(np.ascontiguousarray(found[f.name]).reshape(-1)).cast(t.value_type)
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat).cast(t))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, t) for n, t in zip(schema.fieldNames(), types, strict=True)]))

    return rasters.select("raster_id", "width", "height", "values").mapInArrow(run, schema)


def pixels(rasters: DataFrame, *layers: str) -> DataFrame:
    """raster_id, y, x and the layers, a row a pixel; narrow."""
    each = rasters.select("raster_id", "width", F.posexplode(F.arrays_zip(*layers)).alias("p", "v"))
    at = [F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x")]
    return each.select("raster_id", *at, *(F.col(f"v.{c}").alias(c) for c in layers))


def stored(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.nan_to_num(a)), 0, 255)


def box_sum(a: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Sums over boxes cut at the border."""
    for axis, r in ((0, ry), (1, rx)):
        n = a.shape[axis]
        up = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
        at = np.arange(n)
        a = up.take(np.minimum(n, at + r + 1), axis) - up.take(np.maximum(0, at - r), axis)
    return a


def box_stats(a: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and variance (population, 0 at least) of the box of radius r around each pixel."""
    n = box_sum(np.ones_like(a), r, r)
    mean = box_sum(a, r, r) / n
    return n, mean, np.maximum(0, box_sum(a * a, r, r) / n - mean * mean)


def sauvola(a: np.ndarray, r: int, k: float, spread: float = 128.0) -> np.ndarray:
    _, mean, variance = box_stats(a, r)
    return a <= mean * (1 + k * (np.sqrt(variance) / spread - 1))


def adaptive_mean(a: np.ndarray, r: int, offset: float) -> np.ndarray:
    return a <= box_stats(a, r)[1] - offset


def extreme(a: np.ndarray, ry: int, rx: int, largest: bool) -> np.ndarray:
    """The greatest or least value of each box, by doubling spans: about log2(r) passes."""
    f, edge = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    for axis, r in ((0, ry), (1, rx)):
        length, span = 2 * r + 1, 1
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        x = np.pad(a, pad, constant_values=edge)
        cut = lambda v, begin, end: v[begin:end] if axis == 0 else v[:, begin:end]  # noqa: B023, E731
        while 2 * span <= length:
            x = f(cut(x, 0, x.shape[axis] - span), cut(x, span, x.shape[axis]))
            span *= 2
        n = a.shape[axis]
        a = f(cut(x, 0, n), cut(x, length - span, length - span + n))
    return a


def rules(mask: np.ndarray, least_length: int, thickness: int = 1) -> np.ndarray:
    """Long straight runs of a mask, horizontal or vertical, grown by the thickness."""
    half, thick = max(1, least_length // 2), max(0, thickness)
    m = mask.astype(float)
    flat = extreme(extreme(m, 0, half, False), thick, half, True)
    tall = extreme(extreme(m, half, 0, False), half, thick, True)
    return (flat > 0) | (tall > 0)


def _shares(n: int, to: int) -> np.ndarray:
    """A row for each target pixel: how much each source pixel counts.  By covered area when shrinking, else by the two
    nearest centres."""
    scale, t, s = n / to, np.arange(to)[:, None], np.arange(n)[None, :]
    if to < n:
        w = np.maximum(0, np.minimum(s + 1, (t + 1) * scale) - np.maximum(s, t * scale))
        return w / w.sum(1, keepdims=True)
    at = np.clip((t + 0.5) * scale - 0.5, 0, n - 1)
    low = np.floor(at)
    return (s == low) * (1 - (at - low)) + (s == np.minimum(n - 1, low + 1)) * (at - low)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Shrinking by covered area, growing bilinearly; mixed directions shrink first and store in between."""
    h, w = a.shape
    steps = [(min(h, height), min(w, width)), (height, width)] if (width < w) != (height < h) else [(height, width)]
    for to_h, to_w in steps:
        if a.shape != (to_h, to_w):
            a = stored(np.round(_shares(a.shape[0], to_h) @ a @ _shares(a.shape[1], to_w).T, 9))
    return a


def _rounded(x: float) -> int:
    return int(np.floor(x + 0.5))


def illumination(a: np.ndarray, grid: int = 32) -> np.ndarray:
    h, w = a.shape
    return resized(resized(a, max(1, _rounded(h / grid)), max(1, _rounded(w / grid))), h, w)


def flattened(a: np.ndarray, grid: int = 32, target: float = 220.0) -> np.ndarray:
    """The illumination divided out; where it is nearly black the pixel stays."""
    base = illumination(a, grid)
    return np.where(base < 16, a, stored(a * target / np.maximum(base, 1)))


def document_ink(a: np.ndarray, share: float = 1 / 40, k: float = 0.25, offset: float = 12.0, grid: int = 32) -> dict[str, np.ndarray]:
    """Ink of a flattened page: what either of two local thresholds takes.  The box grows with the page."""
    flat = flattened(a, grid)
    r = max(15, _rounded(min(a.shape) * share) | 1) // 2
    return {"ink": sauvola(flat, r, k) | adaptive_mean(flat, r, offset), "flat": flat}


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (3 along, 4 across, divided by 3) of each set pixel to the nearest clear one; 1e9 / 3 if none.  A row
    takes the better of the row before and, by a running minimum, of its own pixels on one side."""
    h, w = mask.shape
    out = np.where(mask, 1e9, 0.0)
    steps = 3.0 * np.arange(w)
    for turn in (slice(None), slice(None, None, -1)):
        d = out[turn, turn]
        for y in range(h):
            row = d[y]
            if y:
                up = np.pad(d[y - 1], 1, constant_values=np.inf)
                row = np.minimum(row, np.minimum(up[1:-1] + 3, np.minimum(up[:-2], up[2:]) + 4))
            d[y] = np.minimum.accumulate(row - steps) + steps
    return np.minimum(out, 1e9) / 3


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(a, 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def edge_support(magnitude: np.ndarray, x: float, y: float, w: float, h: float, least: float = 60.0) -> float:
    """The share of a box's outline within two pixels of a strong edge, looked for across the outline."""
    rows, cols = magnitude.shape
    x0, y0 = max(0, _rounded(x)), max(0, _rounded(y))
    x1, y1 = min(cols - 1, _rounded(x + w)), min(rows - 1, _rounded(y + h))
    if x1 <= x0 or y1 <= y0:
        return 0.0
    across, along = extreme(magnitude, 2, 0, True), extreme(magnitude, 0, 2, True)
    sides = [across[y0, x0 : x1 + 1], across[y1, x0 : x1 + 1], along[y0 : y1 + 1, x0], along[y0 : y1 + 1, x1]]
    return float(np.mean(np.concatenate(sides) >= least))


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples, clamped at the border."""
    h, w = a.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(w - 1, x0 + 1), np.minimum(h - 1, y0 + 1), x - x0, y - y0
    top, low = a[y0, x0] * (1 - fx) + a[y0, x1] * fx, a[y1, x0] * (1 - fx) + a[y1, x1] * fx
    return top * (1 - fy) + low * fy


def warped(a: np.ndarray, to_source: list[float], height: int, width: int) -> np.ndarray:
    """Each target pixel's sample at the place to which a homography takes it; 0 outside the source."""
    m = np.array(to_source, float).reshape(3, 3)
    y, x = np.mgrid[0:height, 0:width].astype(float)
    den = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    flat = np.abs(den) < 1e-12
    den = np.where(flat, 1, den)
    sx, sy = (np.where(flat, 0, (m[k, 0] * x + m[k, 1] * y + m[k, 2]) / den) for k in (0, 1))
    outside = flat | (sx < 0) | (sy < 0) | (sx > a.shape[1] - 1) | (sy > a.shape[0] - 1)
    return np.where(outside, 0, stored(np.round(sampled(a, sx, sy), 9)))


def stroke_widths(mask: np.ndarray) -> dict[str, np.ndarray]:
    """Median, spread around it, their ratio and number of the widths at the ridges of the distance, borders left out."""
    d = distance(mask)
    c = d[1:-1, 1:-1]
    ridge = (c >= d[1:-1, :-2]) & (c >= d[1:-1, 2:]) | (c >= d[:-2, 1:-1]) & (c >= d[2:, 1:-1])
    w = np.sort(2 * c[ridge & (c >= 0.8)])
    median = float(w[len(w) // 2]) if len(w) else 0.0
    spread = float(np.sqrt(((w - median) ** 2).mean())) if len(w) else 0.0
    return {"median": np.array([[median]]), "spread": np.array([[spread]]), "variation": np.array([[spread / median if median > 0 else 0.0]]), "samples": np.array([[len(w)]])}


def tone_spread(a: np.ndarray) -> float:
    """How densely the tones between the 2nd and the 98th percentile are taken, less for a narrow range."""
    bins = np.bincount(a.astype(np.int64).ravel(), minlength=256)
    below, n = bins.cumsum(), a.size
    low, high = (int(np.searchsorted(below, n * f)) for f in (0.02, 0.98))
    return float((bins[low : high + 1] > n * 0.002).mean() * min(1, (high - low) / 64)) if high > low else 0.0


def textured(a: np.ndarray, least_variance: float, window: int = 9) -> float:
    """The share of windows, half a window apart, whose variance is above the paper's."""
    half = max(1, window // 2)
    h, w = a.shape
    if h < window or w < window:
        return 0.0
    variance = box_stats(a, half)[2][half : h - half : half, half : w - half : half]
    return float((variance > least_variance).mean()) if variance.size else 0.0
