"""Raster operators over the pixel relation (raster_id, y, x, v).

Local operators are window frames along x, then along y: frames are cut at the raster's border, which is the clamped
box rule.  Both windows hash by the raster, so after the first shuffle the second needs none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along_x(r: int) -> Window:
    return Window.partitionBy("raster_id", "y").orderBy("x").rowsBetween(-r, r)


def _along_y(r: int) -> Window:
    return Window.partitionBy("raster_id", "x").orderBy("y").rowsBetween(-r, r)


def by_raster(px: DataFrame) -> DataFrame:
    """Deal out by raster once, so that the windows along rows and columns share the partitioning."""
    return px.repartition("raster_id")


def box_stats(px: DataFrame, r: int, value: str = "v") -> DataFrame:
    """Add n, mean and variance (population, 0 at least) of the box of radius r around each pixel."""
    v = F.col(value).cast("double")
    rows = by_raster(px).withColumns({"_s": F.sum(v).over(_along_x(r)), "_q": F.sum(v * v).over(_along_x(r)), "_n": F.count(v).over(_along_x(r))})
    rows = rows.withColumns({"_s": F.sum("_s").over(_along_y(r)), "_q": F.sum("_q").over(_along_y(r)), "n": F.sum("_n").over(_along_y(r))})
    mean = F.col("_s") / F.col("n")
    return rows.withColumns({"mean": mean, "variance": F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mean * mean)}).drop("_s", "_q", "_n")


def sauvola(px: DataFrame, r: int, k: float, spread: float) -> DataFrame:
    """ink: v <= mean * (1 + k * (deviation / spread - 1))."""
    cut = F.col("mean") * (1 + k * (F.sqrt("variance") / spread - 1))
    return box_stats(px, r).withColumn("ink", (F.col("v") <= cut).cast("int"))


def adaptive_mean(px: DataFrame, r: int, offset: float) -> DataFrame:
    return box_stats(px, r).withColumn("ink", (F.col("v") <= F.col("mean") - offset).cast("int"))


def _extreme(px: DataFrame, f, rx: int, ry: int, value: str) -> DataFrame:
    return px.withColumn(value, f(value).over(_along_x(rx))).withColumn(value, f(value).over(_along_y(ry)))


def dilate(px: DataFrame, rx: int, ry: int | None = None, value: str = "v") -> DataFrame:
    return _extreme(by_raster(px), F.max, rx, rx if ry is None else ry, value)


def erode(px: DataFrame, rx: int, ry: int | None = None, value: str = "v") -> DataFrame:
    return _extreme(by_raster(px), F.min, rx, rx if ry is None else ry, value)


def opened(px: DataFrame, rx: int, ry: int | None = None, value: str = "v") -> DataFrame:
    ry = rx if ry is None else ry
    return _extreme(_extreme(by_raster(px), F.min, rx, ry, value), F.max, rx, ry, value)


def closed(px: DataFrame, rx: int, ry: int | None = None, value: str = "v") -> DataFrame:
    ry = rx if ry is None else ry
    return _extreme(_extreme(by_raster(px), F.max, rx, ry, value), F.min, rx, ry, value)


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("raster_id", "v").agg(F.count("*").alias("n"))


def percentile(px: DataFrame, share: float) -> DataFrame:
    """The first value at which the cumulative count reaches the share of all pixels; 255 if none does."""
    h = histogram(px)
    w = Window.partitionBy("raster_id")
    cumulated = h.withColumns({"below": F.sum("n").over(w.orderBy("v")), "total": F.sum("n").over(w)})
    hit = F.when(F.col("below") >= share * F.col("total"), F.col("v"))
    return cumulated.groupBy("raster_id").agg((F.lit(0) if share <= 0 else F.coalesce(F.min(hit), F.lit(255))).alias("value"))


def otsu(px: DataFrame) -> DataFrame:
    """The threshold of the greatest between-class variance; the first one wins a tie."""
    w = Window.partitionBy("raster_id")
    h = histogram(px).withColumn("sv", F.col("n") * F.col("v"))
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"n0": F.sum("n").over(up), "s0": F.sum("sv").over(up), "nn": F.sum("n").over(w), "ss": F.sum("sv").over(w)})
    n1 = F.col("nn") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("ss") - F.col("s0")) / n1
    between = F.when(n1 > 0, F.col("n0").cast("double") * n1 * apart * apart)
    best = F.max_by("v", F.when(between > 0, F.struct(F.round(between, 6), -F.col("v"))))
    return h.groupBy("raster_id").agg(F.coalesce(best, F.lit(0)).alias("threshold"))


def integral(px: DataFrame) -> DataFrame:
    """Inclusive two-dimensional prefix sums."""
    up_x = Window.partitionBy("raster_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    up_y = Window.partitionBy("raster_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return by_raster(px).withColumn("s", F.sum("v").over(up_x)).withColumn("s", F.sum("s").over(up_y))


def sobel(px: DataFrame) -> DataFrame:
    """gx and gy by separable kernels with replicated borders, and the magnitude."""
    wx, wy = Window.partitionBy("raster_id", "y").orderBy("x"), Window.partitionBy("raster_id", "x").orderBy("y")
    before = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c))
    after = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    rows = by_raster(px).withColumns({"dx": after("v", wx) - before("v", wx), "bx": before("v", wx) + 2 * F.col("v") + after("v", wx)})
    rows = rows.withColumns({"gx": before("dx", wy) + 2 * F.col("dx") + after("dx", wy), "gy": after("bx", wy) - before("bx", wy)})
    return rows.withColumn("magnitude", F.hypot("gx", "gy")).drop("dx", "bx")


def high_frequency(px: DataFrame, inner: int = 1, outer: int = 4) -> DataFrame:
    """How far a pixel lies from its near box's mean, stored, then the mean of that over a wide box, stored."""
    near = box_stats(px, inner).withColumn("d", stored(F.abs(F.col("v") - F.col("mean")))).select("raster_id", "y", "x", "d")
    return box_stats(near, outer, "d").withColumn("energy", stored(F.col("mean"))).select("raster_id", "y", "x", "energy")


def stored(c: Column) -> Column:
    """As a byte: clamped, ties to even, not-a-number as 0."""
    return F.when(F.isnan(c), 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(c)))).cast("int")


def tiles(px: DataFrame, side: int) -> DataFrame:
    """Count, mean and deviation of each tile; tiles cut by the border stay."""
    key = [F.floor(F.col(c) / side).cast("int").alias(f"t{c}") for c in ("y", "x")]
    return px.groupBy("raster_id", *key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def resized(px: DataFrame, from_side: int, to_side: int) -> DataFrame:
    """Area-average shrinking of square rasters: each source pixel counts by how much of a target pixel it covers."""
    scale = from_side / to_side

    def spread(c: str) -> Column:
        first = F.floor(F.col(c) / scale).cast("int")
        last = F.least(F.lit(to_side - 1), (F.ceil((F.col(c) + 1) / scale) - 1).cast("int"))
        cover = lambda t: F.least((t + 1) * scale, F.col(c) + 1.0) - F.greatest(t * scale, F.col(c).cast("double"))
        return F.explode(F.transform(F.sequence(first, F.greatest(first, last)), lambda t: F.struct(t.alias("t"), cover(t).alias("w"))))

    both = px.withColumn("_x", spread("x")).withColumn("_y", spread("y"))
    w = F.col("_x.w") * F.col("_y.w")
    out = both.where(w > 1e-12).groupBy("raster_id", F.col("_y.t").alias("y"), F.col("_x.t").alias("x")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("mean"))
    return out.select("raster_id", "y", "x", stored(F.round("mean", 9)).alias("v"))


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a mask: ids from 1 by raster order of their first pixel, 0 outside.  Least labels spread
    along runs of a row, a column and the diagonals until none changes."""
    h, w = mask.shape
    far = h * w + 1
    lab = np.where(mask, np.arange(1, far).reshape(h, w), far)
    while True:
        ring = np.full((h + 2, w + 2), far)
        ring[1:-1, 1:-1] = lab
        low = np.min([ring[a : a + h, b : b + w] for a in range(3) for b in range(3)], axis=0)
        new = np.where(mask, low, far)
        root = np.append(np.arange(far), far)
        np.minimum.at(root, lab[mask], new[mask])
        while (root != root[root]).any():
            root = root[root]
        new = np.where(mask, root[new], far)
        if (new == lab).all():
            break
        lab = new
    out = np.zeros((h, w), np.int32)
    out[mask] = np.unique(lab[mask], return_inverse=True)[1] + 1
    return out


COMPONENTS = "raster_id long, label int, area long, x int, y int, w int, h int, cx double, cy double, fill double, aspect double"


def component_figures(mask: np.ndarray, least_area: int) -> list[tuple]:
    """A row for each component, numbered again without the small ones, in one pass over the set pixels."""
    y, x = np.nonzero(mask)
    k = labelled(mask)[y, x] - 1
    area = np.bincount(k)
    low, high = (np.full((2, len(area)), fill) for fill in (1 << 30, -1))
    for side, at in enumerate((y, x)):
        np.minimum.at(low[side], k, at)
        np.maximum.at(high[side], k, at)
    (h, w), (top, left) = high - low + 1, low
    cy, cx = np.bincount(k, y) / np.maximum(area, 1), np.bincount(k, x) / np.maximum(area, 1)
    kept = np.flatnonzero(area >= least_area)
    return [(n, int(area[c]), int(left[c]), int(top[c]), int(w[c]), int(h[c]), float(cx[c]), float(cy[c]), float(area[c] / (w[c] * h[c])), float(max(w[c], h[c]) / min(w[c], h[c]))) for n, c in enumerate(kept.tolist(), 1)]


def components(masks: DataFrame, least_area: int = 1) -> DataFrame:
    """Components of the non-zero pixels of packed rasters: bounds, centre, fill of the bounds and aspect, the longer side over the shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                mask = np.array(r["values"], np.int64).reshape(r["height"], r["width"]) > 0
                rows += [(r["raster_id"], *c) for c in component_figures(mask, least_area)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4, *[pa.float64()] * 4)
            columns = list(zip(*rows, strict=True)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in COMPONENTS.split(", ")])

    return masks.select("raster_id", "width", "height", "values").mapInArrow(run, COMPONENTS)


def hue_modes(px: DataFrame, key: list[str], least_chroma: float = 12.0, bins: int = 36, share: float = 0.08) -> DataFrame:
    """Modes of the hues of a region's coloured pixels (a, b, chroma), weighted by chroma: bins no lower than both
    neighbours on the circle that carry the share.  Regions without such pixels have none, and no row."""
    wide = 360 / bins
    hue = F.pmod(F.degrees(F.atan2("b", "a")), F.lit(360.0))
    voting = px.where(F.col("chroma") > least_chroma).withColumn("bin", F.least(F.lit(bins - 1), F.floor(hue / wide)).cast("int"))
    h = voting.groupBy(*key, "bin").agg(F.sum("chroma").alias("weight"))
    # the histogram of a region, at most `bins` rows, as an array: neighbours on the circle need no self-join
    full = h.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"), F.sum("weight").alias("total"))
    at = lambda k: F.coalesce(F.try_element_at("m", F.pmod(k, F.lit(bins))), F.lit(0.0))
    modes = F.filter(F.map_keys("m"), lambda k: (at(k) >= share * F.col("total")) & (at(k) >= at(k - 1)) & (at(k) >= at(k + 1)))
    return full.select(*key, F.size(modes).alias("modes"))
