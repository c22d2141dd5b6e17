"""Kernels of packed rasters against the window form over pixels, plain loops, and at the size of a page."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.functions import boxes
from vellumetry.operators import packed, rasters


def px(spark, a):
    rows = [(1, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "raster_id long, y int, x int, v int")


def grid(df, shape, column):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def test_kernels_equal_windows(spark):
    a = np.random.default_rng(3).integers(0, 256, (9, 13)).astype(float)
    df = px(spark, a)
    assert (grid(rasters.sauvola(df, 2, 0.3, 128.0), a.shape, "ink") == packed.sauvola(a, 2, 0.3)).all()
    assert (grid(rasters.opened(df, 2, 1), a.shape, "v") == packed.extreme(packed.extreme(a, 1, 2, False), 1, 2, True)).all()
    assert (grid(rasters.sobel(df), a.shape, "gy") == packed.sobel(a)[1]).all()


@pytest.mark.parametrize("height,width", [(5, 7), (30, 4), (12, 40), (20, 20), (1, 1)])
def test_resize_keeps_a_flat_image_and_its_mean(height, width):
    assert (packed.resized(np.full((20, 20), 77.0), height, width) == 77).all()
    a = np.random.default_rng(1).integers(0, 256, (20, 20)).astype(float)
    assert packed.resized(a, height, width).shape == (height, width)
    assert abs(packed.resized(a, 5, 5).mean() - a.mean()) < 1


def test_distance_of_a_disc_and_of_full_masks():
    mask = np.ones((7, 9), bool)
    assert (packed.distance(mask) == 1e9 / 3).all()
    mask[3, 4] = False
    d = packed.distance(mask)
    assert d[3, 4] == 0 and d[3, 5] == 1 and d[2, 5] == pytest.approx(4 / 3) and d[0, 0] == pytest.approx((4 * 3 + 3) / 3)


def test_a_whole_page(spark):
    rng = np.random.default_rng(7)
    page = np.clip(230 - np.linspace(0, 90, 1240)[None, :] + rng.normal(0, 3, (1754, 1240)), 0, 255).round()
    page[500:503, 100:1100] = 20  # a rule
    page[800:830, 400:404] = 15  # a stroke
    df = spark.createDataFrame([(5, 1240, 1754, page.astype(int).ravel().tolist())], "raster_id long, width int, height int, values array<int>")
    out = packed.mapped(df, lambda a: {k: v for k, v in packed.document_ink(a).items() if k == "ink"}, "ink array<int>")
    assert "Exchange" not in out._jdf.queryExecution().toString()
    r = out.first()
    ink = np.array(r.ink).reshape(r.height, r.width)
    assert ink[501, 200:1000].all() and ink[810:820, 401].all() and ink.mean() < 0.02
    assert not (packed.rules(ink > 0, 250)[800:830, 400:404]).any() and packed.rules(ink > 0, 250)[501, 600]


def test_boxes_of_infinite_or_no_size(spark):
    one = spark.range(1)
    n = lambda v: F.lit(float(v))
    got = one.select(
        boxes.normalized(n("inf"), n(1), n(2), n(3), n(10), n(10)).alias("a"), boxes.normalized(n(1200), n(0), n(2000), n(1100), n(0), n(0)).alias("b"), boxes.bounds(F.array().cast("array<struct<x:double,y:double>>")).alias("c"),
        boxes.normalized(n("nan"), n(1), n(2), n(3), n(10), n(10)).alias("d"),
    ).first()
    assert got.a is None and got.b is None and got.c is None and got.d is None
