"""Printed structure of a page: how far it is turned, its lines of type, and whether it is a form at all.

Ink is a relation of pixels (raster_id, y, x), components are rows (raster_id, label, x, y, w, h)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.functions.boxes import round_half_up

#: A page of less ink isn't turned, and the sizes of type, in millimetres.  Fixed values.
LEAST_INK = 200
CAPTIONS = {"height": 2.5, "width": 4.0, "glyphs": 5, "tolerance": 1.0, "gap": 3.0, "span": 10.0}
LABELS = CAPTIONS | {"height": 5.0, "width": 6.0, "glyphs": 4, "span": 8.0}
UNEVEN, LEAST_LINES, LEAST_RULES = 0.45, 3, 3


def _table(rows: list) -> Column:
    """Numbers as one constant: a literal for each would be thousands of expressions to plan."""
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def _turns(angles: list[list[float]], k: Column) -> Column:
    """Number, sine and cosine of the k-th list of angles in degrees, as an array."""
    sines, cosines = (F.get(_table([[f(math.radians(a)) for a in row] for row in angles]), k) for f in (math.sin, math.cos))
    return F.transform(F.arrays_zip(sines.alias("s"), cosines.alias("c")), lambda t, i: F.struct(i.alias("k"), t["s"].alias("s"), t["c"].alias("c")))


def _scores(ink: DataFrame, sizes: DataFrame, turns: Column) -> DataFrame:
    """raster_id, scores: for each turn (k, s, c) how much the rows' ink varies after it, rows without ink included, as a
    whole number: (rows) * sum of squares - square of the sum."""
    cx, cy = F.col("width") / 2, F.col("height") / 2
    voted = ink.join(sizes, "raster_id").select("raster_id", "height", "x", "y", "width", F.explode(turns).alias("t"))
    row = round_half_up(-(F.col("x") - cx) * F.col("t.s") + (F.col("y") - cy) * F.col("t.c") + cy)
    rows = voted.select("raster_id", "height", F.col("t.k").alias("k"), row.cast("long").alias("row")).where("row >= 0 and row <= height")
    profile = rows.groupBy("raster_id", "height", "k", "row").agg(F.count("*").alias("n"))
    each = profile.groupBy("raster_id", "height", "k").agg(F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("n").alias("s"))
    score = (F.col("height") + 1).cast("decimal(10,0)") * F.col("q").cast("decimal(18,0)") - F.col("s").cast("decimal(18,0)") * F.col("s").cast("decimal(18,0)")
    return each.groupBy("raster_id").agg(F.map_from_entries(F.collect_list(F.struct("k", score.cast("decimal(38,0)").alias("score")))).alias("scores"))


def fine_angles(coarse: int, steps: int) -> list[float]:
    """The angles tried around a whole one: a tenth of a degree added again and again, with what that rounds to."""
    out = [float(coarse - 1)]
    while len(out) < steps:
        out.append(out[-1] + 0.1)
    return out


def skew(ink: DataFrame, sizes: DataFrame, most: int = 8, steps: int = 41) -> DataFrame:
    """raster_id, degrees of every raster of sizes (raster_id, width, height): the turn after which the rows of ink vary most.

    Whole degrees vote first, then tenths from a degree below the winner on, up to a degree above the best so far: that
    end moves as better angles come.  `steps` tenths are voted on at once; a raster whose end moves past them goes on with
    twice as many.  The first of equal angles counts.  Under LEAST_INK pixels, or beyond `most`, it is 0."""
    dark = ink.groupBy("raster_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_INK).select("raster_id")
    used = ink.join(dark, "raster_id", "left_semi")
    whole = list(range(-most, most + 1))
    coarse = _scores(used, sizes, _turns([whole], F.lit(0)))
    ranked = F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"].alias("score"), (-e["key"]).alias("back")))
    coarse = coarse.select("raster_id", F.array_max(ranked).alias("b")).select("raster_id", (-F.col("b.back")).alias("k"), F.col("b.score").alias("best"))
    found, end = None, None
    while True:
        fine = [fine_angles(a, steps) for a in whole]
        scored = _scores(used.join(coarse.select("raster_id", "k") if end is None else end, "raster_id"), sizes, _turns(fine, F.col("k")))
        rows = scored.join(coarse, "raster_id").select("raster_id", "k", "scores", "best", F.get(_table(fine), F.col("k")).alias("angles"))
        state = F.struct((F.col("k") - most).cast("double").alias("angle"), F.col("best").alias("score"), F.lit(False).alias("over"))

        def step(s: Column, i: Column) -> Column:
            d, v = F.get("angles", i), F.coalesce(F.try_element_at("scores", i), F.lit(0).cast("decimal(38,0)"))
            over = s["over"] | (d > s["angle"] + 1)
            better = ~over & (v > s["score"])
            return F.struct(F.when(better, d).otherwise(s["angle"]).alias("angle"), F.when(better, v).otherwise(s["score"]).alias("score"), over.alias("over"))

        rows = rows.withColumn("s", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), state, step))
        done = rows.select("raster_id", "k", "s.angle", (F.col("s.over") | (F.get("angles", F.lit(steps - 1)) + 0.1 > F.col("s.angle") + 1)).alias("done")).persist()  # a few numbers a raster
        part = done.where("done").select("raster_id", "angle")
        found = part if found is None else found.union(part)
        end = done.where("not done").select("raster_id", "k")
        if steps > 10 * (2 * most + 3) or end.isEmpty():
            break
        steps *= 2
    angle = F.when(F.abs("angle") > most, 0.0).otherwise(F.round("angle", 2))
    return sizes.select("raster_id").join(found, "raster_id", "left").select("raster_id", F.coalesce(angle, F.lit(0.0)).alias("degrees"))


def text_runs(components: DataFrame, pixels_per_mm: float, of: dict = CAPTIONS) -> DataFrame:
    """raster_id, bucket, run and the glyph (label, x, y, w, h): small components that stand on one baseline, close by and evenly high.

    Baselines come in the order of labels; each opens a bucket unless one opened before lies within the tolerance, the
    first of which it joins.  Which buckets there are is a fold over a raster's different baselines, at most its height;
    runs are then gaps and islands of each bucket's glyphs from left to right."""
    px = pixels_per_mm
    glyphs = components.where((F.col("h") <= of["height"] * px) & (F.col("w") <= of["width"] * px)).withColumn("base", F.col("y") + F.col("h"))
    near = lambda a, b: F.abs(a - b) <= of["tolerance"] * px
    firsts = glyphs.groupBy("raster_id", "base").agg(F.min("label").alias("label"))
    in_order = firsts.groupBy("raster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "base"))), lambda s: s["base"]).alias("bases"))
    none = F.filter("bases", lambda _: F.lit(False))
    opened = F.aggregate("bases", none, lambda keys, b: F.when(F.exists(keys, lambda k: near(k, b)), keys).otherwise(F.concat(keys, F.array(b))))
    placed = firsts.join(in_order.select("raster_id", opened.alias("keys")), "raster_id")
    bucket = F.array_position(F.transform("keys", lambda k: near(k, F.col("base"))), True)
    placed = glyphs.join(placed.select("raster_id", "base", bucket.alias("bucket")), ["raster_id", "base"])

    row = Window.partitionBy("raster_id", "bucket").orderBy("x", "label", "w", "h")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(row)
    cut = placed.withColumn("_new", (gap > of["gap"] * px).cast("int"))
    runs = cut.withColumn("run", F.sum(F.coalesce("_new", F.lit(0))).over(row))
    ends = F.max(F.struct("x", "label", (F.col("x") + F.col("w")).alias("right")))
    figures = runs.groupBy("raster_id", "bucket", "run").agg(F.count("*").alias("_n"), (ends["right"] - F.min("x")).alias("_span"), F.avg("h").alias("_mean"), F.stddev_pop("h").alias("_dev"))
    kept = figures.where((F.col("_n") >= of["glyphs"]) & (F.col("_span") >= of["span"] * px) & ~((F.col("_mean") > 0) & (F.col("_dev") / F.col("_mean") > UNEVEN)))
    return runs.join(kept.select("raster_id", "bucket", "run"), ["raster_id", "bucket", "run"]).select("raster_id", "bucket", "run", "label", "x", "y", "w", "h")


def without_captions(components: DataFrame, pixels_per_mm: float) -> DataFrame:
    """The components that belong to no line of small type."""
    return components.join(text_runs(components, pixels_per_mm).select("raster_id", "label"), ["raster_id", "label"], "left_anti")


def presence(sizes: DataFrame, ink: DataFrame, rules: DataFrame, pixels_per_mm: float) -> DataFrame:
    """raster_id, text_lines, rules, recognised, detail of every raster of sizes.  ink and rules: components with their area; small
    ones don't count."""
    px = pixels_per_mm * pixels_per_mm
    least = lambda floor, mm2: max(floor, int(mm2 * px + 0.5))
    lines = text_runs(ink.where(F.col("area") >= least(2, 0.15)), pixels_per_mm, LABELS).groupBy("raster_id").agg(F.count_distinct("bucket", "run").alias("text_lines"))
    ruled = rules.where(F.col("area") >= least(4, 3.0)).groupBy("raster_id").agg(F.count("*").alias("rules"))
    out = sizes.select("raster_id").join(lines, "raster_id", "left").join(ruled, "raster_id", "left")
    t, r = F.coalesce("text_lines", F.lit(0).cast("long")), F.coalesce("rules", F.lit(0).cast("long"))
    out = out.select("raster_id", t.alias("text_lines"), r.alias("rules")).withColumn("recognised", (t >= LEAST_LINES) | (r >= LEAST_RULES))
    lines_of, rules_of = F.concat(F.col("text_lines"), F.lit(" line"), F.when(F.col("text_lines") == 1, "").otherwise("s")), F.concat(F.col("rules"), F.lit(" printed rule"), F.when(F.col("rules") == 1, "").otherwise("s"))
    detail = (
        F.when(F.col("recognised"), F.concat(F.col("text_lines"), F.lit(" lines of printed text and "), F.col("rules"), F.lit(" printed rules were found")))
        .when((F.col("text_lines") == 0) & (F.col("rules") == 0), "no printed text or ruled lines were found anywhere on this image, so it does not appear to be a form")
        .otherwise(F.concat(F.lit("only "), lines_of, F.lit(" of printed text and "), rules_of, F.lit(" were found, which is too little printed structure to locate this form's fields")))
    )
    return out.withColumn("detail", detail)
