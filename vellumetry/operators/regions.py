"""Regions of a page: boxes that lie inside or near others, the best of many overlapping boxes, and what paper looks like.

Boxes are rows (set key, id, x, y, w, h).  Boxes meet in cells of a grid: a pair counts in one cell only, that of the greater of
their left ends and of their upper ends, so no pair is met twice.  No set of more than MOST_HELD boxes is held whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from vellumetry.functions import boxes as box
from vellumetry.functions.boxes import round_half_up
from vellumetry.operators import shapes
from vellumetry.sources.settled import settled, unsettled

#: Boxes of a set that a task holds at once.
MOST_HELD = 16_384
#: Overlap from which a later box is a repetition, and how many boxes are kept.  Fixed values.
REPEATED, MOST_KEPT = 0.75, 6
#: Paper of a scan that shows too little of it, and what its figures are at least.  Fixed values.
PESSIMISTIC = {"paper_level": 220.0, "sigma_lightness": 12.0, "sigma_chroma": 8.0, "sigma_texture": 6.0, "variance_p85": 260.0, "texture_level": 8.0, "tiles": 0, "paper_fraction": 0.0}
LEAST_TILES, LEAST_SIGMA, LEAST_VARIANCE, LEAST_TEXTURE = 12, 0.5, 1.0, 0.25
#: Paper around a hint that leaves too few samples.  Fixed values.
PLAIN_PAPER, LEAST_SAMPLES = {"r": 240.0, "g": 240.0, "b": 240.0, "luminance": 240.0, "spread": 4.0}, 16


def _cells(x: Column, y: Column, right: Column, bottom: Column, sx: Column, sy: Column) -> Column:
    """The cells that a closed box touches."""
    at = lambda v, s: F.floor(v / s)
    return F.flatten(F.transform(F.sequence(at(y, sy), at(bottom, sy)), lambda r: F.transform(F.sequence(at(x, sx), at(right, sx)), lambda c: F.struct(r.alias("r"), c.alias("c")))))


def _sides(boxes: DataFrame, key: str, gap_x: float, gap_y: float) -> DataFrame:
    """Sides of each set's cells: about two mean boxes, gaps included.  They are read on both sides of a join, so the sum is of whole
    numbers: one of doubles depends on the order in which rows arrive, and a box on a cell's border would be missed."""
    side = lambda c, gap: F.greatest(F.lit(1e-6), 2 * (F.sum(F.floor(F.col(c) * 2.0**20)) / F.lit(2.0**20) / F.count(c) + gap))
    return boxes.groupBy(key).agg(side("w", gap_x).alias("_sx"), side("h", gap_y).alias("_sy"))


def near_pairs(boxes: DataFrame, key: str, gap_x: float, gap_y: float) -> DataFrame:
    """key, a, b: ids (a < b) of boxes of one set that come within both gaps."""
    grown = boxes.join(_sides(boxes, key, gap_x, gap_y), key).select(key, "id", "x", "y", (F.col("x") + F.col("w") + gap_x).alias("right"), (F.col("y") + F.col("h") + gap_y).alias("bottom"), "_sx", "_sy")
    dealt = grown.select("*", F.explode(_cells(*(F.col(c) for c in ("x", "y", "right", "bottom", "_sx", "_sy")))).alias("cell"))
    dealt = dealt.select(key, "cell.r", "cell.c", "id", "x", "y", "right", "bottom", "_sx", "_sy")
    other = dealt.select(key, "r", "c", *(F.col(n).alias(f"_{n}") for n in ("id", "x", "y", "right", "bottom")))
    met = dealt.join(other, [key, "r", "c"]).where("id < _id and x <= _right and _x <= right and y <= _bottom and _y <= bottom")
    own = met.where((F.floor(F.greatest("x", "_x") / F.col("_sx")) == F.col("c")) & (F.floor(F.greatest("y", "_y") / F.col("_sy")) == F.col("r")))
    return own.select(key, F.col("id").alias("a"), F.col("_id").alias("b"))


def within(boxes: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """key, id, region: boxes that lie wholly inside a region (key, region, x, y, w, h) of their set.  A box is looked for in
    the one cell of its upper left corner."""
    sides = _sides(boxes, key, 0, 0)
    corner = boxes.join(sides, key).select(key, F.floor(F.col("y") / F.col("_sy")).alias("r"), F.floor(F.col("x") / F.col("_sx")).alias("c"), "id", "x", "y", "w", "h")
    large = regions.join(sides, key).select(key, "region", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + F.col("w")).alias("_right"), (F.col("y") + F.col("h")).alias("_bottom"), "_sx", "_sy")
    dealt = large.select("*", F.explode(_cells(*(F.col(c) for c in ("_x", "_y", "_right", "_bottom", "_sx", "_sy")))).alias("cell")).select(key, "cell.r", "cell.c", "region", "_x", "_y", "_right", "_bottom")
    return corner.join(dealt, [key, "r", "c"]).where("x >= _x and y >= _y and x + w <= _right and y + h <= _bottom").select(key, "id", "region")


def near_groups(boxes: DataFrame, key: str, gap_x: float, gap_y: float, most: int = MOST_HELD) -> DataFrame:
    """key, id, group, and the group's joint box (x, y, w, h): boxes within the gaps of each other are one, again and again, as
    a joint box may come near to what neither part was near to.  A group's name is its smallest id.

    Sets of up to `most` boxes are shuffled once and joined each in its task.  Of larger ones, found by counting, no task holds
    one whole: see _near_groups_of_large."""
    boxes = boxes.select(key, "id", *(F.col(c).cast("double").alias(c) for c in "xywh")).where(F.col(key).isNotNull() & F.col("id").isNotNull())
    schema = StructType([boxes.schema[key], boxes.schema["id"], StructField("group", boxes.schema["id"].dataType), *(boxes.schema[c] for c in "xywh")])
    arrow = to_arrow_schema(schema)
    rows_of = lambda part: iter(shapes.near_group_rows(part, key, gap_x, gap_y, arrow).to_batches())
    large = settled(boxes.groupBy(key).count().where(F.col("count") > most).select(key))
    n = large.count()
    if not n:
        return shapes.over_sets(boxes, key, ["id", *"xywh"], rows_of, schema)
    among = F.broadcast(large) if n <= 1_000_000 else large
    held = shapes.over_sets(boxes.join(among, key, "left_anti"), key, ["id", *"xywh"], rows_of, schema)
    return held.union(_near_groups_of_large(boxes.join(among, key, "left_semi"), key, gap_x, gap_y, rows_of, schema))


def _near_groups_of_large(boxes: DataFrame, key: str, gap_x: float, gap_y: float, rows_of, schema: StructType) -> DataFrame:
    """near_groups() of sets too large for a task.  Boxes are dealt out by set and place, and each batch joins its own, which can't
    join too much; the joint boxes go on.

    Each round joins near joint boxes and hands every one the least name that it touches; names are followed to their
    end within the round.  It ends when no two joint boxes are near.  What a round no longer reads is deleted."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    bounds = (F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))

    def run(batches):
        for batch in batches:
            if len(batch):
                yield from rows_of(pa.Table.from_batches([batch]))

    dealt = boxes.groupBy(key, "id").agg(*bounds).repartitionByRange(key, "x", "y").sortWithinPartitions(key, "x", "y")
    member = settled(dealt.mapInArrow(run, schema))
    while True:
        joint = settled(member.groupBy(key, F.col("group").alias("id")).agg(*bounds))
        low = settled(near_pairs(joint, key, gap_x, gap_y).groupBy(key, F.col("b").alias("group")).agg(F.min("a").alias("to")))
        if low.isEmpty():
            whole = joint.select(key, F.col("id").alias("group"), "x", "y", "w", "h")
            named = member.select(key, "id", "group").join(whole, [key, "group"])
            return boxes.select(key, "id").join(named, [key, "id"]).select(key, "id", "group", "x", "y", "w", "h")
        unsettled(joint)
        held = low
        while True:  # names of names
            step = low.join(low.select(key, F.col("group").alias("to"), F.col("to").alias("_next")), [key, "to"], "left")
            step = settled(step.select(key, "group", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
            unsettled(held)
            low, held = step.drop("_moved"), step
            if step.where("_moved").isEmpty():
                break
        new = settled(member.join(low, [key, "group"], "left").select(key, "id", F.coalesce("to", "group").alias("group"), "x", "y", "w", "h"))
        unsettled(member, held)
        member = new


def best_apart(candidates: DataFrame, key: str, order: list[str], most: int = MOST_KEPT, overlap: float = REPEATED) -> DataFrame:
    """key, place (from 1) and the candidate (score, order, x, y, w, h): in order of score, each box that overlaps none kept
    before by more than `overlap` of their union, `most` at most.  order: breaks ties of equal scores."""
    by = F.struct((-F.col("score")).alias("_s"), *order, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")))
    packed = candidates.groupBy(key).agg(F.sort_array(F.collect_list(by)).alias("_all"))
    part = lambda s: tuple(s[c] for c in ("x", "y", "w", "h"))
    step = lambda kept, c: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: box.iou(part(k), part(c)) > overlap), kept).otherwise(F.concat(kept, F.array(c)))
    kept = packed.select(key, F.aggregate("_all", F.filter("_all", lambda _: F.lit(False)), step).alias("_kept"))
    each = kept.select(key, F.posexplode("_kept").alias("_p", "c"))
    return each.select(key, (F.col("_p") + 1).alias("place"), (-F.col("c._s")).alias("score"), *(F.col(f"c.{c}").alias(c) for c in (*order, "x", "y", "w", "h")))


def best_by_merit(measured: DataFrame, key: str, hints: DataFrame, weight: float) -> DataFrame:
    """The row of each key whose confidence plus `weight` times its overlap with the key's hint (x, y, w, h) is greatest, with
    its merit; of equal ones the first place."""
    hint = hints.select(key, F.struct("x", "y", "w", "h").alias("_hint"))
    at = lambda c: F.col(f"_hint.{c}")
    each = measured.join(hint, key)
    merit = F.col("confidence") + weight * box.iou(tuple(F.col(c) for c in ("x", "y", "w", "h")), tuple(at(c) for c in ("x", "y", "w", "h")))
    each = each.withColumn("merit", merit).drop("_hint")
    rest = [c for c in each.columns if c not in (key, "merit", "place")]
    top = each.groupBy(key).agg(F.max(F.struct("merit", (-F.col("place")).alias("_back"), F.struct(*rest).alias("_row"))).alias("_t"))
    return top.select(key, (-F.col("_t._back")).alias("place"), "_t._row.*", F.col("_t.merit").alias("merit"))


def _held(side: DataFrame) -> DataFrame:
    """The side of a join that each task keeps, its own share of it: rows of a raster beside its pixels.  Spark takes pixels made
    from a small file for small and would broadcast them."""
    return side.hint("shuffle_hash")


def _upper(values: Column) -> Column:
    """The upper one of the middle values of an array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def paper_statistics(pixels: DataFrame, sizes: DataFrame, exclude: DataFrame | None = None, side: int = 14, most_ink: float = 0.02) -> DataFrame:
    """raster_id and the figures of PESSIMISTIC for every raster of sizes (raster_id, width, height), from whole tiles of paper.

    pixels: raster_id, y, x, lightness, chroma, texture, ink (boolean).  A tile that a rectangle of exclude (raster_id, x, y, w,
    h) overlaps is left out, as is one with more ink than most_ink.  Rasters with under LEAST_TILES tiles get PESSIMISTIC."""
    ty, tx = (F.floor(F.col(c) / side).cast("long") for c in ("y", "x"))
    figures = {"level": F.avg("lightness"), "variance": F.var_pop("lightness"), "chroma": F.stddev_pop("chroma"), "grain": F.stddev_pop("texture"), "texture_mean": F.avg("texture"), "dark": F.avg(F.col("ink").cast("double")), "n": F.count("*")}
    tiles = pixels.groupBy("raster_id", ty.alias("ty"), tx.alias("tx")).agg(*(c.alias(n) for n, c in figures.items())).where((F.col("n") == side * side) & (F.col("dark") <= most_ink))
    if exclude is not None:
        # the rectangles of a raster as an array: the tiles stay with their raster
        side_by_side = F.collect_list(box.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("_out")
        out = exclude.where("w > 0 and h > 0").groupBy("raster_id").agg(side_by_side)
        meets = lambda o: (o["x"] < (F.col("tx") + 1) * side) & (o["x"] + o["w"] > F.col("tx") * side) & (o["y"] < (F.col("ty") + 1) * side) & (o["y"] + o["h"] > F.col("ty") * side)
        tiles = tiles.join(_held(out), "raster_id", "left").where(~F.coalesce(F.exists("_out", meets), F.lit(False)))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    held = F.sort_array(F.collect_list("variance"))
    p85 = F.get(held, round_half_up(0.85 * (F.size(held) - 1)).cast("int"))
    sums = tiles.groupBy("raster_id").agg(
        middle("level").alias("paper_level"), F.greatest(F.lit(LEAST_SIGMA), middle(F.sqrt("variance"))).alias("sigma_lightness"), F.greatest(F.lit(LEAST_SIGMA), middle("chroma")).alias("sigma_chroma"),
        F.greatest(F.lit(LEAST_SIGMA), middle("grain")).alias("sigma_texture"), F.greatest(F.lit(LEAST_VARIANCE), p85).alias("variance_p85"), F.greatest(F.lit(LEAST_TEXTURE), middle("texture_mean")).alias("texture_level"), F.count("*").alias("tiles"),
    ).where(F.col("tiles") >= LEAST_TILES)
    every = sizes.select("raster_id", (F.floor(F.col("width") / side) * F.floor(F.col("height") / side)).alias("_every")).join(_held(sums), "raster_id", "left").withColumn("paper_fraction", F.col("tiles") / F.col("_every"))
    return every.select("raster_id", *(F.coalesce(F.col(c), F.lit(v).cast("long" if c == "tiles" else "double")).alias(c) for c, v in PESSIMISTIC.items()))


def local_paper(pixels: DataFrame, hints: DataFrame, within_bounds: DataFrame | None = None) -> DataFrame:
    """raster_id and the figures of PLAIN_PAPER for every hint (raster_id, x, y, w, h, width, height): the paper in a ring around it.

    pixels: raster_id, y, x, r, g, b.  Every second pixel of the ring counts, those outside within_bounds (raster_id, x, y, w, h)
    do not; of them the brighter half, its upper medians, and the upper median of how far its luminance lies from that."""
    grown = lambda by: box.rect(round_half_up(F.col("x") - by * F.col("w")), round_half_up(F.col("y") - by * F.col("h")), round_half_up(F.col("w") + 2 * by * F.col("w")), round_half_up(F.col("h") + 2 * by * F.col("h")))
    ring = hints.select("raster_id", "width", "height", grown(0.25).alias("i"), grown(0.9).alias("o"))
    ring = ring.withColumns({"fx": F.greatest(F.lit(0), F.col("o.x")), "fy": F.greatest(F.lit(0), F.col("o.y"))})
    p = pixels.join(_held(ring), "raster_id")
    inside = lambda b: (F.col("x") >= F.col(f"{b}.x")) & (F.col("x") < F.col(f"{b}.x") + F.col(f"{b}.w")) & (F.col("y") >= F.col(f"{b}.y")) & (F.col("y") < F.col(f"{b}.y") + F.col(f"{b}.h"))
    p = p.where(inside("o") & ~inside("i") & ((F.col("x") - F.col("fx")) % 2 == 0) & ((F.col("y") - F.col("fy")) % 2 == 0))
    if within_bounds is not None:
        p = p.join(within_bounds.select("raster_id", box.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("s")).transform(_held), "raster_id").where(inside("s"))
    luminance = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    samples = p.groupBy("raster_id").agg(F.sort_array(F.collect_list(F.struct(luminance.alias("l"), "y", "x", "r", "g", "b"))).alias("p")).where(F.size("p") >= LEAST_SAMPLES)
    bright = samples.select("raster_id", F.slice("p", F.floor(F.size("p") / 2).cast("int") + 1, F.size("p")).alias("p"))
    middle = lambda c: _upper(F.transform("p", lambda q: q[c].cast("double")))
    found = bright.select("raster_id", "p", *(middle(c).alias(n) for c, n in (("r", "r"), ("g", "g"), ("b", "b"), ("l", "luminance"))))
    found = found.withColumn("spread", _upper(F.transform("p", lambda q: F.abs(q["l"] - F.col("luminance"))))).drop("p")
    return hints.select("raster_id").join(_held(found), "raster_id", "left").select("raster_id", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in PLAIN_PAPER.items()))


def white_balanced(pixels: DataFrame) -> DataFrame:
    """pixels (raster_id, y, x, r, g, b, ink) with each plane scaled so that the 95th percentile of what is no ink comes to 245.

    Gains stay within 0.8 and 1.25; a plane whose percentile is under 20 stays, as does a raster with under 5 % of paper."""
    planes = F.array(*(F.struct(F.lit(c).alias("plane"), F.col(c).alias("v")) for c in "rgb"))
    light = pixels.where(~F.col("ink")).select("raster_id", F.explode(planes).alias("p")).groupBy("raster_id", "p.plane", "p.v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("raster_id", "plane")
    levels = light.withColumns({"seen": F.sum("n").over(up.orderBy("v")), "counted": F.sum("n").over(up)})
    level = levels.where("seen >= counted * 0.95D").groupBy("raster_id", "plane").agg(F.min("v").alias("level"), F.first("counted").alias("counted"))
    sizes = pixels.groupBy("raster_id").agg(F.count("*").alias("size"))
    gain = F.when((F.col("counted") < F.col("size") * 0.05) | (F.col("level") < 20), 1.0).otherwise(F.greatest(F.lit(0.8), F.least(F.lit(1.25), 245 / F.col("level"))))
    gains = level.join(_held(sizes), "raster_id").groupBy("raster_id").agg(F.map_from_entries(F.collect_list(F.struct("plane", gain.alias("gain")))).alias("gains"))
    scaled = lambda c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(F.col(c) * F.coalesce(F.try_element_at("gains", F.lit(c)), F.lit(1.0))))).cast("int")
    return pixels.join(_held(gains), "raster_id", "left").select("raster_id", "y", "x", *(scaled(c).alias(c) for c in "rgb"), "ink")


def new_ink(labels: DataFrame, printed: DataFrame, least: float = 0.2) -> DataFrame:
    """The pixels (raster_id, y, x, label) of the strokes that a blank form doesn't explain, whole, with what they share with it.

    printed: raster_id, y, x of the form's own ink, grown by how far it may have moved.  A stroke stays if at least `least` of its
    pixels, and one, lie outside."""
    known = printed.select("raster_id", "y", "x", F.lit(1).alias("_known"))
    rest = labels.join(known, ["raster_id", "y", "x"], "left").groupBy("raster_id", "label").agg(F.count("*").alias("_area"), F.count_if(F.col("_known").isNull()).alias("_rest"))
    return labels.join(rest.where((F.col("_rest") > 0) & (F.col("_rest") >= F.col("_area") * least)).select("raster_id", "label"), ["raster_id", "label"], "left_semi")


def rooted(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, id, root: of each node (key, id) the smallest id that edges (key, a, b) lead to.  Each round takes the least root
    of a node's neighbours and then the root's own root, so that chains halve."""
    both = settled(edges.select(key, "a", "b").union(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))))
    at = settled(nodes.select(key, "id", F.col("id").alias("root")))
    while True:
        low = both.join(at.withColumnRenamed("id", "a"), [key, "a"]).groupBy(key, F.col("b").alias("id")).agg(F.min("root").alias("low"))
        new = at.join(low, [key, "id"], "left").select(key, "id", F.least("root", F.coalesce("low", "root")).alias("new"), "root")
        up = new.select(key, F.col("id").alias("new"), F.col("new").alias("up"))
        new = settled(new.join(up, [key, "new"], "left").select(key, "id", F.least("new", F.coalesce("up", "new")).alias("new"), "root"))
        at = new.select(key, "id", F.col("new").alias("root"))
        if new.where("new <> root").isEmpty():
            return at


#: A dark region at the border stays a print's unless it touches two sides or runs along so much of one.  Fixed values.
TWO_SIDES, MOST_OF_A_SIDE = 2, 0.85


def border_regions(dark: DataFrame, sizes: DataFrame) -> DataFrame:
    """raster_id, y, x of the dark pixels (raster_id, y, x) of the regions, joined in four directions, that reach a raster's border
    along two sides or more, or along most of one.  sizes: raster_id, width, height.

    Pixels of a row are taken as runs first; runs of neighbouring rows that overlap are linked, so what is labelled is
    a raster's runs, not its pixels."""
    row = Window.partitionBy("raster_id", "y").orderBy("x")
    runs = dark.withColumn("_at", F.col("x") - F.row_number().over(row)).groupBy("raster_id", "y", "_at").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = settled(runs.join(sizes, "raster_id").select("raster_id", "y", "x0", "x1", "width", "height", (F.col("y").cast("long") * F.col("width") + F.col("x0")).alias("id")))
    below = runs.select("raster_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("id").alias("b"))
    edges = runs.join(below, ["raster_id", "y"]).where("x0 <= _x1 and _x0 <= x1").select("raster_id", F.col("id").alias("a"), "b")
    named = runs.join(rooted(runs, edges, "raster_id"), ["raster_id", "id"])
    length = F.col("x1") - F.col("x0") + 1
    touch = {"top": F.when(F.col("y") == 0, length), "bottom": F.when(F.col("y") == F.col("height") - 1, length), "left": F.when(F.col("x0") == 0, 1), "right": F.when(F.col("x1") == F.col("width") - 1, 1)}
    sides = named.groupBy("raster_id", "root", "width", "height").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in touch.items()))
    touched = sum(((F.col(n) > 0).cast("int") for n in touch), F.lit(0))
    longest = F.greatest(F.col("top") / F.col("width"), F.col("bottom") / F.col("width"), F.col("left") / F.col("height"), F.col("right") / F.col("height"))
    kept = sides.where((touched >= TWO_SIDES) | (longest >= MOST_OF_A_SIDE)).select("raster_id", "root")
    return named.join(kept, ["raster_id", "root"], "left_semi").select("raster_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def region_means(pixels: DataFrame, boxes: DataFrame, *layers: str) -> DataFrame:
    """raster_id, region and the mean of each layer over the pixels (raster_id, y, x, ...) of a box (raster_id, region, x, y, w, h);
    0 for a box without pixels.  Ink density is the mean of a mask, texture contrast that of the grain over the paper's."""
    b = boxes.select("raster_id", "region", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("x") + F.col("w")).alias("_right"), (F.col("y") + F.col("h")).alias("_bottom"))
    inside = pixels.join(b, "raster_id").where("x >= _x and x < _right and y >= _y and y < _bottom")
    means = inside.groupBy("raster_id", "region").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in layers))
    return boxes.select("raster_id", "region").join(means, ["raster_id", "region"], "left").na.fill(0.0, list(layers))
