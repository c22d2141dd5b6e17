"""Whether a region holds a photograph: scores and absence, as column expressions over its measured figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumetry.functions import pages

#: Weights and ramps of the score, the window of sizes, the aspect's tolerance, when a box is empty, how far edges may differ.
#: Fixed values.
COVERAGE, TEXTURE, SPREAD, SHAPE, CHROMA = (0.3, 0.35, 0.8), (0.22, 1.15, 1.8), (0.2, 0.2, 0.5), (0.16, 0.7, 0.95), (0.12, 1.0, 3.0)
GREY_SPREAD = (0.12, 0.18, 0.45)
ASPECT_TOLERANCE, EMPTY_COVERAGE, EMPTY_SPREAD, MOST_ANGLE_SPREAD, CLEAR_RESPONSE = 0.15, 0.45, 0.35, 8.0, 12.0
NOMINAL = {"left": 90.0, "top": 0.0, "right": 90.0, "bottom": 0.0}


def ramp(value: Column, low: float, high: float) -> Column:
    """From 0 at low to 1 at high."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def size_fit(short: Column, long: Column, expected: tuple[float, float], window: tuple[float, float]) -> Column:
    """How well the sides (millimetres) fit a print's, 0 outside the window of ratios."""
    a, b = short / min(expected), long / max(expected)
    inside = a.between(*window) & b.between(*window)
    return F.when(inside, 1 - F.least(F.lit(1.0), (F.abs(1 - a) + F.abs(1 - b)) / (window[1] - window[0]))).otherwise(0.0)


def aspect_fit(short: Column, long: Column, expected: tuple[float, float]) -> Column:
    wanted = min(expected) / max(expected)
    off = F.abs(short / F.greatest(F.lit(1e-6), long) - wanted) / wanted
    return F.when(off <= ASPECT_TOLERANCE, 1 - off / ASPECT_TOLERANCE).otherwise(0.0)


def content_score(coverage: Column, texture: Column, spread: Column, modes: Column, rectangularity: Column, fit: Column, grey: Column) -> Column:
    """How like a photograph a region is, from 0 to 1.  fit: the better of the size's and the aspect's.  A page without colour
    gives the colours' weight to the tones."""
    part = lambda v, at: at[0] * ramp(v, *at[1:])
    shape = SHAPE[0] * (0.5 * ramp(rectangularity, *SHAPE[1:]) + 0.5 * fit)
    return part(coverage, COVERAGE) + part(texture, TEXTURE) + part(spread, SPREAD) + shape + F.when(grey, part(spread, GREY_SPREAD)).otherwise(part(modes.cast("double"), CHROMA))


def is_empty(coverage: Column, spread: Column) -> Column:
    """Whether a box holds no continuous tone: print and ink don't count, and not-a-number is no proof."""
    return (coverage < EMPTY_COVERAGE) & (spread < EMPTY_SPREAD) & ~F.isnan(coverage) & ~F.isnan(spread)


def edge_turn(line: Column, side: str) -> Column:
    """How far an edge is turned from where its side should run, in degrees above -90 up to 90."""
    off = pages.line_angle(line) - NOMINAL[side]
    return F.when(off > 90, off - 180).when(off <= -90, off + 180).otherwise(off)


def edge_weight(inlier_share: Column, mean_response: Column) -> Column:
    """How much a fitted edge's turn counts."""
    return inlier_share * F.least(F.lit(1.0), mean_response / CLEAR_RESPONSE)


def turn_spread(edges: dict[str, Column]) -> Column:
    turns = [edge_turn(line, side) for side, line in edges.items()]
    return F.greatest(*turns) - F.least(*turns)


def squared_up(edges: dict[str, Column], weights: dict[str, Column], middles: dict[str, tuple[Column, Column]]) -> Column:
    """The quad of four edges laid anew on the turn that they share: the weighted mean of those near the heaviest one's.  Each goes
    through the foot of its side's middle on its own line.  Null where no two agree, or without weight."""
    # each step binds what the next one mentions, as the element of an array
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    said = F.array(*(F.struct(weights[s].alias("w"), F.lit(-k).alias("first"), edge_turn(edges[s], s).alias("turn")) for k, s in enumerate(NOMINAL)))
    near = bound(said, lambda all_: bound(F.array_max(all_)["turn"], lambda anchor: F.filter(all_, lambda o: F.abs(o["turn"] - anchor) <= MOST_ANGLE_SPREAD)))
    sums = F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("w"), F.lit(0.0).alias("t")), lambda s, o: F.struct((s["n"] + 1).alias("n"), (s["w"] + o["w"]).alias("w"), (s["t"] + o["w"] * o["turn"]).alias("t")))
    turn = bound(sums, lambda s: F.when((s["n"] >= 2) & (s["w"] > 0), s["t"] / s["w"]))

    def laid(side: str, turn: Column) -> Column:
        line, (x, y), phi = edges[side], middles[side], F.radians(turn + NOMINAL[side])
        off = line["a"] * x + line["b"] * y + line["c"]
        a, b = -F.sin(phi), F.cos(phi)
        return F.struct(a.alias("a"), b.alias("b"), (-(a * (x - off * line["a"]) + b * (y - off * line["b"]))).alias("c"))

    lines = bound(turn, lambda t: F.when(t.isNotNull(), F.array(*(laid(s, t) for s in NOMINAL))))
    return bound(lines, lambda q: F.when(q.isNotNull(), pages.quad_of_lines(q[0], q[1], q[2], q[3])))
