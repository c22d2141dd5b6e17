"""Edges of pasted objects: steps across bands of a raster, and the straight lines that most of them lie on.

Steps are found in a scanline's own arrays, so they need no shuffle.  Lines are found by consensus: seeded hypotheses of each
fit are voted on by the fit's samples, and the samples of the best line are fitted again.  Samples are shuffled once, by their
fit; a task holds one fit and one batch, and a fit is bounded by its raster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first state of the generator (xorshift of 32 bits by 13, 17 and 5) that draws hypotheses, and the fewest samples of a line.
#: The same samples always give the same line.
FIRST_STATE, FEWEST = 0x2F6E2B1, 8
INSIDE_AFTER = ("left", "top")


def scanlines(rasters: DataFrame, side: str, band: tuple[Column, ...], channels: Sequence[str] = ("values",)) -> DataFrame:
    """raster_id, along, begin and the channels: what lies in the band (x, y, w, h) across each scanline, from pixel `begin` on.
    Left and right edges are searched along rows, others along columns.  Bands under three pixels wide or high have none."""
    x, y, w, h = band
    corner = lambda c, most: F.least(most, F.greatest(F.lit(0), c)).cast("int")
    cut = rasters.select("*", corner(F.floor(x), F.col("width")).alias("_x0"), corner(F.floor(y), F.col("height")).alias("_y0"), corner(F.ceil(x + w), F.col("width")).alias("_x1"), corner(F.ceil(y + h), F.col("height")).alias("_y1"))
    cut = cut.where("_x1 - _x0 >= 3 and _y1 - _y0 >= 3")
    if side in ("left", "right"):
        part = lambda c, at: F.slice(c, at * F.col("width") + F.col("_x0") + 1, F.col("_x1") - F.col("_x0"))
        at, begin = F.sequence(F.col("_y0"), F.col("_y1") - 1), F.col("_x0")
    else:
        part = lambda c, at: F.transform(F.sequence(F.col("_y0"), F.col("_y1") - 1), lambda r: F.get(F.col(c), r * F.col("width") + at))
        at, begin = F.sequence(F.col("_x0"), F.col("_x1") - 1), F.col("_y0")
    rows = F.transform(at, lambda a: F.struct(a.alias("along"), begin.alias("begin"), *(part(c, a).alias(c) for c in channels)))
    return cut.select("raster_id", F.inline(rows))


def _median(values: Column, count: int) -> Column:
    """Of `count` values."""
    low = F.sort_array(values)
    return F.get(low, F.lit(count // 2)).cast("double") if count % 2 else F.aggregate(F.slice(low, count // 2, 2), F.lit(0.0), lambda s, v: s + v) / 2


def _any_median(values: Column) -> Column:
    """Of an array of any length; the array is bound once, as the element of another."""
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    return F.get(F.transform(F.array(F.sort_array(values)), middle), F.lit(0))


def steps(lines: DataFrame, side: str, channels: dict[str, tuple[float | Column, float | Column]], half_window: float, sustain: float | None = None, least: float = 8.0, share: float = 0.15, peaks: int = 1, thin_ratio: float = 0.0) -> DataFrame:
    """raster_id, along, peak, x, y, response, thin: the strongest steps of each scanline, `peaks` at most.

    channels: of each its weight and the deviation of paper.  A step is the weighted difference of two medians, of a short
    window outside and one as long as `sustain` inside, which meet between two pixels.  A step's place is the middle of
    its plateau (97 % of its peak), of a single highest point the vertex of a parabola, corrected for unequal windows.  A
    later peak lies outside the plateaus before it and a window around them.  thin: the response falls below `thin_ratio`
    of itself where the outside window is as long as the inside one."""
    window = max(1, int(half_window + 0.5))
    long = max(window, int((half_window if sustain is None else sustain) + 0.5))
    inside_after = side in INSIDE_AFTER
    lead, trail = (window, long) if inside_after else (long, window)
    n = F.size(F.col(next(iter(channels))))
    noise = lambda sigma: F.greatest(F.lit(1e-6), sigma if isinstance(sigma, Column) else F.lit(float(sigma)))

    def response(at: Column, medians) -> Column:
        parts = [weight * F.abs(medians(c, at)) / noise(sigma) for c, (weight, sigma) in channels.items()]
        return sum(parts[1:], parts[0])

    short = lambda c, at: _median(F.slice(c, at - lead + 2, lead), lead) - _median(F.slice(c, at + 2, trail), trail)
    first, last = lead - 1, n - trail - 1
    rows = lines.where(last - first + 1 >= 3)
    rows = rows.withColumn("_r", F.transform(F.sequence(F.lit(first), last), lambda at: response(at, short)))
    rows = rows.withColumns({"_floor": F.greatest(F.lit(float(least)), F.array_max("_r") * share), "_n": F.size("_r")})

    at = lambda i: F.get(F.col("_r"), i)
    everywhere = F.sequence(F.lit(0), F.col("_n") - 1)

    def next_peak(found: Column) -> Column:
        free = F.filter(everywhere, lambda i: (at(i) >= F.col("_floor")) & (at(i) > 0) & ~F.exists(found, lambda t: (i >= t["low"] - window) & (i <= t["high"] + window)))
        return F.array_max(F.transform(free, lambda i: F.struct(at(i).alias("value"), (-i).alias("back"))))

    def grown(best: Column) -> Column:
        i, base = -best["back"], best["value"] * 0.97
        low = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), i), lambda k: at(k) < base)) + 1, F.lit(0))
        high = F.coalesce(F.array_min(F.filter(F.sequence(i, F.col("_n") - 1), lambda k: at(k) < base)) - 1, F.col("_n") - 1)
        return F.struct(low.alias("low"), high.alias("high"), i.alias("at"), best["value"].alias("value"))

    kind = "array<struct<low:int,high:int,at:int,value:double>>"

    def step(found: Column, _: Column) -> Column:
        grow = lambda best: F.when(best.isNull(), found).otherwise(F.concat(found, F.array(grown(best)))).cast(kind)
        return F.get(F.transform(F.array(next_peak(found)), grow), F.lit(0))

    rows = rows.withColumn("_found", F.aggregate(F.sequence(F.lit(1), F.lit(max(1, peaks))), F.array().cast(kind), step))
    # outer: for an inner one Spark filters by the array's size first, and computes the whole fold for that as well
    each = rows.select("*", F.posexplode_outer("_found").alias("peak", "_p")).where("_p is not null")
    low, high, i, value = (F.col(f"_p.{c}") for c in ("low", "high", "at", "value"))
    bend = at(i - 1) - 2 * value + at(i + 1)
    single = (low == high) & (i > 0) & (i < F.col("_n") - 1) & (bend < -1e-9)
    vertex = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (at(i - 1) - at(i + 1)) / F.when(bend < -1e-9, bend)))
    place = F.col("begin") + first + (low + high) / 2 + F.when(single, vertex).otherwise(0.0) - (lead - trail) / 4 + 0.5
    thin = F.lit(False)
    if thin_ratio > 0:
        here = i + first
        begin = F.greatest(F.lit(0), here - long + 1)
        cut = {True: lambda c: F.slice(c, begin + 1, here - begin + 1), False: lambda c: F.slice(c, here + 2, F.least(F.lit(long), n - here - 1))}
        thin = response(here, lambda c, _: _any_median(cut[True](c)) - _any_median(cut[False](c))) < thin_ratio * value
    across = {"x": place, "y": F.col("along").cast("double")} if side in ("left", "right") else {"x": F.col("along").cast("double"), "y": place}
    return each.select("raster_id", "along", "peak", *(c.alias(k) for k, c in across.items()), value.alias("response"), thin.alias("thin"))


def draws(iterations: int) -> list[tuple[float, float]]:
    """Pairs of numbers from [0, 1), the same ones each time."""
    state, out = FIRST_STATE, []
    for _ in range(2 * iterations):
        for by in (13, -17, 5):
            state = (state ^ (state << by if by > 0 else state >> -by)) & 0xFFFFFFFF
        out.append(state / 2**32)
    return list(zip(out[::2], out[1::2], strict=True))


def _turned(line: np.ndarray, angle: float | None, deviation: float) -> np.ndarray:
    """Whether each line is further than `deviation` degrees from the angle."""
    if angle is None:
        return np.zeros(line.shape[1], bool)
    apart = np.abs(np.degrees(np.arctan2(-line[0], line[1])) % 180 - angle) % 180
    return ~(np.minimum(apart, 180 - apart) <= deviation)


def _through(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Lines (a, b, c) through (x, y) and (u, v), not numbers where that is one point."""
    far = np.hypot(u - x, v - y)
    far[far < 1e-9] = np.nan
    a, b = -(v - y) / far, (u - x) / far
    return np.stack([a, b, -(a * x + b * y)])


def _fitted(x: np.ndarray, y: np.ndarray, response: np.ndarray, n: np.ndarray, tolerance: float, iterations: int, angle: float | None, deviation: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line (a, b, c) of each fit, its inliers (0: it has no line) and their mean response; the n samples of a fit, FEWEST or
    more, stand one after another, strongest first."""
    begin, fit = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    near = lambda line: np.abs(line[0][fit] * x + line[1][fit] * y + line[2][fit]) <= tolerance
    count = lambda taken: np.add.reduceat(taken, begin, dtype=np.int64)
    total = lambda values, taken: np.bincount(fit, np.where(taken, values, 0.0))  # in the order of the samples
    votes, seed = np.full(len(n), FEWEST - 1), np.full((3, len(n)), np.nan)
    for k, (first, second) in enumerate(draws(iterations)):
        pool = np.minimum(n, np.maximum(FEWEST, np.floor(k / iterations * n).astype(np.int64) + FEWEST))
        i, j = np.floor(first * pool).astype(np.int64), np.floor(second * pool).astype(np.int64)
        j = begin + np.where(i == j, (j + 1) % pool, j)
        line = _through(x[begin + i], y[begin + i], x[j], y[j])
        line[:, _turned(line, angle, deviation)] = np.nan
        mine = count(near(line))
        more = mine > votes
        votes[more], seed[:, more] = mine[more], line[:, more]
    taken = near(seed)
    held = count(taken)
    mx, my = total(x, taken) / held, total(y, taken) / held
    dx, dy = x - mx[fit], y - my[fit]
    sxx, syy, sxy = total(dx * dx, taken), total(dy * dy, taken), total(dx * dy, taken)
    b = (sxx + syy - np.sqrt((sxx - syy) ** 2 + 4 * sxy * sxy)) / 2 - sxx
    norm, level = np.hypot(sxy, b), np.where(sxx >= syy, 0.0, 1.0)
    a, b = np.where(norm < 1e-12, level, sxy / norm), np.where(norm < 1e-12, 1 - level, b / norm)
    line = np.stack([a, b, -(a * mx + b * my)])
    line = np.where(_turned(line, angle, deviation), seed, line)
    taken = near(line)
    held = count(taken)
    return line, held, total(response, taken) / held


def _begins(keys: list[pa.ChunkedArray]) -> np.ndarray:
    """Rows from the second on whose keys are not those of the row before."""
    fresh = np.zeros(len(keys[0]) - 1, bool)
    for c in keys:
        other = pc.not_equal(c[1:], c[:-1])
        if pa.types.is_floating(c.type):
            other = pc.and_not(other, pc.and_(pc.is_nan(c[1:]), pc.is_nan(c[:-1])))
        fresh |= other.to_numpy()
    return np.flatnonzero(fresh) + 1


def fits(samples: DataFrame, key: list[str], order: list[str], tolerance: float, **of) -> DataFrame:
    """key, line (a, b, c), inliers, samples, mean_response: the best supported line of each key's samples (x, y, response)."""
    return candidates(samples, key, order, tolerance, most=1, **of).drop("pass")


def candidates(samples: DataFrame, key: list[str], order: list[str], tolerance: float, most: int = 3, iterations: int = 200, least: float = 1.0, angle: float | None = None, deviation: float = 180.0) -> DataFrame:
    """The rows of fits(), with pass from 1: each pass leaves out the samples within twice the tolerance of the line before.
    It ends where nothing, or fewer than FEWEST samples, would be left out or left.

    Pairs are drawn from a pool that grows from the strongest samples on; of equally supported pairs the first counts.  A
    line further than `deviation` degrees from `angle` is no hypothesis.  Keys of fewer than FEWEST samples of response
    `least` or more, or whose best line has fewer, have no row.  order: breaks ties of equal responses."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([samples.schema[k] for k in key] + StructType.fromDDL("line struct<a:double,b:double,c:double>, inliers long, samples long, mean_response double, pass int").fields)
    arrow = to_arrow_schema(schema)

    def lines_of(part: pa.Table) -> Iterator[pa.RecordBatch]:
        """part: whole fits, one after another."""
        first = np.concatenate([[0], _begins([part[k] for k in key])])
        every = len(first)
        fit = np.repeat(np.arange(every), np.diff(np.append(first, len(part))))
        x, y, response, strong, known = (part[c].to_numpy() for c in ("_x", "_y", "_response", "_strong", "_known"))
        for k in range(1, most + 1):
            n = np.bincount(fit[strong], minlength=every)
            at, used = np.flatnonzero(n >= FEWEST), strong & (n >= FEWEST)[fit]
            if not len(at):
                return
            line, inliers, mean = _fitted(x[used], y[used], response[used], n[at], tolerance, iterations, angle, deviation)
            found = inliers > 0
            at, line = at[found], line[:, found]
            made = [part[c].take(pa.array(first[at])) for c in key]
            made += [pa.StructArray.from_arrays([pa.array(v) for v in line], fields=list(arrow.field("line").type))]
            made += [pa.array(v) for v in (inliers[found], n[at], mean[found], np.full(len(at), k, np.int32))]
            yield from pa.table(made, schema=arrow).to_batches()
            seen = np.full((3, every), np.nan)
            seen[:, at] = line
            away = np.abs(seen[0][fit] * x + seen[1][fit] * y + seen[2][fit])
            has = np.isin(np.arange(every), at)
            far = has[fit] & known & ~(away <= 2 * tolerance)
            left = np.bincount(fit[far], minlength=every)
            keep = far & (has & (left >= FEWEST) & (left < np.bincount(fit, minlength=every)))[fit]
            fit, x, y, response, strong, known = (v[keep] for v in (fit, x, y, response, strong, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last fit, which may go on in the next batch
        with np.errstate(all="ignore"):
            for batch in batches:
                if not len(batch):
                    continue
                before = [held[-1][-1:]] if held else []
                met = pa.Table.from_batches([*before, batch])
                begins = _begins([met[k] for k in key]) - len(before)
                if len(begins):
                    at = int(begins[-1])
                    yield from lines_of(pa.Table.from_batches([*held, batch[:at]]))
                    held = []
                    batch = batch[at:]
                held.append(batch)
            if held:
                yield from lines_of(pa.Table.from_batches(held))

    rows = samples.select(*dict.fromkeys([*key, *order, "x", "y", "response"]))
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.desc("response"), *(F.asc_nulls_last(c) for c in (*order, "x", "y")))
    real = [F.col(c).cast("double").alias(f"_{c}") for c in ("x", "y", "response")]
    strong, known = F.coalesce(F.col("response") >= least, F.lit(False)), F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.select(*key, *real, strong.alias("_strong"), known.alias("_known")).mapInArrow(run, schema)
