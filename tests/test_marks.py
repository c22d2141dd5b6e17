"""Turn, type, steps, lines, boxes and paper against loops and synthetic pages."""

import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.functions import boxes, colour, pages
from vellumetry.operators import lines, regions, shapes, typeset
from vellumetry.plans import marks

# ---- steps and lines


def grain(n, m, level, noise, seed):
    return np.clip(np.rint(level + np.random.default_rng(seed).uniform(-noise, noise, (n, m))), 0, 255)


def page(spark, image, **more):
    channels = {"values": image, **more}
    names = list(channels)
    row = (1, image.shape[1], image.shape[0], *(channels[c].astype(int).ravel().tolist() for c in names))
    return spark.createDataFrame([row], f"raster_id long, width int, height int, {', '.join(f'{c} array<int>' for c in names)}")


def steps_of(spark, image, side, band, half=5, **of):
    rows = lines.scanlines(page(spark, image), side, tuple(map(F.lit, band)))
    return lines.steps(rows, side, {"values": (1.0, 3.0)}, half, **of)


def fit_of(samples, tolerance, **of):
    rows = lines.fits(samples, ["raster_id"], ["along", "peak"], tolerance, **of).collect()
    return rows[0] if rows else None


def off(fit, x, y):
    return abs(fit.line.a * x + fit.line.b * y + fit.line.c)


def pasted(seed=1):
    image = grain(200, 200, 240, 0, 0)
    image[50:150, 60:140] = grain(100, 80, 150, 6, seed)
    return image


@pytest.mark.parametrize("side, band, truth", [("left", (45, 60, 30, 80), (59.5, 100)), ("right", (125, 60, 30, 80), (139.5, 100)), ("top", (70, 35, 60, 30), (100, 49.5)), ("bottom", (70, 135, 60, 30), (100, 149.5))])
def test_a_step_is_found_below_a_pixel_on_four_sides(spark, side, band, truth):
    samples = steps_of(spark, pasted(), side, band)
    fit = fit_of(samples, 2.0)
    assert off(fit, *truth) < 0.6 and fit.inliers == fit.samples == (80 if side in ("left", "right") else 60)
    angle = math.degrees(math.atan2(-fit.line.a, fit.line.b)) % 180
    assert min(abs(angle - (90 if side in ("left", "right") else 0)), abs(angle - 180)) < 3
    again = fit_of(samples, 2.0)
    assert again == fit


def test_steps_match_plain_loops(spark):
    """A long inside window, several peaks, a parabola, two channels, and the mark of thin rules."""
    image = grain(24, 70, 235, 4, 3)
    image[:, 45:] = grain(24, 25, 140, 9, 4)
    image[:, 30:32] = 20
    other = grain(24, 70, 40, 9, 5)
    other[:, 45:] += 30
    lead, trail, n = 4, 9, 66
    frame = page(spark, image, other=other)
    for side in ("left", "right"):
        rows = lines.scanlines(frame, side, tuple(map(F.lit, (2, 3, 66, 18))), ("values", "other"))
        got = {(r.along, r.peak): r for r in lines.steps(rows, side, {"values": (1.0, 4.0), "other": (1.5, F.lit(2.0))}, 4, sustain=9, peaks=3, thin_ratio=0.4).collect()}
        ahead, behind = (lead, trail) if side == "left" else (trail, lead)
        want = {}
        for y in range(3, 21):
            v, u = image[y, 2:68], other[y, 2:68]
            med = lambda c, a, k: float(np.median(c[a : a + k]))
            r = [abs(med(v, s - ahead + 1, ahead) - med(v, s + 1, behind)) / 4 + 1.5 * abs(med(u, s - ahead + 1, ahead) - med(u, s + 1, behind)) / 2 for s in range(ahead - 1, n - behind)]
            floor, taken = max(8, max(r) * 0.15), []
            for peak in range(3):
                free = [i for i in range(len(r)) if r[i] >= floor and not any(a - 4 <= i <= b + 4 for a, b in taken)]
                if not free:
                    break
                i = max(free, key=lambda k: (r[k], -k))
                a = b = i
                while a and r[a - 1] >= 0.97 * r[i]:
                    a -= 1
                while b < len(r) - 1 and r[b + 1] >= 0.97 * r[i]:
                    b += 1
                taken.append((a, b))
                at = (a + b) / 2
                if a == b and 0 < i < len(r) - 1 and (bend := r[i - 1] - 2 * r[i] + r[i + 1]) < -1e-9:
                    at += max(-0.5, min(0.5, 0.5 * (r[i - 1] - r[i + 1]) / bend))
                s = ahead - 1 + i
                lo, hi = max(0, s - 8), min(n, s + 10)
                long = abs(np.median(v[lo : s + 1]) - np.median(v[s + 1 : hi])) / 4 + 1.5 * abs(np.median(u[lo : s + 1]) - np.median(u[s + 1 : hi])) / 2
                want[y, peak] = (2 + ahead - 1 + at - (ahead - behind) / 4 + 0.5, r[i], bool(long < 0.4 * r[i]))
        assert got.keys() == want.keys()
        for k, (x, response, thin) in want.items():
            assert got[k].x == pytest.approx(x) and got[k].response == pytest.approx(response) and got[k].thin == thin and got[k].y == k[0]


def test_outliers_do_not_bend_a_line(spark):
    image = pasted(7)
    image[90:105, 30:170] = 255  # a band of glare
    assert off(fit_of(steps_of(spark, image, "left", (45, 55, 30, 90)), 2.0), 59.5, 70) < 1.5
    rng = random.Random(9)  # four of ten samples are strays
    rows = [(1, k, 0, 30 + 0.1 * k + rng.uniform(-0.5, 0.5) if k % 10 > 3 else rng.uniform(0, 200), float(k), 10.0 + rng.random()) for k in range(150)]
    fit = fit_of(spark.createDataFrame(rows, "raster_id long, along int, peak int, x double, y double, response double"), 1.5)
    assert off(fit, 30, 0) < 0.6 and off(fit, 45, 150) < 0.6


def plain_lines(samples, tolerance, most, iterations, least, angle, deviation):
    """(line, inliers, samples, mean response) of each pass over samples (x, y, response, tie)."""
    last = lambda v: (v is None, v or 0)
    off = lambda l, p: math.nan if None in p[:2] else abs(l[0] * p[0] + l[1] * p[1] + l[2])
    weak = lambda p: (p[2] == p[2], -p[2] if p[2] == p[2] else 0, last(p[3]), *map(last, p[:2]))

    def turned(line):
        apart = abs(math.degrees(math.atan2(-line[0], line[1])) % 180 - angle) % 180
        return not min(apart, 180 - apart) <= deviation

    out = []
    for _ in range(most):
        strong = sorted((p for p in samples if p[2] is not None and not p[2] < least), key=weak)
        n, best = len(strong), (7, None)
        for k, (u, v) in enumerate(lines.draws(iterations) if n >= 8 else []):
            pool = min(n, max(8, math.floor(k / iterations * n) + 8))
            i, j = math.floor(u * pool), math.floor(v * pool)
            p, q = strong[i], strong[(j + 1) % pool if i == j else j]
            if None in p[:2] + q[:2] or not math.hypot(q[0] - p[0], q[1] - p[1]) >= 1e-9:
                continue
            z = math.hypot(q[0] - p[0], q[1] - p[1])
            a, b = -(q[1] - p[1]) / z, (q[0] - p[0]) / z
            line = (a, b, -(a * p[0] + b * p[1]))
            hits = sum(off(line, p) <= tolerance for p in strong)
            if hits > best[0] and not turned(line):
                best = (hits, line)
        if best[1] is None:
            break
        x, y = np.array([p[:2] for p in strong if off(best[1], p) <= tolerance]).T
        _, axes = np.linalg.eigh(np.cov(x, y))
        a, b = axes[:, 0] * -np.sign(axes[1, 0])
        line = (a, b, -(a * x.mean() + b * y.mean()))
        line = best[1] if turned(line) else line
        held = [p[2] for p in strong if off(line, p) <= tolerance]
        out.append((line, len(held), n, sum(held) / len(held)))
        far = [p for p in samples if None not in p[:2] and not off(line, p) <= 2 * tolerance]
        if len(far) < 8 or len(far) == len(samples):
            break
        samples = far
    return out


def test_lines_match_plain_loops(spark):
    """Fits that span batches or are too small, weak samples, samples and ties that are null or no number, keys of two kinds."""
    rng, rows, fit = random.Random(4), [], {}
    for key in [(k, name) for k in (1.0, 2.0, None) for name in ("a", "b", "c", None)] + [(math.nan, "d")]:
        for t in range(7 if key[1] == "c" else rng.randrange(60, 150)):
            x = rng.choice([None, math.nan, *[rng.uniform(0, 90) for _ in range(18)]])
            y = None if x is None else rng.choice([20 + 0.05 * x, 50 - 0.1 * x, 72 + 0.02 * x, rng.uniform(0, 80)]) + rng.uniform(-1, 1)
            row = (x, y, rng.choice([None, math.nan, 0.5, 2.0, 2.0, rng.uniform(1, 9), rng.uniform(1, 9)]), rng.choice([None, t, t, t]))
            rows.append((*key, *row))
            fit.setdefault(str(key), []).append(row)
    df = spark.createDataFrame(rows, "page double, name string, x double, y double, response double, tie int").repartition(5)
    of = {"most": 3, "iterations": 40, "least": 1.0, "angle": 0.0, "deviation": 30.0}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
        found = lines.candidates(df, ["page", "name"], ["tie"], 1.5, **of)
        got = {(str((r.page, r.name)), r["pass"]): r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(key, n): w for key, samples in fit.items() if "None" not in key for n, w in enumerate(plain_lines(samples, 1.5, **of), 1)}
    assert got.keys() == want.keys() and len(want) >= 8 and any(n == 3 for _, n in want)
    for k, (line, inliers, samples, mean) in want.items():
        assert tuple(got[k].line) == pytest.approx(line, abs=1e-9) and (got[k].inliers, got[k].samples) == (inliers, samples)
        assert got[k].mean_response == pytest.approx(mean, nan_ok=True)


def test_samples_of_lines_are_shuffled_once(spark):
    """Whatever the passes and hypotheses are, a sample is neither copied for each of them nor sent again."""
    samples = spark.range(400).selectExpr("id % 4 raster_id", "id tie", "id % 90 * 1.0D x", "20 + id % 7 / 5D + id div 4 % 2 * 30 y", "1D + id % 5 response")
    found = lines.candidates(samples, ["raster_id"], ["tie"], 1.5, most=3, iterations=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Aggregate" not in plan
    assert sorted({r["pass"] for r in found.collect()}) == [1, 2]


def test_no_line_is_made_up(spark):
    blank = steps_of(spark, grain(120, 120, 240, 4, 2), "left", (30, 30, 40, 60))
    assert fit_of(blank, 1.0, least=3.0) is None
    image = grain(60, 60, 240, 0, 0)
    image[:, 30:] = 120
    four = steps_of(spark, image, "left", (20, 10, 20, 4))
    assert four.count() == 4 and fit_of(four, 1.0) is None
    assert steps_of(spark, image, "left", (20, 10, 2, 40)).count() == 0
    assert fit_of(steps_of(spark, pasted(), "left", (45, 60, 30, 80)), 2.0, angle=0.0, deviation=30.0) is None


def test_the_first_draws_are_fixed():
    state, want = 0x2F6E2B1, []
    for _ in range(4):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        want.append(state / 2**32)
    assert [x for pair in lines.draws(2) for x in pair] == want


# ---- turn and type


@pytest.mark.parametrize("angle", [-4.5, -2.0, 0.0, 1.5, 3.5])
def test_the_turn_of_stripes(spark, angle):
    slope = math.tan(math.radians(angle))
    ink = {(round(y + slope * (x - 100)), x) for y in range(10, 150, 12) for x in range(200) if (x // 3 + y) % 4}
    rows = [(1, y, x) for y, x in ink if 0 <= y < 160] + [(2, y, 5) for y in range(150)]
    sizes = spark.createDataFrame([(1, 200, 160), (2, 200, 160), (3, 9, 9)], "raster_id long, width int, height int")
    got = {r.raster_id: r.degrees for r in typeset.skew(spark.createDataFrame(rows, "raster_id long, y int, x int"), sizes, steps=21).collect()}
    assert abs(got[1] - angle) < 0.7 and got[2] == got[3] == 0


def plain_runs(glyphs, px, of):
    buckets, out = {}, []
    for g in sorted(glyphs):
        label, x, y, w, h = g
        if h <= of["height"] * px and w <= of["width"] * px:
            key = next((k for k in buckets if abs(k - y - h) <= of["tolerance"] * px), y + h)
            buckets.setdefault(key, []).append(g)
    for bucket in buckets.values():
        run = []
        for g in [*sorted(bucket, key=lambda g: (g[1], g[0])), None]:
            if g and (not run or g[1] - run[-1][1] - run[-1][3] <= of["gap"] * px):
                run.append(g)
                continue
            heights = [q[4] for q in run]
            if len(run) >= of["glyphs"] and run[-1][1] + run[-1][3] - run[0][1] >= of["span"] * px and np.std(heights) / np.mean(heights) <= 0.45:
                out.append(tuple(q[0] for q in run))
            run = [g]
    return sorted(out)


def test_text_runs_match_plain_loops(spark):
    """Baselines drift, so that a glyph is within the tolerance of two buckets."""
    rng = random.Random(6)
    glyphs = [(k, rng.randrange(500), rng.choice([40, 42, 44, 45, 47, 90, 93]) - h, rng.randrange(2, 9), h) for k, h in ((k, rng.randrange(3, 10)) for k in range(260))]
    df = spark.createDataFrame([(1, *g) for g in glyphs] + [(2, 1, 5, 5, 5, 5)], "raster_id long, label long, x int, y int, w int, h int")
    got = {}
    for r in typeset.text_runs(df, 3.0).orderBy("x", "label").collect():
        got.setdefault((r.bucket, r.run), []).append(r.label)
    assert sorted(map(tuple, got.values())) == plain_runs(glyphs, 3.0, typeset.CAPTIONS) != []


# ---- boxes


def plain_groups(rows, gx, gy):
    groups = [({i}, x, y, x + w, y + h) for i, x, y, w, h in rows]
    again = True
    while again:
        again = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = groups[i], groups[j]
                if max(a[1] - b[3], b[1] - a[3]) <= gx and max(a[2] - b[4], b[2] - a[4]) <= gy:
                    groups[i] = (a[0] | b[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]))
                    del groups[j]
                    again = True
                    break
            if again:
                break
    return {i: (min(g[0]), *g[1:3], g[3] - g[1], g[4] - g[2]) for g in groups for i in g[0]}


BOXES = "page long, id long, x double, y double, w double, h double"


def test_near_groups_match_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(1, 12), rng.uniform(1, 12)) for k in range(150)]
    # a joint box comes near to what neither of its parts was near to
    rows += [(900, 1000.0, 1000.0, 10.0, 2.0), (901, 1011.0, 1000.0, 2.0, 40.0), (902, 1000.0, 1036.0, 3.0, 3.0)]
    want = plain_groups(rows, 3, 2)
    assert want[902][0] == 900
    got = regions.near_groups(spark.createDataFrame([(1, *r) for r in rows] + [(2, 5, 0.0, 0.0, 1.0, 1.0)], BOXES), "page", 3.0, 2.0).collect()
    assert {r.id: (r.group, r.x, r.y, pytest.approx(r.w), pytest.approx(r.h)) for r in got if r.page == 1} == want and len(got) == len(rows) + 1


def random_boxes(spark, pages: int, boxes: int, side: float):
    rng = np.random.default_rng(12)
    page, k = np.divmod(np.arange(pages * boxes), boxes)
    x, y, w, h = rng.uniform(0, side, len(k)), rng.uniform(0, side, len(k)), rng.uniform(1, 12, len(k)), rng.uniform(1, 12, len(k))
    twice = np.flatnonzero(k % 50 == 49)  # boxes of one id that are apart
    x[twice], y[twice], k[twice] = x[twice - 1] + 20, y[twice - 1], k[twice - 1]
    rows = zip(*(c.tolist() for c in (page, k, x, y, w, h)), strict=True)
    return spark.createDataFrame(list(rows) + [(0, 10**6, None, 3.0, 1.0, 1.0), (0, 10**6 + 1, 5.0, 5.0, None, 2.0), (0, None, 1.0, 1.0, 1.0, 1.0), (None, 3, 1.0, 1.0, 1.0, 1.0)], BOXES)


def test_groups_of_large_sets_are_those_of_small_ones(spark):
    df = random_boxes(spark, 3, 700, 900.0).repartition(5).localCheckpoint()
    rows = lambda most: sorted((r.page, r.id, r.group, *(c and round(c, 6) for c in r[3:])) for r in regions.near_groups(df, "page", 3.0, 2.0, most).select("page", "id", "group", *"xywh").where("x is not null and w is not null").collect())
    small = rows(10**6)
    assert len(small) == 2100 and 300 < len({r[:3:2] for r in small}) < 2000
    assert small == rows(100)
    lone = {r.id: (r.group, r.x, r.w) for r in regions.near_groups(df, "page", 3.0, 2.0).where("id >= 1000000").collect()}
    assert lone == {10**6: (10**6, None, None), 10**6 + 1: (10**6 + 1, 5.0, None)}


def test_groups_by_blocks_of_pairs_match_plain_loops(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(shapes, "BLOCK", 40)
    sets, rows = np.repeat(np.arange(6), 50), rng.uniform(0, 110, (300, 2)).round()
    sizes = rng.integers(1, 8, (300, 2))
    group, box = shapes.near_joined(sets, np.concatenate([rows, rows + sizes], 1).T.copy(), 3.0, 2.0)
    for k in range(6):
        at = np.flatnonzero(sets == k)
        want = plain_groups([(int(i), *rows[i].tolist(), *sizes[i].tolist()) for i in at], 3, 2)
        names = {g: int(at[group[at] == g].min()) for g in set(group[at].tolist())}
        assert {int(i): (names[group[i]], *box[:2, group[i]], *(box[2:, group[i]] - box[:2, group[i]])) for i in at} == want


def test_groups_of_bounded_sets_are_not_written_in_rounds(spark):
    from vellumetry.sources.settled import settled

    df = random_boxes(spark, 40, 500, 400.0).localCheckpoint()
    settled(df.limit(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = held()
    found = regions.near_groups(df, "page", 6.0, 4.0)
    assert found.count() == 20_002
    assert held() - before < 20_000  # 20,002 boxes have 960 kB
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_rounds_of_large_sets_delete_what_they_have_read(spark):
    from vellumetry.sources.settled import settled

    df = random_boxes(spark, 2, 2000, 900.0).localCheckpoint()
    settled(df.limit(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    assert regions.near_groups(df, "page", 6.0, 4.0, 500).count() == 4002
    assert len({p.name for p in folder.iterdir()} - before) <= 4  # the large sets, members, joint boxes and the last, empty links


def test_near_pairs_of_many_boxes(spark):
    rng = np.random.default_rng(4)
    n = 10_000
    x, y, w, h = rng.uniform(0, 3000, n), rng.uniform(0, 3000, n), rng.uniform(1, 20, n), rng.uniform(1, 20, n)
    w[0], h[0] = 3000, 2
    df = spark.createDataFrame([(1, k, float(x[k]), float(y[k]), float(w[k]), float(h[k])) for k in range(n)], BOXES)
    began = time.time()
    got = regions.near_pairs(df, "page", 4.0, 2.0).toArrow()
    assert time.time() - began < 60
    want = 0
    for k in range(n):
        near = (np.maximum(x[k] - x - w, x - x[k] - w[k]) <= 4) & (np.maximum(y[k] - y - h, y - y[k] - h[k]) <= 2)
        want += int(near[k + 1 :].sum())
    assert len(got) == want == len(set(zip(got["a"].to_pylist(), got["b"].to_pylist())))


def test_boxes_kept_apart_and_best_by_merit(spark):
    rows = [(1, 5.0, k, float(10 * (k % 4)), 0.0, 8.0, 8.0) for k in range(40)] + [(1, 6.0, 99, 1.0, 0.0, 8.0, 8.0)]
    df = spark.createDataFrame(rows, "page long, score double, ord long, x double, y double, w double, h double")
    kept = regions.best_apart(df, "page", ["ord"]).orderBy("place").collect()
    assert [(r.ord, r.score) for r in kept] == [(99, 6.0), (1, 5.0), (2, 5.0), (3, 5.0)]
    best = regions.best_by_merit(regions.best_apart(df, "page", ["ord"], most=2).withColumn("confidence", F.lit(0.5)), "page", spark.createDataFrame([(1, 10.0, 0.0, 8.0, 8.0)], "page long, x double, y double, w double, h double"), 0.4)
    assert [(r.ord, r.place, r.merit) for r in best.collect()] == [(1, 2, 0.9)]


def test_ambiguous_quads_are_null(spark):
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    quads = F.array(point(0, 5), point(5, 0), point(10, 5), point(5, 10)), F.array(point(9, 8), point(0, 9), point(1, 0), point(8, 1))
    got = spark.range(1).select(*(boxes.quad_order(q).alias(n) for q, n in zip(quads, "ab"))).first()
    assert got.a is None and [(p.x, p.y) for p in got.b] == [(1, 0), (8, 1), (9, 8), (0, 9)]
    flat = lambda c: F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(c).alias("c"))
    assert spark.range(1).select(pages.quad_of_lines(flat(1.0), flat(2.0), flat(3.0), flat(4.0)).alias("q")).first().q is None


# ---- paper


def test_paper_of_too_few_tiles_is_pessimistic(spark):
    rows = [(k, y, x, 200.0 + (x * y) % 5, 3.0, 1.0, False) for k, n in ((1, 44), (2, 28)) for y in range(n) for x in range(42)]
    px = spark.createDataFrame(rows, "raster_id long, y int, x int, lightness double, chroma double, texture double, ink boolean")
    sizes = spark.createDataFrame([(1, 42, 44), (2, 42, 28), (3, 5, 5)], "raster_id long, width int, height int")
    hole = spark.createDataFrame([(1, 30.0, 0.0, 3.0, 3.0), (1, -9.0, -9.0, 9.0, 9.0)], "raster_id long, x double, y double, w double, h double")
    got = {r.raster_id: r for r in regions.paper_statistics(px, sizes, None, side=14).collect()}
    assert got[1].tiles == 0 and got[1].paper_level == 220  # nine tiles only
    small = {r.raster_id: r for r in regions.paper_statistics(px, sizes, hole, side=7).collect()}
    assert small[1].tiles == 35 and small[1].sigma_chroma == 0.5 and small[1].texture_level == 1 and small[1].paper_fraction == pytest.approx(35 / 36)
    assert small[3].sigma_lightness == 12 and small[3].paper_fraction == 0


def test_new_strokes_stay_whole_and_moved_rules_go(spark):
    rule = [(1, 10, x, 1) for x in range(30)]  # the printed rule, a pixel lower than on the blank form
    stroke = [(1, y, 15, 2) for y in range(20, 30)] + [(1, 30, x, 2) for x in range(12, 30)]  # written along another rule
    labels = spark.createDataFrame(rule + stroke, "raster_id long, y int, x int, label int")
    printed = spark.createDataFrame([(1, y + d, x) for y in (9, 30) for d in (-1, 0, 1) for x in range(30)], "raster_id long, y int, x int")
    got = {(r.y, r.x) for r in regions.new_ink(labels, printed).collect()}
    assert got == {(y, x) for _, y, x, _ in stroke}


def test_white_balance_leaves_a_page_of_ink_alone(spark):
    rows = [(1, y, x, 100, 150, 200, not (y == 0 and x == 0)) for y in range(6) for x in range(6)] + [(2, y, x, 220, 10, 250, False) for y in range(6) for x in range(6)]
    got = {(r.raster_id, r.r, r.g, r.b) for r in regions.white_balanced(spark.createDataFrame(rows, "raster_id long, y int, x int, r int, g int, b int, ink boolean")).collect()}
    assert got == {(1, 100, 150, 200), (2, 245, 10, 245)}


# ---- a small file of which much is made


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pixels_are_broadcast_for_local_paper(spark, sf):
    df = marks.paper_near_hints(spark, sf)
    assert "Broadcast" not in plan_of(df) and df.rdd.getNumPartitions() > 1


def test_scans_of_a_small_file_are_more_than_one_task(spark, sf):
    assert marks.edge_steps(spark, sf).rdd.getNumPartitions() >= 8


def test_balanced_pixels_stay_with_their_raster(spark, sf):
    plan = plan_of(marks.white_balance(spark, sf))
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan


def test_tiles_stay_with_their_raster(spark, sf):
    plan = plan_of(marks.paper_figures(spark, sf))
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan and "ty" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_cells_do_not_depend_on_the_order_of_boxes(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(1, k, 0.0, 0.0, rng.uniform(0, 10) ** 5, rng.uniform(0, 1)) for k in range(999)], BOXES).coalesce(1)
    sides = {tuple(regions._sides(df.sort(c), "page", 0.1, 0.2).first()) for c in ("id", "w", "h", F.desc("w"), F.desc("id"))}
    assert len(sides) == 1


def test_marks_of_pages_without_orders_lie_within_regions(spark, tmp_path, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").limit(50).withColumn("l_orderkey", F.col("l_orderkey") + 10**9)
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    assert marks.boxes_within(spark, str(tmp_path)).count() > 0


def test_sizes_are_not_guessed_from_round_to_round(spark):
    from vellumetry.sources.settled import settled

    df = spark.range(9)
    for _ in range(6):
        df = settled(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert df.count() == 9 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**70


# ---- expressions that stay short


def test_a_polygon_is_mentioned_once(spark):
    assert str(pages.polygon_area(F.col("ppp"))).count("ppp") == 1


def test_an_inverse_stays_short(spark):
    assert str(pages.inverse(F.col("mmm"))).count("mmm") < 45


def test_a_colour_is_mentioned_a_few_times(spark):
    assert str(colour.lab(*(F.col(c) for c in ("rrr", "ggg", "bbb")))).count("rrr") < 5
