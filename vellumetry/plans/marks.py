"""Registered queries on the marks of a page: its turn, type, lines, boxes and paper, with the SQL that checks them.

Parts stand in for scans (a raster each), line items for the marks on the pages of a supplier or of some orders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import photo
from vellumetry.operators import lines, packed, rasters, regions, typeset
from vellumetry.plans.catalogue import PX
from vellumetry.plans.registry import query
from vellumetry.sources.tables import dealt, packed_rasters, table

# ---- type and turn

WIDTH, HEIGHT = 60, 48
_INK = f"""ink as (select distinct p_size raster_id, cast(x as int) x, cast(floor(6 * (p_partkey % 9) + (x - 30) * (p_size % 11 - 5) / 57.0::double + 0.5) as int) y from part, range({WIDTH}) r(x) where (x + p_partkey) % 4 <> 0),
size as (select distinct p_size raster_id, {WIDTH} width, {HEIGHT} height from part), page as (select * from ink where y between 0 and {HEIGHT - 1})"""


def _ink(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stripes of a size's parts, each size turned by its own angle."""
    each = table(spark, d, "part").select("p_size", "p_partkey", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x")).where("(x + p_partkey) % 4 <> 0")
    y = F.floor(6 * (F.col("p_partkey") % 9) + (F.col("x") - 30) * (F.col("p_size") % 11 - 5) / 57.0 + 0.5).cast("int")
    ink = each.select(F.col("p_size").alias("raster_id"), "x", y.alias("y")).where(f"y between 0 and {HEIGHT - 1}").distinct()
    sizes = table(spark, d, "part").select(F.col("p_size").alias("raster_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")).distinct()
    return ink, sizes


def _turned(k: str, angles: str, source: str, keep: str) -> str:
    """Scores of the pages' turns: angles(k, s, c) against the pages."""
    return f"""(select raster_id, {k}{keep}, {HEIGHT + 1} * sum(n * n) - sum(n) * sum(n) score from (select raster_id, {k}{keep}, floor(-(x - {WIDTH / 2}) * s + (y - {HEIGHT / 2}) * c + {HEIGHT / 2} + 0.5) r, count(*) n
from {source}, {angles} group by all) where r between 0 and {HEIGHT} group by all)"""


_WHOLE = ", ".join(f"({k}, {math.sin(math.radians(k - 8))!r}::double, {math.cos(math.radians(k - 8))!r}::double)" for k in range(17))
_FINE = ", ".join(f"({k}, {j}, {a!r}::double, {math.sin(math.radians(a))!r}::double, {math.cos(math.radians(a))!r}::double)" for k in range(17) for j, a in enumerate(typeset.fine_angles(k - 8, 50)))


@query(f"""with recursive {_INK}, used as (select page.* from page join (select raster_id from page group by 1 having count(*) >= 200) using (raster_id)),
whole(k, s, c) as (values {_WHOLE}), fine(k, j, a, s, c) as (values {_FINE}),
coarse as (select raster_id, arg_min(k, (-score, k)) k, max(score) best from {_turned('k', 'whole', 'used', '')} group by 1),
scored as {_turned('k', 'fine', '(select used.*, coarse.k own from used join coarse using (raster_id))', ', j, a, own').replace('group by all) where r', 'where k = own group by all) where r')},
walk as (select raster_id, k, -1 j, k - 8.0::double angle, best score, false past from coarse union all
select w.raster_id, w.k, w.j + 1, case when not (w.past or f.a > w.angle + 1) and coalesce(s.score, 0) > w.score then f.a else w.angle end, case when not (w.past or f.a > w.angle + 1) and coalesce(s.score, 0) > w.score then s.score else w.score end, w.past or f.a > w.angle + 1
from walk w join fine f on f.k = w.k and f.j = w.j + 1 left join scored s on s.raster_id = w.raster_id and s.j = f.j)
select size.raster_id, coalesce(case when abs(angle) > 8 then 0 else round(angle, 2) end, 0) degrees from size left join (select * from walk where j = 49) using (raster_id)""")
def page_skew(spark, d):
    return typeset.skew(*_ink(spark, d))


_GLYPHS = """g as (select l_suppkey raster_id, l_partkey * 1000000000 + l_orderkey * 10 + l_linenumber as label, cast(l_partkey * 7 % 900 as int) x, cast(l_orderkey * 11 % 160 + l_linenumber as int) y, cast(2 + l_quantity % 13 as int) w, cast(3 + l_partkey % 9 as int) h, cast(1 + l_quantity as int) area from lineitem)"""


def _glyphs(spark, d) -> DataFrame:
    whole = lambda c, n: F.expr(c).cast("int").alias(n)
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("raster_id"), F.expr("l_partkey * 1000000000 + l_orderkey * 10 + l_linenumber").alias("label"), whole("l_partkey * 7 % 900", "x"), whole("l_orderkey * 11 % 160 + l_linenumber", "y"),
        whole("2 + l_quantity % 13", "w"), whole("3 + l_partkey % 9", "h"), whole("1 + l_quantity", "area"),
    )


def _runs_sql(px: float, of: dict, source: str) -> str:
    """CTEs up to runs(raster_id, bucket, run, label, x, y, w, h), those of type."""
    return f"""small as (select *, y + h base from {source} where h <= {of['height'] * px} and w <= {of['width'] * px}),
bases as (select raster_id, base, row_number() over (partition by raster_id order by min(label), base) k from small group by 1, 2),
fold as (select raster_id, k, [base] keys from bases where k = 1 union all
select f.raster_id, f.k + 1, case when len([q for q in f.keys if abs(q - b.base) <= {of['tolerance'] * px}]) > 0 then f.keys else list_append(f.keys, b.base) end from fold f join bases b on b.raster_id = f.raster_id and b.k = f.k + 1),
keys as (select raster_id, arg_max(keys, k) keys from fold group by 1),
placed as (select s.*, list_position([abs(q - base) <= {of['tolerance'] * px} for q in keys], true) bucket from small s join keys using (raster_id)),
cut as (select *, coalesce(x - lag(x + w) over o > {of['gap'] * px}, false) fresh from placed window o as (partition by raster_id, bucket order by x, label, w, h)),
every as (select *, sum(cast(fresh as int)) over (partition by raster_id, bucket order by x, label, w, h) run from cut),
good as (select raster_id, bucket, run from every group by all having count(*) >= {of['glyphs']} and arg_max(x + w, (x, label, w)) - min(x) >= {of['span'] * px} and stddev_pop(h) / avg(h) <= {typeset.UNEVEN}),
runs as (select raster_id, cast(bucket as bigint) bucket, cast(run as bigint) run, label, x, y, w, h from every join good using (raster_id, bucket, run))"""


@query(f"with recursive {_GLYPHS}, {_runs_sql(4.0, typeset.CAPTIONS, 'g')} select * from runs")
def text_runs(spark, d):
    """Two baselines within a tolerance of one glyph compete: the one opened first gets it."""
    return typeset.text_runs(_glyphs(spark, d), 4.0)


@query(f"with recursive {_GLYPHS}, {_runs_sql(4.0, typeset.CAPTIONS, 'g')} select g.raster_id, count(*) n, cast(sum(label) as bigint) labels from g where (raster_id, label) not in (select raster_id, label from runs) group by 1")
def captions_removed(spark, d):
    return typeset.without_captions(_glyphs(spark, d), 4.0).groupBy("raster_id").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query(f"""with recursive {_GLYPHS}, glyph as (select * from g where label % 10 < 7 and area >= 2), {_runs_sql(3.0, typeset.LABELS, '(select * from glyph where label % 7 <> raster_id % 7)')},
t as (select raster_id, count(distinct (bucket, run)) t from runs group by 1), q as (select raster_id, count(*) r from g where label % 10 = 7 and area >= 27 and raster_id % 3 <> 0 group by 1),
f as (select s_suppkey raster_id, coalesce(t, 0) text_lines, coalesce(r, 0) rules from supplier left join t on t.raster_id = s_suppkey left join q on q.raster_id = s_suppkey)
select *, text_lines >= 3 or rules >= 3 recognised, case when text_lines >= 3 or rules >= 3 then text_lines || ' lines of printed text and ' || rules || ' printed rules were found'
when text_lines = 0 and rules = 0 then 'no printed text or ruled lines were found anywhere on this image, so it does not appear to be a form'
else 'only ' || text_lines || ' line' || case text_lines when 1 then '' else 's' end || ' of printed text and ' || rules || ' printed rule' || case rules when 1 then '' else 's' end || ' were found, which is too little printed structure to locate this form''s fields' end detail from f""")
def form_presence(spark, d):
    marks = _glyphs(spark, d)
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("raster_id"))
    return typeset.presence(sizes, marks.where("label % 10 < 7 and label % 7 <> raster_id % 7"), marks.where("label % 10 = 7 and raster_id % 3 <> 0"), 3.0)


# ---- steps and lines

_SCAN = "200 - case when x >= 12 + p_size % 20 then 90 else 0 end - case when x between 4 + p_size % 20 and 5 + p_size % 20 then 110 else 0 end + (x * 7 + y * 3 + p_partkey) % 11"


def _scans(spark, d, width: int, height: int, value: str) -> DataFrame:
    """A packed raster of each part, from an expression over its columns, x and y."""
    cells = f"flatten(transform(sequence(0, {height - 1}), y -> transform(sequence(0, {width - 1}), x -> cast({value} as int))))"
    part = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", width * height)
    return part.select(F.col("p_partkey").alias("raster_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.expr(cells).alias("values"))


def _peak_sql(n: int, source: str) -> str:
    return f"""b{n} as (select raster_id, y, arg_min(i, (-r, i)) i, max(r) r from {source} where r >= fl and r > 0 group by 1, 2),
p{n} as (select b{n}.raster_id, b{n}.y, b{n}.i, b{n}.r, coalesce(max(f.i) filter (f.i < b{n}.i and f.r < b{n}.r * 0.97) + 1, 0) lo, coalesce(min(f.i) filter (f.i > b{n}.i and f.r < b{n}.r * 0.97) - 1, 27) hi from b{n} join f using (raster_id, y) group by 1, 2, 3, 4)"""


@query(f"""with px as (select p_partkey raster_id, y, x, {_SCAN} v from part, range(1, 11) a(y), range(2, 38) b(x)),
w as (select *, median(v) over (o rows between 2 preceding and current row) a, median(v) over (o rows between 1 following and 6 following) b, median(v) over (o rows between 5 preceding and current row) c from px window o as (partition by raster_id, y order by x)),
q as (select raster_id, y, x - 4 i, abs(a - b) / 3.0::double r, abs(c - b) / 3.0::double long from w where x between 4 and 31), t as (select raster_id, y, max(r) top from q group by 1, 2), f as (select q.*, greatest(8.0::double, top * 0.15::double) fl from q join t using (raster_id, y) where top > 0),
{_peak_sql(1, 'f')}, f2 as (select f.* from f join p1 using (raster_id, y) where f.i < lo - 3 or f.i > hi + 3), {_peak_sql(2, 'f2')},
u as (select 0 peak, * from p1 union all select 1, * from p2), v as (select u.*, s.long, n.r after, m.r as before from u join f s on s.raster_id = u.raster_id and s.y = u.y and s.i = u.i left join f n on n.raster_id = u.raster_id and n.y = u.y and n.i = u.i + 1 left join f m on m.raster_id = u.raster_id and m.y = u.y and m.i = u.i - 1)
select raster_id, cast(y as int) along, peak, round(4 + (lo + hi) / 2.0 + case when lo = hi and before - 2 * r + after < -1e-9 then greatest(-0.5, least(0.5, 0.5 * (before - after) / (before - 2 * r + after))) else 0 end + 0.75 + 0.5, 6) x, cast(y as double) y, round(r, 6) response, long < 0.5 * r thin from v""")
def edge_steps(spark, d):
    """An edge and, outside it, a rule two pixels wide, in the rows of a band."""
    scans = _scans(spark, d, 40, 12, _SCAN)
    rows = lines.scanlines(scans, "left", tuple(F.lit(v) for v in (2, 1, 36, 10)))
    found = lines.steps(rows, "left", {"values": (1.0, 3.0)}, 3, sustain=6, peaks=2, thin_ratio=0.5)
    return found.select("raster_id", "along", "peak", F.round("x", 6).alias("x"), "y", F.round("response", 6).alias("response"), "thin")


_SAMPLES = """s as (select l_suppkey * 10 + cast(l_quantity as int) % 10 fit_id, l_orderkey, l_linenumber, l_partkey % 97 + l_discount x,
case l_linenumber when 7 then (l_extendedprice * 13) % 80 else case when l_linenumber <= 3 then 20 + 0.05 * (l_partkey % 97 + l_discount) else 55 - 0.02 * (l_partkey % 97 + l_discount) end + (l_extendedprice * 7) % 1.9 end y, l_extendedprice / 10000 + l_linenumber response from lineitem)"""


def _fit_sql(n: int, source: str, tolerance: float, iterations: int) -> str:
    """CTEs up to fit{n}(fit_id, a, b, c, inliers, samples, mean_response) of the samples in source."""
    d = f"abs(a * x + b * y + c) <= {tolerance}"
    return f"""o{n} as (select *, row_number() over (partition by fit_id order by response desc, l_orderkey, l_linenumber, x, y) - 1 i, count(*) over (partition by fit_id) n from {source} where response >= 1.5), e{n} as (select * from o{n} where n >= 8),
h{n} as (select fit_id, n, k, cast(floor(u * least(n, greatest(8, floor(g * n) + 8))) as bigint) i, cast(floor(v * least(n, greatest(8, floor(g * n) + 8))) as bigint) j, least(n, greatest(8, floor(g * n) + 8)) pool from (select distinct fit_id, n from e{n}), draws),
l{n} as (select h.fit_id, h.k, -(q.y - p.y) / z a, (q.x - p.x) / z b, -(-(q.y - p.y) / z * p.x + (q.x - p.x) / z * p.y) c from h{n} h join e{n} p on p.fit_id = h.fit_id and p.i = h.i join e{n} q on q.fit_id = h.fit_id and q.i = cast(case when h.i = h.j then (h.j + 1) % h.pool else h.j end as bigint), lateral (select sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) z) where z >= 1e-9),
m{n} as (select *, case when abs(deg - 0) % 180 > 90 then 180 - deg % 180 else deg end turn from (select *, degrees(atan2(-a, b)) + case when degrees(atan2(-a, b)) < 0 then 180 else 0 end deg from l{n})),
v{n} as (select fit_id, k, a, b, c, count(*) filter ({d}) hits from m{n} join e{n} using (fit_id) where turn <= 30 group by 1, 2, 3, 4, 5),
w{n} as (select fit_id, a, b, c from v{n} where hits >= 8 qualify row_number() over (partition by fit_id order by hits desc, k) = 1),
t{n} as (select fit_id, count(*) n, avg(x) mx, avg(y) my, var_pop(x) * count(*) sxx, var_pop(y) * count(*) syy, covar_pop(x, y) * count(*) sxy from e{n} join w{n} using (fit_id) where {d} group by 1),
z{n} as (select fit_id, sxy / sqrt(sxy ** 2 + bb ** 2) a, bb / sqrt(sxy ** 2 + bb ** 2) b, mx, my from (select *, (sxx + syy - sqrt((sxx - syy) ** 2 + 4 * sxy ** 2)) / 2 - sxx bb from t{n})),
y{n} as (select fit_id, a, b, -(a * mx + b * my) c from z{n}),
fit{n} as (select fit_id, a, b, c, count(*) filter ({d}) inliers, count(*) samples, avg(response) filter ({d}) mean_response from y{n} join e{n} using (fit_id) group by 1, 2, 3, 4)"""


_DRAWS = ", ".join(f"({k}, {u!r}::double, {v!r}::double, {k / 60!r}::double)" for k, (u, v) in enumerate(lines.draws(60)))


@query(f"""with {_SAMPLES}, draws(k, u, v, g) as (values {_DRAWS}), {_fit_sql(1, 's', 1.37, 60)}, far as (select s.*, abs(a * x + b * y + c) > 2.74 far from s join fit1 using (fit_id)),
going as (select fit_id from far group by 1 having count(*) filter (far) >= 8 and count(*) filter (far) < count(*)), s2 as (select far.* from far join going using (fit_id) where far), {_fit_sql(2, 's2', 1.37, 60)}
select fit_id, pass, round(a, 4) a, round(b, 4) b, round(c, 3) c, inliers, samples, round(mean_response, 4) mean_response from (select 1 pass, * from fit1 union all select 2, * from fit2)""")
def line_candidates(spark, d):
    """Two lines and stray samples in each fit: the first pass takes one line, the second the other."""
    x = F.col("l_partkey") % 97 + F.col("l_discount")
    line = F.when(F.col("l_linenumber") <= 3, 20 + 0.05 * x).otherwise(55 - 0.02 * x) + (F.col("l_extendedprice") * 7) % 1.9
    samples = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_quantity").cast("int") % 10).alias("fit_id"), "l_orderkey", "l_linenumber", x.alias("x"), F.when(F.col("l_linenumber") == 7, (F.col("l_extendedprice") * 13) % 80).otherwise(line).alias("y"),
        (F.col("l_extendedprice") / 10000 + F.col("l_linenumber")).alias("response"),
    )
    found = lines.candidates(samples, ["fit_id"], ["l_orderkey", "l_linenumber"], 1.37, most=2, iterations=60, least=1.5, angle=0.0, deviation=30.0)
    return found.select("fit_id", "pass", *(F.round(f"line.{c}", k).alias(c) for c, k in (("a", 4), ("b", 4), ("c", 3))), "inliers", "samples", F.round("mean_response", 4).alias("mean_response"))


# ---- boxes

_MARKS = """m as (select l_orderkey // 40 page, l_orderkey * 10 + l_linenumber id, l_partkey % 397 * 1.0::double x, l_suppkey * 7 % 293 * 1.0::double y, 2 + l_quantity / 3 w, 3 + l_discount * 60 h, l_extendedprice score from lineitem)"""


def _marks(spark, d) -> DataFrame:
    real = lambda c, n: F.expr(c).cast("double").alias(n)
    return table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 40").alias("page"), F.expr("l_orderkey * 10 + l_linenumber").alias("id"), real("l_partkey % 397", "x"), real("l_suppkey * 7 % 293", "y"),
        real("2 + l_quantity / 3", "w"), real("3 + l_discount * 60", "h"), F.col("l_extendedprice").alias("score"),
    )


@query(f"""with recursive {_MARKS}, e as (select *, row_number() over (partition by page order by score desc, id) k from m),
r as (select page, k, [(id, x, y, w, h, score)] kept from e where k = 1 union all
select r.page, e.k, case when len(r.kept) >= 6 or len([b for b in r.kept if greatest(0, least(b[2] + b[4], e.x + e.w) - greatest(b[2], e.x)) * greatest(0, least(b[3] + b[5], e.y + e.h) - greatest(b[3], e.y)) >
0.05 * (b[4] * b[5] + e.w * e.h - greatest(0, least(b[2] + b[4], e.x + e.w) - greatest(b[2], e.x)) * greatest(0, least(b[3] + b[5], e.y + e.h) - greatest(b[3], e.y)))]) > 0 then r.kept else list_append(r.kept, (e.id, e.x, e.y, e.w, e.h, e.score)) end
from r join e on e.page = r.page and e.k = r.k + 1), l as (select page, arg_max(kept, k) kept from r group by 1)
select page, cast(i as int) place, kept[i][1] id, kept[i][6] score from l, range(1, 7) q(i) where i <= len(kept)""")
def candidates_apart(spark, d):
    return regions.best_apart(_marks(spark, d), "page", ["id"], overlap=0.05).select("page", "place", "id", "score")


@query(f"""with {_MARKS}, c as (select *, row_number() over (partition by page order by score desc, id) place, (id * 7 % 100) / 100.0::double confidence from m), s as (select *, greatest(0, least(x + w, 240) - greatest(x, 100)) * greatest(0, least(y + h, 260) - greatest(y, 80)) both_ from c),
u as (select page, place, id, confidence + 0.4 * (both_ / (w * h + 140 * 180 - both_)) merit from s) select page, place, id, round(merit, 9) merit from u qualify row_number() over (partition by page order by merit desc, place) = 1""")
def candidate_by_merit(spark, d):
    from pyspark.sql import Window

    measured = _marks(spark, d).withColumns({"place": F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "id")), "confidence": F.col("id") * 7 % 100 / 100})
    hints = table(spark, d, "orders").select(F.expr("o_orderkey div 40").alias("page")).distinct().select("page", *(F.lit(float(v)).alias(c) for c, v in zip("xywh", (100, 80, 140, 180), strict=True)))
    return regions.best_by_merit(measured, "page", hints, 0.4).select("page", "place", "id", F.round("merit", 9).alias("merit"))


@query(f"""with recursive {_MARKS}, r as (select 0 k, page, id, x x0, y y0, x + w x1, y + h y1 from m union all
select a.k + 1, a.page, a.id, min(b.x0), min(b.y0), max(b.x1), max(b.y1) from r a join r b on a.page = b.page and greatest(a.x0 - b.x1, b.x0 - a.x1) <= 6 and greatest(a.y0 - b.y1, b.y0 - a.y1) <= 4 where a.k < 14 group by a.k, a.page, a.id),
g as (select distinct page, id, min(id) over (partition by page, x0, y0, x1, y1) grp, x0, y0, x1, y1 from r where k = 14)
select m.page, m.id, grp as "group", x0 x, y0 y, x1 - x0 w, y1 - y0 h from m join g on g.page = m.page and g.id = m.id""")
def near_box_groups(spark, d):
    """Marks within 6 across and 4 down of each other, joint boxes included."""
    return regions.near_groups(_marks(spark, d), "page", 6.0, 4.0)


@query(f"with {_MARKS}, z(region, zx, zy, zw, zh) as (values (1, 0, 0, 200, 150), (2, 150, 100, 247, 200), (3, 50, 20, 60, 280)) select page, id, region from m, z where x >= zx and y >= zy and x + w <= zx + zw and y + h <= zy + zh")
def boxes_within(spark, d):
    zones = F.array(*(F.struct(F.lit(k).alias("region"), *(F.lit(float(v)).alias(c) for c, v in zip("xywh", z, strict=True))) for k, z in enumerate(((0, 0, 200, 150), (150, 100, 247, 200), (50, 20, 60, 280)), 1)))
    marks = _marks(spark, d)
    return regions.within(marks, marks.select("page").distinct().select("page", F.inline(zones)), "page")


# ---- paper

_PAPER = {"lightness": "200 + (x * p_size + y * 5 + p_partkey) % 23", "chroma": "(x * 3 + y * p_size) % 17", "texture": "(x * y + p_partkey) % 7", "ink": "(x + y * 3 + p_partkey) % 97 < p_size % 4 and x > p_size % 30"}
_W, _H = 45, 29


def _sheet(spark, d, values: dict[str, str]) -> DataFrame:
    """Pixels of a raster of each part, dealt out by raster before they are made."""
    part = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", _W * _H)
    at = part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(_H - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(_W - 1))).alias("x"))
    return at.select(F.col("p_partkey").alias("raster_id"), "y", "x", *(F.expr(v).alias(n) for n, v in values.items()))


@query(f"""with px as (select p_partkey raster_id, y, x, {', '.join(f'{v} {n}' for n, v in _PAPER.items())} from part, range({_H}) a(y), range({_W}) b(x)),
t as (select raster_id, y // 7 ty, x // 7 tx, avg(lightness) level, var_pop(lightness) variance, stddev_pop(chroma) chroma, stddev_pop(texture) grain, avg(texture) texture, avg(cast(ink as int)) dark, count(*) n from px group by 1, 2, 3),
k as (select t.* from t join part on p_partkey = raster_id where n = 49 and dark <= 0.02 and not (p_size % 20 < (tx + 1) * 7 and p_size % 20 + 9 > tx * 7 and 3 < (ty + 1) * 7 and 12.5 > ty * 7)),
s as (select raster_id, median(level) a, greatest(0.5, median(sqrt(variance))) b, greatest(0.5, median(chroma)) c, greatest(0.5, median(grain)) d, greatest(1, list_sort(list(variance))[1 + cast(floor(0.85 * (count(*) - 1) + 0.5) as int)]) e, greatest(0.25, median(texture)) f, count(*) n from k group by 1 having count(*) >= 12)
select p_partkey raster_id, round(coalesce(a, 220), 6) paper_level, round(coalesce(b, 12), 6) sigma_lightness, round(coalesce(c, 8), 6) sigma_chroma, round(coalesce(d, 6), 6) sigma_texture, round(coalesce(e, 260), 6) variance_p85, round(coalesce(f, 8), 6) texture_level, coalesce(n, 0) tiles, round(coalesce(n / 24.0, 0), 6) paper_fraction
from part left join s on p_partkey = raster_id""")
def paper_figures(spark, d):
    """Tiles of 7 pixels, less those under a photo's box and those with ink."""
    part = table(spark, d, "part")
    sizes = part.select(F.col("p_partkey").alias("raster_id"), F.lit(_W).alias("width"), F.lit(_H).alias("height"))
    photo = part.select(F.col("p_partkey").alias("raster_id"), (F.col("p_size") % 20).alias("x"), F.lit(3.0).alias("y"), F.lit(9.0).alias("w"), F.lit(9.5).alias("h"))
    out = regions.paper_statistics(_sheet(spark, d, _PAPER), sizes, photo, side=7)
    return out.select("raster_id", *(c if c == "tiles" else F.round(c, 6).alias(c) for c in regions.PESSIMISTIC))


_COLOURS = {"r": "(x * 11 + y * 7 + p_partkey) % 256", "g": "(x * 5 + y * 13 + p_size * 3) % 241", "b": "(x * y + p_partkey * 7) % 199"}


@query(f"""with px as (select p_partkey raster_id, y, x, p_size, {', '.join(f'{v} {n}' for n, v in _COLOURS.items())} from part, range({_H}) a(y), range({_W}) b(x)),
h as (select *, 12 + p_size % 5 hx, 10 hy, 8 hw, 6 + p_size % 3 hh from px), q as (select *, floor(hx - 0.9 * hw + 0.5) ox, floor(hy - 0.9 * hh + 0.5) oy, floor(hw + 1.8 * hw + 0.5) ow, floor(hh + 1.8 * hh + 0.5) oh, floor(hx - 0.25 * hw + 0.5) ix, floor(hy - 0.25 * hh + 0.5) iy, floor(hw + 0.5 * hw + 0.5) iw, floor(hh + 0.5 * hh + 0.5) ih from h),
s as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b l from q where x >= ox and x < ox + ow and y >= oy and y < oy + oh and not (x >= ix and x < ix + iw and y >= iy and y < iy + ih) and (x - greatest(0, ox)) % 2 = 0 and (y - greatest(0, oy)) % 2 = 0 and x < 30),
o as (select *, row_number() over (partition by raster_id order by l, y, x) k, count(*) over (partition by raster_id) n from s), u as (select * from o where k > n // 2 and n >= 16),
m as (select raster_id, list_sort(list(r))[1 + count(*) // 2] r, list_sort(list(g))[1 + count(*) // 2] g, list_sort(list(b))[1 + count(*) // 2] b, list_sort(list(l))[1 + count(*) // 2] l from u group by 1),
d as (select u.raster_id, list_sort(list(abs(u.l - m.l)))[1 + count(*) // 2] spread from u join m using (raster_id) group by 1)
select p_partkey raster_id, round(coalesce(r, 240), 6) r, round(coalesce(g, 240), 6) g, round(coalesce(b, 240), 6) b, round(coalesce(l, 240), 6) luminance, round(coalesce(spread, 4), 6) spread from part left join m on m.raster_id = p_partkey left join d on d.raster_id = p_partkey""")
def paper_near_hints(spark, d):
    hints = table(spark, d, "part").select(F.col("p_partkey").alias("raster_id"), F.expr("12 + p_size % 5").alias("x"), F.lit(10).alias("y"), F.lit(8).alias("w"), F.expr("6 + p_size % 3").alias("h"), F.lit(_W).alias("width"), F.lit(_H).alias("height"))
    seen = hints.select("raster_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(30).alias("w"), F.lit(_H).alias("h"))
    out = regions.local_paper(_sheet(spark, d, _COLOURS), hints, seen)
    return out.select("raster_id", *(F.round(c, 6).alias(c) for c in regions.PLAIN_PAPER))


_BALANCED = _COLOURS | {"ink": "(x + y) % (2 + p_size % 3) <> 0 or p_size = 7"}


@query(f"""with px as (select p_partkey raster_id, y, x, {', '.join(f'{v} {n}' for n, v in _BALANCED.items())} from part, range({_H}) a(y), range({_W}) b(x)),
v as (select raster_id, 'r' plane, r v from px where not ink union all select raster_id, 'g', g from px where not ink union all select raster_id, 'b', b from px where not ink),
k as (select raster_id, plane, v, count(*) over (partition by raster_id, plane order by v range between unbounded preceding and current row) seen, count(*) over (partition by raster_id, plane) n from v),
g as (select raster_id, plane, case when n < {_W * _H} * 0.05 or min(v) < 20 then 1 else greatest(0.8, least(1.25, 245 / min(v))) end gain from k where seen >= n * 0.95 group by raster_id, plane, n),
o as (select px.*, coalesce(a.gain, 1) gr, coalesce(b.gain, 1) gg, coalesce(c.gain, 1) gb from px left join g a on a.raster_id = px.raster_id and a.plane = 'r' left join g b on b.raster_id = px.raster_id and b.plane = 'g' left join g c on c.raster_id = px.raster_id and c.plane = 'b')
select raster_id, cast(sum(cast(least(255, round_even(r * gr, 0)) as bigint) * (1 + x)) as bigint) r, cast(sum(cast(least(255, round_even(g * gg, 0)) as bigint) * (1 + x)) as bigint) g, cast(sum(cast(least(255, round_even(b * gb, 0)) as bigint) * (1 + x)) as bigint) b from o group by 1""")
def white_balance(spark, d):
    """Weighted sums of the balanced planes; parts of size 7 show no paper."""
    out = regions.white_balanced(_sheet(spark, d, _BALANCED))
    return out.groupBy("raster_id").agg(*(F.sum(F.col(c) * (1 + F.col("x"))).alias(c) for c in "rgb"))


@query("with recursive " + PX[5:] + """, s as (select raster_id, y, x from px where v > 140), form as (select distinct raster_id, p.y + a.d y, p.x + b.d x from px p, range(-1, 2) a(d), range(-1, 2) b(d) where (p.x * 5 + p.y * 3 + raster_id) % 11 = 0),
r as (select raster_id, y, x, y * 8 + x as seed from s union select s.raster_id, s.y, s.x, r.seed from r join s on s.raster_id = r.raster_id and abs(s.y - r.y) <= 1 and abs(s.x - r.x) <= 1),
l as (select raster_id, y, x, min(seed) seed from r group by 1, 2, 3), a as (select l.raster_id, seed, count(*) n, count(*) filter (form.x is null) rest from l left join form on form.raster_id = l.raster_id and form.y = l.y and form.x = l.x group by 1, 2)
select l.raster_id, l.y, l.x from l join a on a.raster_id = l.raster_id and a.seed = l.seed where rest > 0 and rest >= 0.4 * n""")
def differential_ink(spark, d):
    """Strokes of which at least four tenths lie outside a blank form's ink, grown by one pixel."""
    scans = packed_rasters(spark, d)
    labels = packed.pixels(packed.mapped(scans, lambda a: {"label": rasters.labelled(a > 140)}, "label array<int>"), "label").where("label > 0")
    form = scans.withColumn("values", F.transform("values", lambda _, i: ((i % 8 * 5 + F.floor(i / 8) * 3 + F.col("raster_id")) % 11 == 0).cast("int")))
    printed = packed.pixels(packed.mapped(form, lambda a: {"ink": packed.extreme(a, 1, 1, True)}, "ink array<int>"), "ink").where("ink > 0")
    return regions.new_ink(labels, printed, 0.4).select("raster_id", "y", "x")


@query("with recursive " + PX[5:] + """, s as (select raster_id, y, x from px where v < 110),
r as (select raster_id, y, x, y * 8 + x as seed from s union select s.raster_id, s.y, s.x, r.seed from r join s on s.raster_id = r.raster_id and abs(s.y - r.y) + abs(s.x - r.x) = 1),
l as (select raster_id, y, x, min(seed) seed from r group by 1, 2, 3), t as (select raster_id, seed, count(*) filter (y = 0) a, count(*) filter (y = 7) b, count(*) filter (x = 0) c, count(*) filter (x = 7) e from l group by 1, 2)
select l.raster_id, l.y, l.x from l join t on t.raster_id = l.raster_id and t.seed = l.seed where cast(a > 0 as int) + cast(b > 0 as int) + cast(c > 0 as int) + cast(e > 0 as int) >= 2 or greatest(a, b, c, e) / 8 >= 0.85""")
def border_regions(spark, d):
    """Dark regions that reach the border along two sides or most of one."""
    dark = packed.pixels(packed_rasters(spark, d), "values").where("values < 110").select("raster_id", "y", "x")
    return regions.border_regions(dark, packed_rasters(spark, d).select("raster_id", "width", "height"))


@query(PX + """, z(region, zx, zy, zw, zh) as (values (1, 1, 2, 4, 5), (2, 5, 5, 9, 9), (3, 9, 0, 3, 3)), every as (select raster_id from px group by 1)
select every.raster_id, region, round(coalesce(avg(v), 0), 9) v, round(coalesce(avg(cast(v < 128 as int)), 0), 9) ink from every cross join z left join px p on p.raster_id = every.raster_id and x >= zx and x < zx + zw and y >= zy and y < zy + zh group by 1, 2""")
def region_means(spark, d):
    zones = F.array(*(F.struct(F.lit(k).alias("region"), *(F.lit(v).alias(c) for c, v in zip("xywh", z, strict=True))) for k, z in enumerate(((1, 2, 4, 5), (5, 5, 9, 9), (9, 0, 3, 3)), 1)))
    scans = packed_rasters(spark, d)
    px = packed.pixels(scans, "values").select("raster_id", "y", "x", F.col("values").alias("v"), (F.col("values") < 128).alias("ink"))
    out = regions.region_means(px, scans.select("raster_id", F.inline(zones)), "v", "ink")
    return out.select("raster_id", "region", F.round("v", 9).alias("v"), F.round("ink", 9).alias("ink"))


@query("""with f as (select p_partkey, p_size / 50.0::double c, 1 + p_size % 9 / 10.0::double t, p_partkey % 60 / 100.0::double s, p_partkey % 4 m, 0.6 + p_size % 5 / 10.0::double q, 25 + p_size % 20 * 1.0::double a, 30 + p_partkey % 30 * 1.0::double b, p_partkey % 3 = 0 grey from part),
g as (select *, least(a, b) lo, greatest(a, b) hi from f), h as (select *, case when lo / 35 between 0.72 and 1.35 and hi / 45 between 0.72 and 1.35 then 1 - least(1, (abs(1 - lo / 35) + abs(1 - hi / 45)) / (1.35 - 0.72)) else 0 end fit, abs(lo / hi - 35 / 45.0::double) / (35 / 45.0::double) err from g),
k as (select *, greatest(fit, case when err <= 0.15 then 1 - err / 0.15 else 0 end) best from h)
select p_partkey, round(0.3 * greatest(0, least(1, (c - 0.35) / 0.45)) + 0.22 * greatest(0, least(1, (t - 1.15) / 0.65)) + 0.2 * greatest(0, least(1, (s - 0.2) / 0.3)) + 0.16 * (0.5 * greatest(0, least(1, (q - 0.7) / 0.25)) + 0.5 * best)
+ 0.12 * case when grey then greatest(0, least(1, (s - 0.18) / 0.27)) else greatest(0, least(1, (m - 1) / 2.0::double)) end, 8) score, c < 0.45 and s < 0.35 as is_empty from k""")
def photo_content(spark, d):
    """Scores of regions from their figures, and whether they are asserted to be empty."""
    p, real = table(spark, d, "part"), lambda c: F.expr(c).cast("double")
    c, t, s, q, a, b = map(real, ("p_size / 50", "1 + p_size % 9 / 10", "p_partkey % 60 / 100", "0.6 + p_size % 5 / 10", "25 + p_size % 20", "30 + p_partkey % 30"))
    short, long = F.least(a, b), F.greatest(a, b)
    fit = F.greatest(photo.size_fit(short, long, (35.0, 45.0), (0.72, 1.35)), photo.aspect_fit(short, long, (35.0, 45.0)))
    score = photo.content_score(c, t, s, F.col("p_partkey") % 4, q, fit, F.col("p_partkey") % 3 == 0)
    return p.select("p_partkey", F.round(score, 8).alias("score"), photo.is_empty(c, s).alias("is_empty"))


@query("""with t as (select p_partkey, unnest([{'s': 0, 'n': 90, 't': p_size % 5 - 2.0::double, 'w': 0.9::double, 'x': 10.0::double, 'y': 50.0::double}, {'s': 1, 'n': 0, 't': p_partkey % 4 - 1.5::double, 'w': 0.5 + p_size % 4 / 10.0::double, 'x': 60.0::double, 'y': 12.0::double},
{'s': 2, 'n': 90, 't': p_partkey % 23 - 11.3::double, 'w': 0.3::double, 'x': 110.0::double, 'y': 50.0::double}, {'s': 3, 'n': 0, 't': 1.0::double, 'w': 0.1::double, 'x': 60.0::double, 'y': 88.0::double}], recursive := true) from part),
m as (select p_partkey, arg_max(t, (w, -s)) anchor from t group by 1), k as (select p_partkey, sum(w * t) / sum(w) turn from t join m using (p_partkey) where abs(t - anchor) <= 8 group by 1 having count(*) >= 2),
l as (select p_partkey, s, -sin(radians(n + turn)) a, cos(radians(n + turn)) b, x + (1 + s) * sin(radians(n + t)) px, y - (1 + s) * cos(radians(n + t)) py from t join k using (p_partkey)), c as (select *, -(a * px + b * py) c from l),
j as (select p.p_partkey, z.i, (p.b * q.c - q.b * p.c) / (p.a * q.b - q.a * p.b) x, (q.a * p.c - p.a * q.c) / (p.a * q.b - q.a * p.b) y from (values (1, 0, 1), (2, 2, 1), (3, 2, 3), (4, 0, 3)) z(i, u, v) join c p on p.s = z.u join c q on q.p_partkey = p.p_partkey and q.s = z.v)
select p_partkey, i corner, round(x, 5) x, round(y, 5) y from j""")
def squared_edges(spark, d):
    """Edges that pass their sides' middles at 1 to 4 pixels, turned each by its own angle; the third may stray."""
    size, key = F.col("p_size"), F.col("p_partkey")
    turns = {"left": size % 5 - 2.0, "top": key % 4 - 1.5, "right": key % 23 - 11.3, "bottom": F.lit(1.0)}
    weights = {"left": F.lit(0.9), "top": 0.5 + size % 4 / 10.0, "right": F.lit(0.3), "bottom": F.lit(0.1)}
    middles = {s: (F.lit(x), F.lit(y)) for s, x, y in (("left", 10.0, 50.0), ("top", 60.0, 12.0), ("right", 110.0, 50.0), ("bottom", 60.0, 88.0))}

    def edge(side: str, off: int):
        phi, (x, y) = F.radians(turns[side] + photo.NOMINAL[side]), middles[side]
        return F.struct((-F.sin(phi)).alias("a"), F.cos(phi).alias("b"), (F.sin(phi) * x - F.cos(phi) * y + off).alias("c"))

    edges = table(spark, d, "part").select("p_partkey", "p_size", *(edge(s, k).alias(s) for k, s in enumerate(photo.NOMINAL, 1)))
    q = edges.select("p_partkey", photo.squared_up({s: F.col(s) for s in photo.NOMINAL}, weights, middles).alias("q"))
    return q.select("p_partkey", F.posexplode("q").alias("i", "p")).select("p_partkey", (F.col("i") + 1).alias("corner"), F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))
