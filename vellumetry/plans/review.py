"""Registered queries on what a reviewer sees and types, answers of the reader's service, polygons and groups of strokes, with
the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumetry.functions import boxes, pages, review
from vellumetry.operators import shapes
from vellumetry.plans.catalogue import _LINE_BOXES, KEY, _box, _line_boxes
from vellumetry.plans.forms import _case
from vellumetry.plans.registry import query
from vellumetry.sources.tables import table


@query("""with f as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_linenumber % 3 = 0 u, l_quantity > 25 n, l_discount > 0.05 o, case when l_partkey % 2 = 0 then l_returnflag else '' end a from lineitem)
select l_orderkey, l_linenumber, l_extendedprice, case when u then 'unreadable' when n then 'uncertain' when o then 'notInOptions' end flag, case when u then 'Could not be read — check the paper'
when n then case when a = '' then 'Read on one pass only, blank on the other — check the paper' else 'Also read as “' || a || '” — check the paper' end when o then 'Not one of the printed options — check the paper' end note, case when l_quantity <= 40 then a end kept from f""")
def review_flags(spark, d):
    """Flags of lines by number, quantity and discount; the note of an uncertain one goes once its value was edited."""
    other = F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).otherwise("")
    flag = review.flag(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") > 25, F.col("l_discount") > 0.05)
    kept = review.still_uncertain(other, F.col("l_quantity"), F.least("l_quantity", F.lit(40.0)))
    return table(spark, d, "lineitem").select(*KEY, "l_extendedprice", flag.alias("flag"), review.note(flag, other).alias("note"), kept.alias("kept"))


@query("""with t as (select *, o_orderkey % 4 k from orders) select o_orderkey, '+91 (' || o_custkey || ') 5-' || o_orderkey || '.' phone, case k when 0 then 'n/a' when 1 then '12:30' else strftime(o_orderdate, '%b %d, %Y') end shown,
case k when 0 then 'image/jpeg' when 1 then 'image/jpeg' when 2 then 'image/webp' else 'image/png' end type, case when k = 3 then 'Enter the patient name before saving.' end error from t""")
def record_entry(spark, d):
    """Typed phones, shown dates, types of stored pictures and the refusal to save a record without its title."""
    k = (F.col("o_orderkey") % 4).cast("int")
    phone = F.concat(F.lit("tel:+91 ("), F.col("o_custkey").cast("string"), F.lit(") x5-"), F.col("o_orderkey").cast("string"), F.lit(".é#"))
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = _case(k, "n/a", "12:30", when, F.concat(when, F.lit("T23:59:59.5Z")))
    path = _case(k, "a.jpg", "a.png.jpeg", "a.webp", "a.JPG")
    title = F.when(k < 3, F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", review.typed_phone(phone).alias("phone"), review.shown_date(date).alias("shown"), review.content_type(path).alias("type"), review.save_error(title, F.lit("Patient name")).alias("error"))


@query("""with d as (select o_orderkey, [(o_orderkey * p) % 97 / 97.0 for p in [3, 5, 7, 11, 13, 17]] r from orders)
select o_orderkey, 'ORD-' || list_aggregate([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', cast(floor(v * 32) as int) + 1, 1) for v in r], 'string_agg', '') as reference from d""")
def new_references(spark, d):
    """References by draws that follow from the key."""
    draws = [(F.col("o_orderkey") * p) % 97 / 97.0 for p in (3, 5, 7, 11, 13, 17)]
    return table(spark, d, "orders").select("o_orderkey", review.new_reference(F.lit("ORD"), draws).alias("reference"))


def _body(k: Column) -> Column:
    """Answers of the service: whole ones, ones of other types, refusals, and text that isn't JSON."""
    quoted = lambda a, c, z: F.concat(F.lit(a), F.col(c), F.lit(z))
    return _case(
        k, quoted('{"choices": [{"message": {"content": "', "c_name", '"}, "finish_reason": "stop"}, {}]}'), '{"choices": []}', '{"choices": [{"message": null, "finish_reason": "length"}]}',
        '{"choices": [{"message": {"content": 5}, "finish_reason": 7}]}', '{"choices": {"0": 1}, "error": "flat"}', quoted("busy: ", "c_name", ""),
        quoted('{"error": {"message": "', "c_mktsegment", '", "code": null, "type": 4, "failed_generation": "{"}}'), F.lit(None).cast("string"),
    )


@query("""with c as (select *, c_custkey % 8 k, c_custkey % 7 h from customer) select c_custkey, case when k = 0 then c_name end content, case k when 0 then 'stop' when 2 then 'length' end reason, case when k = 6 then c_mktsegment end message,
cast(null as varchar) code, cast(null as varchar) type, case when k = 6 then '{' end failed, case k when 5 then 'busy: ' || c_name when 7 then '' when 1 then '{"choices": []}' else 'json' end said,
case h when 0 then 2000.0 when 1 then 7500 when 5 then 30000 end::double wait_ms from c""")
def service_answers(spark, d):
    """Contents, reasons, refusals and asked waits; a long text is shown as 'json'."""
    k, h = (F.col("c_custkey") % 8).cast("int"), (F.col("c_custkey") % 7).cast("int")
    body, header = _body(k), _case(h, "2", " 7.5 ", "", "soon", "-1", "1e3", "Infinity")
    said = F.when(F.col("r.text").startswith("{") & (F.length("r.text") > 15), "json").otherwise(F.col("r.text"))
    t = table(spark, d, "customer").select("c_custkey", body.alias("body"), header.alias("header")).withColumn("r", review.refusal(F.col("body")))
    return t.select(
        "c_custkey", review.message_content(F.col("body")).alias("content"), review.finish_reason(F.col("body")).alias("reason"), "r.message", "r.code", "r.type", F.col("r.failed_generation").alias("failed"), said.alias("said"),
        review.retry_after_ms(F.col("header")).alias("wait_ms"),
    )


@query(f"""with b as ({_LINE_BOXES}) select l_orderkey, l_linenumber, round(greatest(0, x - 30, 20 - x - w), 9) gap_x, round(greatest(0, y - 30, 5 - y - h), 9) gap_y,
round(5 * y + w * h, 6) area, round(sqrt((x - t * 40) ** 2 + (y - t * 9) ** 2), 9) away, round(sqrt((x - 4) ** 2 + (y - 5) ** 2), 9) to_point
from (select *, greatest(0, least(1, (x * 40 + y * 9) / 1681)) t from b)""")
def box_gaps(spark, d):
    """Gaps to the box (20, 5, 10, 25), the area of the quad (0, 0), (10, y - h), (w, y), (0, y + h), and distances to a segment
    and to a single point."""
    x, y, w, h = mine = _box("box")
    n = lambda v: F.lit(float(v))
    gap = boxes.gaps(mine, tuple(n(v) for v in (20, 5, 10, 25)))
    corners = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((n(0), n(0)), (n(10), y - h), (w, y), (n(0), y + h))))
    cols = {"gap_x": (gap["x"], 9), "gap_y": (gap["y"], 9), "area": (pages.polygon_area(corners), 6), "away": (pages.segment_distance(x, y, n(0), n(0), n(40), n(9)), 9), "to_point": (pages.segment_distance(x, y, n(4), n(5), n(4), n(5)), 9)}
    return _line_boxes(spark, d).select(*KEY, *(F.round(c, p).alias(name) for name, (c, p) in cols.items()))


@query(f"""with b as ({_LINE_BOXES}), o as (select *, x - max(x + w) over (p rows between unbounded preceding and 1 preceding) gap, row_number() over p k from b window p as (partition by l_orderkey order by x, y, w, h)),
m as (select l_orderkey, max(gap) most from o group by 1), c as (select l_orderkey, most, min(k) cut from o join m using (l_orderkey) where gap = most group by 1, 2),
s as (select o.*, case when most > -1 then case when k < cut then 1 else 2 end end half from o left join c using (l_orderkey))
select l_orderkey, half, round(min(x), 6) x, round(min(y), 6) y, round(max(x + w) - min(x), 6) w, round(max(y + h) - min(y), 6) h, round(sum(w * h), 3) ink, count(*) boxes from s group by 1, 2""")
def stroke_halves(spark, d):
    """The boxes of an order's lines cut at their widest gap."""
    b = _line_boxes(spark, d).select("l_orderkey", "box.*").withColumn("ink", F.col("w") * F.col("h"))
    joint = shapes.joint_boxes(shapes.halves(b, "l_orderkey"), ["l_orderkey", "half"])
    return joint.select("l_orderkey", "half", *(F.round(c, 6).alias(c) for c in "xywh"), F.round("ink", 3).alias("ink"), "boxes")


@query("""with recursive p as (select l_orderkey k, l_extendedprice x, l_quantity * 997 + l_discount * 31 + l_linenumber / 7.0 y from lineitem), o as (select *, row_number() over (partition by k order by x, y) - 1 i, count(*) over (partition by k) n from p),
one as (select a.k, a.n, arg_max(b.i, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - b.i * 1e-9) f from o a join o b on a.k = b.k and b.i > 0 where a.i = 0 and a.n > 2 group by 1, 2),
two as (select one.k, one.n, f, arg_max(b.i, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - b.i * 1e-9) g from one join o a on a.k = one.k and a.i = f join o b on b.k = one.k group by 1, 2, 3),
l as (select o.k, (i - least(f, g) + o.n) % o.n i, x, y from o join two using (k) union all select o.k, o.n, x, y from o join two using (k) where i = least(f, g)),
s as (select k, 0::bigint a, abs(f - g)::bigint b from two union all select k, abs(f - g), n from two union all select k, case e when 0 then a else m end, case e when 0 then m else b end from (
 select s.k, s.a, s.b, arg_max(l.i, d - l.i * 1e-9) m from s join (select u.k, u.i a, v.i b, w.i, sqrt((w.x - u.x - t * (v.x - u.x)) ** 2 + (w.y - u.y - t * (v.y - u.y)) ** 2) d from l u join l v on u.k = v.k and u.i < v.i join l w on w.k = u.k and w.i > u.i and w.i < v.i,
 lateral (select case when (v.x - u.x) ** 2 + (v.y - u.y) ** 2 < 1e-12 then 0 else greatest(0, least(1, ((w.x - u.x) * (v.x - u.x) + (w.y - u.y) * (v.y - u.y)) / ((v.x - u.x) ** 2 + (v.y - u.y) ** 2))) end t) q) l on l.k = s.k and l.a = s.a and l.b = s.b
 group by 1, 2, 3 having max(d) > 4000) c, (values (0), (1)) z(e))
select k as l_orderkey, count(distinct c.a)::int corners, round(sum(y) / 1000, 3) height from (select distinct k, a from s) c join l using (k) where l.i = c.a group by 1""")
def polygon_outline(spark, d):
    """The lines of an order as the corners of a closed polygon, from left to right, simplified by 4,000 units."""
    p = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 997 + F.col("l_discount") * 31 + F.col("l_linenumber") / 7).alias("y"))

    def kernel(x, y):
        if len(x) < 3:
            return []
        at = shapes.np.lexsort((y, x))
        kept = at[shapes.simplified(x[at], y[at], 4000.0)]
        return [(len(kept), float(y[kept].sum()))]

    out = shapes.by_set(p, "l_orderkey", ["x", "y"], kernel, "corners int, height double")
    return out.select("l_orderkey", "corners", F.round(F.col("height") / 1000, 3).alias("height"))


_MAY_JOIN = "greatest(0, greatest(a.x, c.x) - least(a.x1, c.x1)) <= 4 and greatest(0, greatest(a.y, c.y) - least(a.y1, c.y1)) <= 3 and least(a.x, c.x) >= 0 and least(a.y, c.y) >= 0 and greatest(a.x1, c.x1) <= 45 and greatest(a.y1, c.y1) <= 60"


@query(f"""with recursive b as ({_LINE_BOXES}), o as (select *, row_number() over (partition by l_orderkey order by x, y, w, h) ord from b),
r as (select 0 step, l_orderkey k, ord, x, y, x + w x1, y + h y1, w * h ink, 1 n from o union all select step + 1, k, ord, x, y, x1, y1, ink, n from (
with p as (select a.k, a.step, a.ord i, c.ord j, greatest(0, greatest(a.x, c.x) - least(a.x1, c.x1)) / 4 + greatest(0, greatest(a.y, c.y) - least(a.y1, c.y1)) / 3 as cost from r a join r c on a.k = c.k and a.ord < c.ord where {_MAY_JOIN}),
best as (select k, step, arg_min(i, (cost, i, j)) i, arg_min(j, (cost, i, j)) j from p group by 1, 2)
select r.step, r.k, r.ord, x, y, x1, y1, ink, n from r join best on best.k = r.k where r.ord <> i and r.ord <> j union all
select best.step, best.k, 1000 + best.step, least(a.x, c.x), least(a.y, c.y), greatest(a.x1, c.x1), greatest(a.y1, c.y1), a.ink + c.ink, a.n + c.n from best join r a on a.k = best.k and a.ord = i join r c on c.k = best.k and c.ord = j)),
l as (select * from r qualify step = max(step) over (partition by k))
select k l_orderkey, cast(row_number() over (partition by k order by ink desc, ord) - 1 as int) place, x, y, round(x1 - x, 6) w, round(y1 - y, 6) h, round(ink, 6) ink, cast(n as int) boxes from l""")
def stroke_groups(spark, d):
    """The boxes of an order's lines, joined within (4, 3) inside the box (0, 0, 45, 60); most ink first."""
    b = _line_boxes(spark, d).select("l_orderkey", "box.*").withColumn("ink", F.col("w") * F.col("h"))

    def kernel(*columns):
        at = shapes.np.lexsort(columns[3::-1])
        return [(i, *g[:5], int(g[5])) for i, g in enumerate(shapes.stroke_groups(*(c[at] for c in columns), 4.0, 3.0, (0, 0, 45, 60)).tolist())]

    return shapes.by_set(b, "l_orderkey", [*"xywh", "ink"], kernel, "place int, x double, y double, w double, h double, ink double, boxes int").select("l_orderkey", "place", "x", "y", *(F.round(c, 6).alias(c) for c in ("w", "h", "ink")), "boxes")
