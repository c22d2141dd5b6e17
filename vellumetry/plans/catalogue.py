"""The registered queries over the given tables, with the SQL that checks them.

The tables stand in for the records and scans of the domain: events for saved records, documents for texts, parts for
printed options, lineitem for boxes, embeddings for 8 x 8 rasters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.functions import boxes, text
from vellumetry.operators import packed, rasters, records
from vellumetry.plans.registry import query
from vellumetry.sources.tables import packed_rasters, pixels, table

FLAGSHIP = "raster_sauvola"
KEY = ["l_orderkey", "l_linenumber"]


# ---- records

@query("select event_id, user_id, event_type from events order by ts desc, event_id limit 500")
def record_list(spark, d):
    return records.newest(table(spark, d, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("select event_id, user_id from events where event_type = 'click' order by ts desc, event_id limit 500")
def record_list_by_form(spark, d):
    return records.newest(table(spark, d, "events").where("event_type = 'click'"), "ts", "event_id").select("event_id", "user_id")


@query("select doc_id from documents where contains(lower(concat_ws(' ', source, lang, text)), 'the edou')")
def record_search(spark, d):
    return records.search(table(spark, d, "documents"), " The EDOU ", ["source", "lang", "text"]).select("doc_id")


@query("""select t.event_type, count(e.event_id) n from (select distinct event_type from events) t
left join (select * from events where value > 50) e on e.event_type = t.event_type group by 1
union all select null, count(*) from events where value > 50""")
def record_facets(spark, d):
    e = table(spark, d, "events")
    return records.facets(e.where("value > 50"), "event_type", e.select("event_type").distinct())


@query("""select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events)
where k = 1 and event_type <> 'error'""")
def record_latest(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return records.latest(log, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type", "value")


@query("""select c_custkey, trim(c_name) title, upper(left(trim(c_name), 1)) initials,
case when n_name is null then c_mktsegment else n_name || ' · ' || c_mktsegment end summary
from customer left join nation on c_nationkey = n_nationkey""")
def record_titles(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", text.trimmed(F.col("c_name")).alias("title"), text.initials(F.col("c_name")).alias("initials"), text.summary([F.col("n_name"), F.col("c_mktsegment")]).alias("summary"))


@query("""select doc_id, length(t) n, md5(t) digest from (select doc_id, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'[\\x00-\\x09\\x0B-\\x1F\\x7F]', '', 'g'), '[ \\x{00A0}]+', ' ', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g'), ' *\\n[ \\n]*', ', ', 'g'), 1, 2000) t from documents)""")
def clean_answers(spark, d):
    c = text.clean(F.col("text"), False)
    return table(spark, d, "documents").select("doc_id", F.char_length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("""select p_partkey, case when o.p is null then p_type else o.p end as answer, o.p is null as off_list
from part left join (select regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') k, min(p_type) p from part where p_size < 3 group by 1) o
on o.k = regexp_replace(lower(p_type || '. ' || case when p_size % 5 = 0 then 'x' else '' end), '[^a-z0-9]+', '', 'g')""")
def option_match(spark, d):
    part = table(spark, d, "part")
    options = part.where("p_size < 3").groupBy(text.option_key(F.col("p_type")).alias("k")).agg(F.min("p_type").alias("printed"))
    joined = part.join(options, text.option_key(F.concat("p_type", F.lit(". "), F.when(F.col("p_size") % 5 == 0, "x").otherwise(""))) == F.col("k"), "left")
    return joined.select("p_partkey", F.coalesce("printed", "p_type").alias("answer"), F.col("printed").isNull().alias("off_list"))


@query("""with w as (select *, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b from part)
select p_partkey, case when p_size % 3 > 0 then p_name when a = b then a else a || ', ' || b end checklist from w""")
def checklist_answers(spark, d):
    words = F.split("p_name", " ")
    first, second = words[0], words[1]
    raw = F.when(F.col("p_size") % 3 == 0, F.concat_ws(";", first, second, F.upper(first))).otherwise(F.concat("p_name", F.lit(" ,\n")))
    return table(spark, d, "part").select("p_partkey", text.checklist(raw).alias("checklist"))


@query("""select l_orderkey, l_linenumber, case l_returnflag when 'N' then 'No' else l_returnflag end returned,
case l_linestatus when 'O' then 'Yes' else 'No' end as is_open from lineitem""")
def yes_no_answers(spark, d):
    status = F.when(F.col("l_linestatus") == "O", "ticked").otherwise(" 0 ")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.yes_no(F.col("l_returnflag")).alias("returned"), text.yes_no(status).alias("is_open"))


_READINGS = """with a as (select doc_id, case when n_chars >= 1500 then '1' when n_chars >= 400 then '' end as value from documents),
b as (select doc_id, cast(quality as varchar) as value from labels)
"""


@query(_READINGS + """select coalesce(a.doc_id, b.doc_id) doc_id,
case when a.doc_id is null then coalesce(b.value, '') when b.doc_id is null or coalesce(a.value, '') <> '' then coalesce(a.value, '') else coalesce(b.value, '') end as value,
case when a.doc_id is not null and b.doc_id is not null and coalesce(a.value, '') <> coalesce(b.value, '') then case when coalesce(a.value, '') = '' then '' else coalesce(b.value, '') end end as alternative,
case when a.doc_id is null then b.value is null else a.value is null and (b.doc_id is null or coalesce(b.value, '') = '') end as unreadable
from a full outer join b on a.doc_id = b.doc_id""")
def reconcile_readings(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    a = docs.select("doc_id", F.when(F.col("n_chars") >= 1500, "1").when(F.col("n_chars") >= 400, "").alias("value"))
    b = labels.select("doc_id", F.col("quality").cast("string").alias("value"))
    return records.reconciled(a, b, ["doc_id"], "number").select("doc_id", "value", "alternative", "unreadable")


@query("""select a.c_custkey, a.c_custkey % 2 = 1 as same_text, regexp_replace(a.c_name, '[^0-9]', '', 'g') = regexp_replace(b.c_name, '[^0-9]', '', 'g') as same_number
from customer a join customer b on a.c_custkey = b.c_custkey + 1""")
def agreement(spark, d):
    c = table(spark, d, "customer")
    b = c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_name").alias("other"))
    j = c.join(b, "c_custkey")
    return j.select("c_custkey", text.same_reading(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("("), F.upper("c_name"), F.lit(")."))).otherwise(F.col("other")), "text").alias("same_text"), text.same_reading(F.col("c_name"), F.col("other"), "phone").alias("same_number"))


@query("""select o_orderkey, regexp_full_match('SCH-' || left(o_orderpriority, 1) || right('00000' || o_orderkey, greatest(5, length(o_orderkey::varchar))) || case when o_orderstatus = 'F' then 'I' else '' end,
'[A-Z]{2,5}-[0-9A-HJKMNP-TV-Z]{6}') as is_ref from orders""")
def reference_check(spark, d):
    """Some are references, some too long, some end in a letter that the code leaves out."""
    key = F.col("o_orderkey").cast("string")
    code = F.concat(F.lit("SCH-"), F.substring("o_orderpriority", 1, 1), F.lpad(key, F.greatest(F.lit(5), F.length(key)), F.lit("0")), F.when(F.col("o_orderstatus") == "F", "I").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", text.is_reference(code).alias("is_ref"))


@query("""with recursive e as (select user_id, event_id, epoch_ms(ts) t, row_number() over (partition by user_id order by epoch_ms(ts), event_id) k from events),
r as (select user_id, event_id, k, true as admitted, t last, cast(null as bigint) earlier from e where k = 1 union all
select n.user_id, n.event_id, n.k, ok, case when ok then t else last end, case when ok then last else earlier end
from (select e.*, r.last, r.earlier, r.earlier is null or e.t - r.earlier >= 86400000 ok from r join e on e.user_id = r.user_id and e.k = r.k + 1) n)
select user_id, event_id, admitted from r""")
def admissions(spark, d):
    """At most 2 a user within a day, refused ones holding no slot."""
    e = table(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_id")
    return records.admitted(e, "user_id", "at_ms", "event_id", 2, 86_400_000)


@query("""select doc_id, true as readable, cast(null as varchar) as error_code, lang as answer, 3 as n_fields from documents
where doc_id % 4 <> 3 union all select doc_id, null, 'reader_reply_invalid', null, null from documents where doc_id % 4 = 3""")
def parse_replies(spark, d):
    """Replies wrapped bare, fenced, in talk, or broken, by doc_id."""
    body = F.to_json(F.struct(F.struct(F.col("lang"), F.col("n_chars").alias("size"), F.lit(True).alias("ok")).alias("fields")))
    kind = F.col("doc_id") % 4
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.concat(body, F.lit(" } trailing")))
    out = records.parsed_replies(table(spark, d, "documents").select("doc_id", reply.alias("reply")))
    return out.select("doc_id", "readable", "error_code", F.try_element_at("fields", F.lit("lang")).alias("answer"), F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"))


# ---- boxes

_BOX = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def _box(p: str) -> tuple:
    return tuple(F.col(f"{p}.{c}") for c in ("x", "y", "w", "h"))


def _line_boxes(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 10).alias("w"), (F.col("l_partkey") % 50 + 1).cast("double").alias("h")).alias("box"))


_LINE_BOXES = "select l_orderkey, l_linenumber, l_quantity x, l_discount * 100 y, l_tax * 100 + 10 w, cast(l_partkey % 50 + 1 as double) h from lineitem"


@query(f"""with b as ({_LINE_BOXES}), p as (select a.l_orderkey, a.l_linenumber, a.w * a.h aa, b.w * b.h bb,
greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) i
from b a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber)
select l_orderkey, l_linenumber, round(i / (aa + bb - i), 9) iou, round(i / aa, 9) as inside from p""")
def box_iou(spark, d):
    b = _line_boxes(spark, d)
    nxt = F.array_agg("box").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))
    j = b.withColumn("others", nxt).withColumn("other", F.explode("others"))
    return j.select("l_orderkey", "l_linenumber", F.round(boxes.iou(_box("box"), _box("other")), 9).alias("iou"), F.round(boxes.containment(_box("box"), _box("other")), 9).alias("inside"))


@query(f"""with b as ({_LINE_BOXES}), q as (select *, floor(greatest(0, x - 3.5)) x0, floor(greatest(0, y - 3.5)) y0 from b)
select l_orderkey, l_linenumber, cast(x0 as bigint) x, cast(y0 as bigint) y, cast(greatest(0, least(60, ceil(x + w + 3.5)) - x0) as bigint) w, cast(greatest(0, least(40, ceil(y + h + 3.5)) - y0) as bigint) h from q""")
def box_pad_clip(spark, d):
    out = boxes.padded(*_box("box"), F.lit(3.5), F.lit(60), F.lit(40))
    return _line_boxes(spark, d).withColumn("p", out).select("l_orderkey", "l_linenumber", *(F.col(f"p.{c}").cast("long").alias(c) for c in "xywh"))


@query("""with c as (select p_partkey, p_retailprice a, p_size * 20.0 b, p_size * 1.0 c, p_retailprice / 2 e, greatest(p_retailprice, p_size * 20.0) top from part),
s as (select *, case when top <= 1 then 1.0 when top > 1000 then 2000.0 else 1000.0 end sx, case when top <= 1 then 1.0 when top > 1000 then 1500.0 else 1000.0 end sy from c),
n as (select p_partkey, greatest(0, least(1, least(a, c) / sx)) l, greatest(0, least(1, greatest(a, c) / sx)) r, greatest(0, least(1, least(b, e) / sy)) t, greatest(0, least(1, greatest(b, e) / sy)) u from s)
select p_partkey, round(l, 9) x, round(t, 9) y, round(r - l, 9) w, round(u - t, 9) h from n where r > l and u > t""")
def box_normalize(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    b = boxes.normalized(price, size * 20, size, price / 2, F.lit(2000), F.lit(1500))
    return table(spark, d, "part").select("p_partkey", b.alias("b")).where("b is not null").select("p_partkey", *(F.round(f"b.{c}", 9).alias(c) for c in "xywh"))


@query("""select p_partkey, i as band, floor(i * (len - size) + 0.5) as start, size from (select p_partkey, p_retailprice len, floor(p_retailprice * 1.16 / 2 + 0.5) size from part), range(2) r(i)""")
def band_geometry(spark, d):
    b = F.explode(boxes.bands(F.col("p_retailprice"), 2, 0.16)).alias("b")
    return table(spark, d, "part").select("p_partkey", b).select("p_partkey", F.col("b.band").cast("long").alias("band"), F.col("b.start").cast("double").alias("start"), F.col("b.size").cast("double").alias("size"))


_M = [1.1, 0.02, 3.0, -0.05, 0.9, 7.0, 1e-4, 2e-4, 1.0]


@query("""select l_orderkey, l_linenumber, round((1.1 * x + 0.02 * y + 3.0) / (1e-4 * x + 2e-4 * y + 1.0), 6) px, round((-0.05 * x + 0.9 * y + 7.0) / (1e-4 * x + 2e-4 * y + 1.0), 6) py
from (select l_orderkey, l_linenumber, l_quantity x, l_discount * 100 y from lineitem)""")
def homography_points(spark, d):
    p = boxes.through_homography(_M, F.col("box.x"), F.col("box.y"))
    return _line_boxes(spark, d).withColumn("p", p).select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("""with p as (select r_regionkey k, unnest([0, 1, 2, 3]) i from region), c as (select k, i, case i when 0 then 10 + k when 1 then 90 - k when 2 then 95 else 5 end x, case i when 0 then 12 when 1 then 8 + k when 2 then 88 else 92 - k end y from p)
select o.o_orderkey, min_by(x, x + y) tlx, min_by(y, x + y) tly, max_by(x, x - y) trx, max_by(y, x - y) try_, max_by(x, x + y) brx, max_by(y, x + y) bry, min_by(x, x - y) blx, min_by(y, x - y) bly from orders o join c on c.k = o.o_orderkey % 5 group by 1""")
def quad_corners(spark, d):
    k = (F.col("o_orderkey") % 5).cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(point(F.lit(95), F.lit(88)), point(F.lit(5), 92 - k), point(10 + k, F.lit(12)), point(90 - k, 8 + k))
    q = table(spark, d, "orders").select("o_orderkey", boxes.quad_order(points).alias("q"))
    return q.select("o_orderkey", *(F.col("q")[i][c].alias(n) for i, x, y in ((0, "tlx", "tly"), (1, "trx", "try_"), (2, "brx", "bry"), (3, "blx", "bly")) for c, n in (("x", x), ("y", y))))


# ---- rasters

PX = """with e as (select vec_id, unnest(cast(embedding as double[])) value, generate_subscripts(embedding, 1) - 1 p from embeddings),
m as (select vec_id, min(value) low, max(value) high from e group by 1),
px as (select e.vec_id raster_id, cast(p // 8 as int) y, cast(p % 8 as int) x, cast(round_even((value - low) * 255 / (high - low), 0) as int) v from e join m on e.vec_id = m.vec_id)
"""


def _near(r: int, what: str, source: str = "px") -> str:
    """A neighbour self-join, independent of the window form."""
    return f"select a.raster_id, a.y, a.x, a.v, {what} from {source} a join {source} b on a.raster_id = b.raster_id and b.y between a.y - {r} and a.y + {r} and b.x between a.x - {r} and a.x + {r} group by 1, 2, 3, 4"


def _kernel(spark, d, kernel, layers: str) -> DataFrame:
    """The layers (DDL of arrays) that kernel makes of each packed raster, a row a pixel."""
    return packed.pixels(packed.mapped(packed_rasters(spark, d), kernel, layers), *(x.split()[0] for x in layers.split(", ")))


_STATS = "count(*) n, avg(b.v) m, greatest(0, avg(b.v * b.v * 1.0) - avg(b.v) * avg(b.v)) s2"


@query(PX + "select raster_id, v, count(*) n from px group by 1, 2")
def raster_histogram(spark, d):
    return rasters.histogram(pixels(spark, d))


@query(PX + ", h as (select raster_id, v, count(*) over (partition by raster_id order by v range between unbounded preceding and current row) c from px) select raster_id, min(v) as value from h where c >= 0.9 * 64 group by 1")
def raster_percentile(spark, d):
    return rasters.percentile(pixels(spark, d), 0.9)


@query(PX + """, h as (select raster_id, v, count(*) n from px group by 1, 2),
c as (select a.raster_id, a.v, sum(b.n) filter (b.v <= a.v) n0, sum(b.n * b.v) filter (b.v <= a.v) s0, sum(b.n) nn, sum(b.n * b.v) ss from h a join h b on a.raster_id = b.raster_id group by 1, 2),
k as (select raster_id, v, round(cast(n0 as double) * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) * (s0 / n0 - (ss - s0) / (nn - n0)), 6) b from c where nn > n0)
select raster_id, threshold from (select raster_id, v as threshold, row_number() over (partition by raster_id order by b desc, v) i from k) where i = 1""")
def raster_otsu(spark, d):
    return rasters.otsu(pixels(spark, d))


@query(PX + f"select raster_id, y, x, n, round(m, 6) mean, round(s2, 4) as variance from ({_near(2, _STATS)})")
def raster_box_stats(spark, d):
    made = _kernel(spark, d, lambda a: dict(zip(("n", "mean", "variance"), packed.box_stats(a, 2), strict=True)), "n array<bigint>, mean array<double>, variance array<double>")
    return made.select("raster_id", "y", "x", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query(PX + f"select raster_id, y, x, cast(v <= m * (1 + 0.2 * (sqrt(s2) / 128 - 1)) as int) ink from ({_near(2, _STATS)})")
def raster_sauvola(spark, d):
    return _kernel(spark, d, lambda a: {"ink": packed.sauvola(a, 2, 0.2)}, "ink array<int>")


@query(PX + f"select raster_id, y, x, cast(v <= m - 7 as int) ink from ({_near(2, _STATS)})")
def raster_adaptive_mean(spark, d):
    return _kernel(spark, d, lambda a: {"ink": packed.adaptive_mean(a, 2, 7.0)}, "ink array<int>")


@query(PX + f"select raster_id, y, x, t as v from ({_near(1, 'max(b.v) t')})")
def raster_dilate(spark, d):
    return _kernel(spark, d, lambda a: {"v": packed.extreme(a, 1, 1, True)}, "v array<int>")


@query(PX + f"select raster_id, y, x, t as v from ({_near(1, 'min(b.v) t')})")
def raster_erode(spark, d):
    return _kernel(spark, d, lambda a: {"v": packed.extreme(a, 1, 1, False)}, "v array<int>")


@query(PX + f", s as (select raster_id, y, x, t v from ({_near(1, 'min(b.v) t')})) select raster_id, y, x, t as v from ({_near(1, 'max(b.v) t', 's')})")
def raster_open(spark, d):
    return _kernel(spark, d, lambda a: {"v": packed.extreme(packed.extreme(a, 1, 1, False), 1, 1, True)}, "v array<int>")


@query(PX + f", s as (select raster_id, y, x, t v from ({_near(1, 'max(b.v) t')})) select raster_id, y, x, t as v from ({_near(1, 'min(b.v) t', 's')})")
def raster_close(spark, d):
    return _kernel(spark, d, lambda a: {"v": packed.extreme(packed.extreme(a, 1, 1, True), 1, 1, False)}, "v array<int>")


@query(PX + "select a.raster_id, a.y, a.x, max(b.v) as v from px a join px b on a.raster_id = b.raster_id and a.y = b.y and b.x between a.x - 2 and a.x + 2 group by 1, 2, 3")
def raster_dilate_rect(spark, d):
    return _kernel(spark, d, lambda a: {"v": packed.extreme(a, 0, 2, True)}, "v array<int>")


@query(PX + """, s as (select a.raster_id, a.y, a.x, min(b.v) v from px a join px b on a.raster_id = b.raster_id and a.y = b.y and b.x between a.x - 1 and a.x + 1 group by 1, 2, 3)
select a.raster_id, a.y, a.x, max(b.v) as v from s a join s b on a.raster_id = b.raster_id and a.y = b.y and b.x between a.x - 1 and a.x + 1 group by 1, 2, 3""")
def raster_rules(spark, d):
    """Long horizontal rules: an opening along x only."""
    return _kernel(spark, d, lambda a: {"v": packed.extreme(packed.extreme(a, 0, 1, False), 0, 1, True)}, "v array<int>")


@query(PX + f"select raster_id, y, x, cast(v > 128 and not t as int) edge from ({_near(1, 'bool_and(b.v > 128) t')})")
def raster_boundary(spark, d):
    return _kernel(spark, d, lambda a: {"edge": (a > 128) & (packed.extreme((a > 128).astype(float), 1, 1, False) == 0)}, "edge array<int>")


@query(PX + "select raster_id, y, x, cast(v > 128 or x + y > 7 as int) either, cast(v > 128 and x + y > 7 as int) \"both\", cast(v > 128 and not x + y > 7 as int) minus, cast(v <= 128 as int) inverse from px")
def mask_algebra(spark, d):
    m = pixels(spark, d).select("raster_id", "y", "x", (F.col("v") > 128).alias("a"), (F.col("x") + F.col("y") > 7).alias("b"))
    one = lambda c, n: c.cast("int").alias(n)
    return m.select("raster_id", "y", "x", one(F.col("a") | F.col("b"), "either"), one(F.col("a") & F.col("b"), "both"), one(F.col("a") & ~F.col("b"), "minus"), one(~F.col("a"), "inverse"))


@query("with recursive " + PX[5:] + """, s as (select raster_id, y, x from px where v > 170),
r as (select raster_id, y, x, y * 8 + x as seed from s union select s.raster_id, s.y, s.x, r.seed from r join s on s.raster_id = r.raster_id and abs(s.y - r.y) <= 1 and abs(s.x - r.x) <= 1),
l as (select raster_id, y, x, min(seed) seed from r group by 1, 2, 3)
select raster_id, cast(row_number() over (partition by raster_id order by seed) as int) as label, count(*) area, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, avg(x) cx, avg(y) cy from l group by raster_id, seed having count(*) >= 2""")
def raster_components(spark, d):
    mask = packed_rasters(spark, d).withColumn("values", F.transform("values", lambda v: (v > 170).cast("int")))
    return rasters.components(mask, 2).drop("fill", "aspect")


@query(PX + "select a.raster_id, a.y, a.x, cast(sum(b.v) as bigint) s from px a join px b on a.raster_id = b.raster_id and b.y <= a.y and b.x <= a.x group by 1, 2, 3")
def raster_integral(spark, d):
    return _kernel(spark, d, lambda a: {"s": a.cumsum(0).cumsum(1)}, "s array<bigint>")


@query(PX + """, k(dx, dy, gx, gy) as (values (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1))
select a.raster_id, a.y, a.x, cast(sum(b.v * gx) as bigint) gx, cast(sum(b.v * gy) as bigint) gy, round(sqrt(sum(b.v * gx) ** 2 + sum(b.v * gy) ** 2), 6) magnitude
from px a, k, px b where a.raster_id = b.raster_id and b.x = greatest(0, least(7, a.x + dx)) and b.y = greatest(0, least(7, a.y + dy)) group by 1, 2, 3""")
def raster_sobel(spark, d):
    made = _kernel(spark, d, lambda a: dict(zip(("gx", "gy"), packed.sobel(a), strict=True)), "gx array<bigint>, gy array<bigint>")
    return made.withColumn("magnitude", F.round(F.hypot("gx", "gy"), 6))


@query(PX + f", s as (select raster_id, y, x, cast(round_even(abs(v - m), 0) as int) v from ({_near(1, 'avg(b.v) m')})) select raster_id, y, x, cast(round_even(m, 0) as int) energy from ({_near(4, 'avg(b.v) m', 's')})")
def raster_high_frequency(spark, d):
    def energy(a):
        detail = packed.stored(abs(a - packed.box_stats(a, 1)[1]))
        return {"energy": packed.stored(packed.box_stats(detail, 4)[1])}

    return _kernel(spark, d, energy, "energy array<int>")


@query(PX + "select raster_id, y // 4 as ty, x // 4 as tx, count(*) n, round(avg(v), 6) mean, round(stddev_pop(v), 6) deviation from px group by 1, 2, 3")
def raster_tiles(spark, d):
    return rasters.tiles(pixels(spark, d), 4).select("raster_id", "ty", "tx", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(PX + """, t as (select unnest(range(3)) t), w as (select a.t y, b.t x, p.raster_id, p.v, greatest(0, least((b.t + 1) * 8 / 3.0, p.x + 1.0) - greatest(b.t * 8 / 3.0, p.x)) * greatest(0, least((a.t + 1) * 8 / 3.0, p.y + 1.0) - greatest(a.t * 8 / 3.0, p.y)) w from px p, t a, t b)
select raster_id, cast(y as int) y, cast(x as int) x, cast(round_even(round(sum(v * w) / sum(w), 9), 0) as int) as v from w where w > 1e-12 group by raster_id, y, x""")
def raster_resize(spark, d):
    return _kernel(spark, d, lambda a: {"v": packed.resized(a, 3, 3)}, "v array<int>")


@query(PX + "select raster_id, avg(case when v > 200 then 1.0 else 0.0 end) as saturated, avg(v) as mean, count(*) filter (v > 128) as mask_count from px where x between 1 and 6 and y between 1 and 6 group by 1")
def raster_region_figures(spark, d):
    inside = pixels(spark, d).where("x between 1 and 6 and y between 1 and 6")
    return inside.groupBy("raster_id").agg(F.avg((F.col("v") > 200).cast("double")).alias("saturated"), F.avg("v").alias("mean"), F.count_if(F.col("v") > 128).alias("mask_count"))


@query(PX + "select raster_id, y - 2 as y, x - 3 as x, round(v / 255.0, 9) as value from px where y between 2 and 6 and x between 3 and 7")
def raster_crop_normalized(spark, d):
    px = pixels(spark, d).where("y between 2 and 6 and x between 3 and 7")
    return px.select("raster_id", (F.col("y") - 2).alias("y"), (F.col("x") - 3).alias("x"), F.round(F.col("v") / 255, 9).alias("value"))
