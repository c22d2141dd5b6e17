"""Registered queries on replies of a reader, their reconciliation, and saved records, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import boxes, pages, text
from vellumetry.operators import bodies, records, replies
from vellumetry.plans.registry import query
from vellumetry.sources.tables import table

_FIELDS = """select 'customer' form_id, * from values ('name', 'text', null), ('segment', 'choice', array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')),
('active', 'yesno', null), ('papers', 'checklist', array('Birth Certificate', 'Photo')), ('amount', 'number', null) as f(field, kind, options)"""


def _case(k: Column, *values: Column | str) -> Column:
    """The k-th value, from 0."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), k + 1)


def _replies(spark, d) -> DataFrame:
    """Two replies a customer: six shapes of the first by key, some that saw no form, some broken."""
    k, mkt = (F.col("c_custkey") % 6).cast("int"), F.col("c_mktsegment")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    segment = _case(k, say('"segment": "', F.lower(mkt), '.", '), '"segment": "other", ', '"segment": null, ', '"segment": 5, ', '"segment": {"a": 1}, ', "")
    active = _case(k, "true", '"0"', '"maybe"', "{}", "1", '"हाँ"')
    papers = _case(k, say('["photo", 3, "PHOTO.", "', mkt, '"]'), '"a;b,a"', '{"Photo": true, "X": false, "Y": "yes"}', "7", "[]", "null")
    amount = _case(k, F.col("c_custkey").cast("string"), '[1, "", 2.5]', "1e-7", "true", '"  7 "', "10.0")
    seen = F.when(F.col("c_custkey") % 10 == 9, '"readable": false, ').otherwise("")
    first = say("{", seen, '"fields": {"name": "  ', F.col("c_name"), '\\t x ", ', segment, '"active": ', active, ', "papers": ', papers, ', "amount": ', amount, "}}", F.when(F.col("c_custkey") % 11 == 10, " }").otherwise(" ok"))
    second = say('{"name": "', F.upper("c_name"), ' X.", "segment": "', mkt, '", "active": "yes", "papers": "Photo; ', mkt, '", "amount": ', F.col("c_custkey").cast("string"), "}")
    return table(spark, d, "customer").select("c_custkey", F.lit("customer").alias("form_id"), first.alias("first"), second.alias("second"))


_BOTH = """with c as (select *, c_custkey % 6 k, c_custkey % 10 = 9 or c_custkey % 11 = 10 blind from customer), f as (select c_custkey, blind, 'name' field, c_name || ' x' v, false u, false o, upper(c_name) || ' X.' w from c
union all select c_custkey, blind, 'segment', case k when 0 then c_mktsegment when 1 then 'other' when 3 then '5' else '' end, k in (2, 4), k in (1, 3), c_mktsegment from c
union all select c_custkey, blind, 'active', case k when 1 then 'No' when 2 then 'maybe' when 0 then 'Yes' when 4 then 'Yes' else '' end, k = 3, k = 2, 'Yes' from c
union all select c_custkey, blind, 'papers', case k when 0 then 'Photo, ' || c_mktsegment when 1 then 'a, b' when 2 then 'Photo, Y' else '' end, k in (3, 5), false, 'Photo, ' || c_mktsegment from c
union all select c_custkey, blind, 'amount', case k when 0 then c_custkey::varchar when 1 then '1, 2.5' when 2 then '1e-7' when 3 then 'Yes' when 4 then '7' else '10' end, false, false, c_custkey::varchar from c),
r as (select c_custkey, blind, field, case when blind then '' else v end v, u and not blind u, o and not blind o, w from f)
"""
#: Of the first replies alone: the broken ones have no rows.
_READ = _BOTH.replace("or c_custkey % 11 = 10 blind from customer", "blind from customer where c_custkey % 11 <> 10")


@query(_READ + 'select c_custkey, field, v as "value", u as unreadable, o as off_list from r')
def reply_values(spark, d):
    rows = replies.readings(replies.opened(_replies(spark, d).drop("second"), "first"), spark.sql(_FIELDS), ["c_custkey"])
    return rows.select("c_custkey", "field", "value", "unreadable", "off_list")


@query(_READ + """select c.c_custkey, case when c.c_custkey % 11 = 10 then 'reader_reply_invalid' end error_code, count(r.v) filter (r.v <> '') filled, count(r.v) filter (r.u) unreadable, count(r.v) filter (r.o) off_list
from customer c left join r on r.c_custkey = c.c_custkey group by 1, 2""")
def reply_flags(spark, d):
    o = replies.opened(_replies(spark, d).drop("second"), "first")
    counts = replies.filled(replies.readings(o, spark.sql(_FIELDS), ["c_custkey"]), ["c_custkey"])
    return o.select("c_custkey", "error_code").join(counts, "c_custkey", "left").na.fill(0, ["filled", "unreadable", "off_list"])


@query(_BOTH + """, s as (select *, case when field = 'amount' then regexp_replace(v, '[^0-9]', '', 'g') = regexp_replace(w, '[^0-9]', '', 'g') else lower(replace(v, '.', '')) = lower(replace(w, '.', '')) end same from r)
select c_custkey, field, case when blind or not same and v = '' then w else v end as "value", case when not blind and not same then case when v = '' then '' else w end end as alternative,
not blind and u and not (not same and v = '') as unreadable, not blind and o and not (not same and v = '') as off_list from s""")
def reconcile_forms(spark, d):
    """Fields of five kinds in one call; where the first saw no form, or failed, the second stands alone."""
    both, fields = _replies(spark, d), spark.sql(_FIELDS)
    one, two = (replies.readings(replies.opened(both.drop(o), c), fields, ["c_custkey"]) for c, o in (("first", "second"), ("second", "first")))
    return replies.reconciled_readings(one, two, ["c_custkey"])


@query("""with p as (select p_partkey, p_partkey % 9 k, p_size::double a from part), b as (select *, k < 7 ok from p)
select p_partkey, case when ok then a end x1, case when ok then a + 1.5 end y1, case when ok then a + 20 end x2, case when ok then a + 30 end y2, case when ok and p_partkey % 2 = 0 then 2 end picture from b""")
def reply_boxes(spark, d):
    """The shapes of a box, three numbers and none, under the names that replies use."""
    k, a = (F.col("p_partkey") % 9).cast("int"), F.col("p_size").cast("double")
    n = [v.cast("string") for v in (a, a + 1.5, a + 20, a + 30, F.lit(20.0), F.lit(28.5))]
    listed = F.concat_ws(", ", *n[:4])
    named = lambda names, at: F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{c}": '), n[i]) for c, i in zip(names, at, strict=True))), F.lit("}"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    array = F.concat(F.lit("["), listed, F.lit("]"))
    shapes = [array, q(array), named(("x1", "y1", "x2", "y2"), range(4)), named(("left", "top", "right", "bottom"), range(4)), named(("x", "y", "width", "height"), (0, 1, 4, 5)), F.concat(F.lit('{"bbox_2d": '), array, F.lit("}")), q(listed), F.concat(F.lit("["), F.concat_ws(", ", *n[:3]), F.lit("]")), "null"]
    name, picture = (F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd) for even, odd in (("photo", "photo_box"), ('"2"', "12")))
    reply = F.concat(F.lit('{"'), name, F.lit('": '), _case(k, *shapes), F.lit(', "photoPicture": '), picture, F.lit("}"))
    o = replies.opened(table(spark, d, "part").select("p_partkey", reply.alias("reply")))
    return o.select("p_partkey", *(F.col("box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "picture")


@query("""select r_name form, count(*) fields, count(distinct left(n_name, 1)) sections from nation join region on n_regionkey = r_regionkey group by 1""")
def form_fields(spark, d):
    """Regions as forms, nations as their fields, initials as sections."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("form")).agg(F.count("*").alias("fields"), F.count_distinct(F.substring("n_name", 1, 1)).alias("sections"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then '' else 'Name: ' || trim(c_name) || '; ' end || 'Segment: ' || c_mktsegment shown from customer""")
def section_view(spark, d):
    """The fields of a section that aren't blank; a key that the record lacks is blank."""
    name = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))
    values = F.create_map(F.lit("name"), name, F.lit("segment"), F.col("c_mktsegment"))
    lines = text.section_lines(values, F.array(F.lit("name"), F.lit("phone"), F.lit("segment")), F.array(F.lit("Name"), F.lit("Phone"), F.lit("Segment")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(lines, lambda p: F.concat_ws(": ", p["label"], p["value"])), "; ").alias("shown"))


@query("select event_id, user_id, event_type from events where event_id = 77")
def record_by_id(spark, d):
    return records.by_id(table(spark, d, "events"), "event_id", F.lit(77)).select("event_id", "user_id", "event_type")


@query("""with l as (select user_id, event_id, value, event_type = 'error' gone, case when value < 20 then 'remove' when value < 60 then 'keep' else 'replace' end op from events),
e as (select *, coalesce(max(event_id) filter (gone) over (partition by user_id), -1) as ended from l), v as (select * from e where not gone and event_id > ended),
p as (select *, row_number() over (partition by user_id order by event_id desc) k, max(event_id) filter (op <> 'keep') over (partition by user_id) said, min(event_id) over (partition by user_id) first_seq from v)
select p.user_id, p.value, case when s.op = 'replace' then 'photo-' || s.event_id end photo, p.first_seq, p.event_id last_seq from p left join v s on s.user_id = p.user_id and s.event_id = p.said where k = 1""")
def record_changes(spark, d):
    """Saves that keep, remove or replace a photo, and deletions."""
    op = F.when(F.col("value") < 20, "remove").when(F.col("value") < 60, "keep").otherwise("replace")
    return records.applied(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error", op, F.concat(F.lit("photo-"), F.col("event_id").cast("string")), ["value"])


@query("""with u as (select o_orderkey, md5(o_orderkey::varchar) m from orders), h as (select o_orderkey, case o_orderkey % 4 when 0 then upper(m) when 1 then m when 2 then left(m, 31) || 'g' else left(m, 31) end m from u)
select o_orderkey, o_orderkey % 4 < 2 as is_uuid from h""")
def uuid_check(spark, d):
    m, k = F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 4
    m = F.when(k == 0, F.upper(m)).when(k == 1, m).when(k == 2, F.concat(F.substring(m, 1, 31), F.lit("g"))).otherwise(F.substring(m, 1, 31))
    dashed = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return table(spark, d, "orders").select("o_orderkey", text.is_uuid(dashed).alias("is_uuid"))


_PNG = "89504E470D0A1A0A00"


@query(f"""with b as (select *, c_custkey % 12 k, c_custkey % 3 f from customer), e as (select *, case when k = 0 then 'invalid_body' when k in (1, 2) and f <> 0 then 'unknown_form' when k = 3 then 'invalid_values'
when k in (4, 5, 11) then 'invalid_photo' when k = 6 then 'photo_too_large' end code from b)
select c_custkey, code error_code, case when code is null then case when f = 0 then 'a' else 'b' end end form, case when code is null then case k when 7 then 'remove' when 8 then 'remove' when 9 then 'keep' when 10 then 'replace' else 'keep' end end photo_op,
case when code is null then ' ' || c_name || chr(10) || 'x ' end "name", case when code is null then case c_custkey % 7 when 0 then '7' when 1 then '2.5' when 2 then 'true' when 3 then '' when 4 then '[object Object]' when 5 then '1,,b' else '' end end size,
case when code is null then case when f = 0 then 2 else 3 end end n_values, case when code is null and k = 10 then 'image/png' end kind from e""")
def scan_bodies(spark, d):
    """Saves and edits: twelve shapes of a body, in which the first failing check counts; values stay as they are."""
    k, f = (F.col("c_custkey") % 12).cast("int"), F.col("c_custkey") % 3
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    png = say("data:image/webp;base64, ", F.base64(F.unhex(F.lit(_PNG))))
    size = _case((F.col("c_custkey") % 7).cast("int"), "7.0", "2.50", "true", "null", '{"a": 1}', '[1, null, "b"]', '""')
    values = say('{"name": " ', F.col("c_name"), '\\nx ", "size": ', size, ', "other": "gone"}')
    photo = _case(k, "", "", "", "", ', "photo": "data:text/html;base64,AAAA"', ', "photo": 5', say(', "photo": "data:image/png;base64,', F.base64(F.unhex(F.lit(_PNG * 4))), '"'), ', "photo": null', ', "photo": ""', "", say(', "photo": "', png, '"'), ', "photo": "data:image/jpg;base64,AAAA"')
    form = F.when(k == 1, '"nowhere"').when(k == 2, "3").otherwise('"b"')
    body = F.when(k == 0, "[1]").otherwise(say('{"form": ', form, ', "values": ', F.when(k == 3, "[]").otherwise(values), photo, "}"))
    sent = table(spark, d, "customer").select("c_custkey", body.alias("body"), F.when(f == 0, "a").alias("known_form"))
    out = bodies.parsed_bodies(sent, {"a": ["name", "size"], "b": ["name", "size", "more"]}, most_bytes=20)
    return out.select("c_custkey", "error_code", "form", "photo_op", *(F.try_element_at("values", F.lit(c)).alias(c) for c in ("name", "size")), F.when(F.col("values").isNotNull(), F.size("values")).alias("n_values"), F.col("photo.kind").alias("kind"))


@query("""with f as (select n_regionkey form_id, r_name form, ascii(n_name) so, left(n_name, 1) section, n_nationkey fo, lower(replace(n_name, ' ', '_')) field, n_name label, n_nationkey % 4 k from nation join region on n_regionkey = r_regionkey),
l as (select *, '- ' || field || ' — "' || label || '" — ' || case k when 0 then 'Yes or No' when 1 then 'one of: ' || form || ', x' when 2 then 'checklist of: ' || form || ', x (an array of the ticked items)' else 'text' end line,
row_number() over (partition by form_id, so order by fo) first_ from f), s as (select *, case when first_ = 1 then 'Section "' || section || '":' || chr(10) else '' end || line part from l)
select form_id, 'This is a filled-in copy of the "' || form || '". Its fields, as key — printed label — expected answer:' || chr(10) || string_agg(part, chr(10) order by so, fo) || chr(10) || 'Reply with the JSON object only, in this shape with every value filled in:' || chr(10) ||
'{"readable":true,"photo":"[x1, y1, x2, y2] or null","photoPicture":"1 or 2","fields":{' || string_agg('"' || field || case k when 2 then '":[]' else '":""' end, ',' order by so, fo) || '}}' prompt from s group by form_id, form""")
def reader_prompts(spark, d):
    """Regions as forms, nations as their fields, initials as sections."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = (F.col("n_nationkey") % 4).cast("int")
    fields = n.select(
        F.col("n_regionkey").alias("form_id"), F.col("r_name").alias("form"), F.ascii("n_name").alias("section_ord"), F.substring("n_name", 1, 1).alias("section"), F.col("n_nationkey").alias("field_ord"),
        F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("field"), F.col("n_name").alias("label"), _case(k, "yesno", "choice", "checklist", "text").alias("kind"), F.array("r_name", F.lit("x")).alias("options"),
    )
    return bodies.reader_prompts(fields)


@query("""with e as (select *, case when user_id % 3 > 0 then 'p/' || user_id % 50 || '.jpg' end path from events), p as (select distinct 'p/' || user_id % 50 || '.jpg' path, user_id % 50 content from events where user_id % 50 < 40)
select event_id, case when e.path is not null then '/api/scans/' || event_id || '/photo?v=' || replace(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00 (x)', ':', '%3A'), '+', '%2B') end photo_url, cast(content as varchar) content,
case when event_type = 'click' and value > 50 then 'invalid_type' when value > 90 then 'file_too_large' end as file_error from e left join p on p.path = e.path""".replace("|| '+00:00 (x)'", "|| '+00:00%20(x)'"))
def record_photos(spark, d):
    """Where a record's photo is read, its content from the store, which lacks some, and whether a file would be taken."""
    e = table(spark, d, "events")
    path = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("p/"), F.col("user_id") % 50, F.lit(".jpg")))
    photos = e.where("user_id % 50 < 40").select(F.concat(F.lit("p/"), F.col("user_id") % 50, F.lit(".jpg")).alias("path"), (F.col("user_id") % 50).cast("string").alias("content")).distinct()
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 (x)"))
    kind, name = F.when(F.col("event_type") == "click", "application/pdf").otherwise("image/png"), F.when(F.col("value") > 50, "form.pdf").otherwise("form.JPEG")
    file = bodies.file_error(kind, name, F.when(F.col("value") > 90, bodies.MOST_FILE_BYTES + 1).otherwise(bodies.MOST_FILE_BYTES))
    rows = e.select("event_id", path.alias("photo_path"), stamp.alias("stamp"), file.alias("file_error"))
    return bodies.with_photos(rows, photos).select("event_id", bodies.photo_url(F.col("event_id").cast("string"), F.col("photo_path"), F.col("stamp")).alias("photo_url"), "content", "file_error")


@query("""with q as (select p_partkey, p_size s, p_size % 7 t from part), c as (select p_partkey, s, t, unnest([1, 2, 3, 4]) i from q),
p as (select p_partkey, i, case i when 1 then s when 2 then s + 100 when 3 then s + 110 else s + 3 end x, case i when 1 then t when 2 then t + 5 when 3 then t + 95 else t + 90 end y from c),
m as (select p_partkey, avg(x) mx, avg(y) my, sqrt(100 * 100 + 25) w1, sqrt(107.0::double * 107 + 25) w2, sqrt(9.0::double + 90 * 90) h1, sqrt(100.0::double + 90 * 90) h2 from p group by 1)
select p.p_partkey, i corner, round(x + (mx - x) * 0.02, 6) x, round(y + (my - y) * 0.02, 6) y, cast(greatest(1, floor(greatest(w1, w2) * least(1, 90.0::double / greatest(w1, w2, h1, h2)) + 0.5)) as int) w, cast(greatest(1, floor(greatest(h1, h2) * least(1, 90.0::double / greatest(w1, w2, h1, h2)) + 0.5)) as int) h from p join m using (p_partkey)""")
def quad_insets(spark, d):
    """Quads of four lines, pulled in by a fiftieth, and the size they are taken to."""
    s, t = F.col("p_size").cast("double"), (F.col("p_size") % 7).cast("double")
    at = [(s, t), (s + 100, t + 5), (s + 110, t + 95), (s + 3, t + 90)]
    side = lambda a, b: pages.line_through(*at[a], *at[b])
    q = table(spark, d, "part").select("p_partkey", pages.quad_of_lines(side(0, 3), side(0, 1), side(1, 2), side(3, 2)).alias("q"))
    out = q.select("p_partkey", pages.output_size(F.col("q"), 90).alias("o"), F.posexplode(boxes.inset(F.col("q"), F.lit(0.02))).alias("i", "p"))
    return out.select("p_partkey", (F.col("i") + 1).alias("corner"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "o.w", "o.h")
