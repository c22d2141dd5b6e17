"""Semantics that the tables don't reach: replies, cleaning, agreement, admissions, boxes, images."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.functions import boxes, text
from vellumetry.operators import rasters, records, replies
from vellumetry.sources import headers
from vellumetry.sources.tables import image_kind, photo_from_data_url, png_size


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Sure! {"a": {"b": "}"}} hope it helps', {"a": {"b": "}"}}),
        ('{"a": 1, "a": 2}', {"a": 2}),
        ('{"a": 1} } x', None),
        ("{'a': 1}", None),
        ('{"a": NaN}', None),
        ('Here {"a":"```json x"} ok', {"a": "```json x"}),
        ("[1]", None),
        ("plain", None),
        ("", None),
        (None, None),
    ],
)
def test_reply_object(reply, want):
    assert records.reply_object(reply) == want


def test_parsed_replies_keep_null_and_missing_apart(spark):
    df = spark.createDataFrame([(1, '{"readable": false, "fields": {"a": null, "b": 5.0, "c": true, "d": ["x", 2], "e": {"k": 1}}}'), (2, None)], "id long, reply string")
    a, b = records.parsed_replies(df).orderBy("id").collect()
    assert a.fields == {"a": None, "b": "5", "c": "Yes", "d": "x, 2", "e": None} and a.readable is False
    assert a.kinds == {"a": "null", "b": "number", "c": "boolean", "d": "array", "e": "object"}
    assert b.error_code == "reader_reply_invalid" and b.fields is None


@pytest.mark.parametrize(
    ("raw", "flat", "lines"),
    [("a\tb", "ab", "ab"), ("a\r\n\r\n b  c \rd", "a, b c, d", "a\nb c\nd"), ("\x07x\x7f", "x", "x"), ("  ", "", ""), ("y" * 3000, "y" * 2000, "y" * 2000)],
)
def test_clean(spark, raw, flat, lines):
    assert one(spark, text.clean(F.col("v"), False), v=raw) == flat
    assert one(spark, text.clean(F.col("v"), True), v=raw) == lines


@pytest.mark.parametrize(("a", "b", "kind", "same"), [("B-", "B", "text", True), ("B+", "B", "text", False), ("+1 (2) 3", "123", "phone", True), ("none", "n/a", "phone", True), ("a, B", "b,a", "checklist", True), ("a", "a,b", "checklist", False), ("a,", "a", "checklist", True), ("caf\u00e9", "cafe\u0301", "text", True)])
def test_same_reading(spark, a, b, kind, same):
    assert one(spark, text.same_reading(F.col("a"), F.col("b"), kind), a=a, b=b) is same


def test_yes_no_and_reference(spark):
    assert [one(spark, text.yes_no(F.col("v")), v=v) for v in ("Y.", "ticked", "FALSE", "0", "maybe", "हाँ")] == ["Yes", "Yes", "No", "No", "maybe", ""]
    assert [one(spark, text.is_reference(F.col("v")), v=v) for v in ("SCH-0A1B2C", "SCH-0A1B2I", "S-0A1B2C", "sch-0A1B2C")] == [True, False, False, False]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "x"), (5, "x"), (6, None)], "k long, value string")
    b = spark.createDataFrame([(1, "X."), (2, "y"), (3, None), (4, "z"), (7, None), (6, "y")], "k long, value string")
    out = {r.k: (r.value, r.alternative, r.unreadable) for r in records.reconciled(a, b, ["k"], "text").collect()}
    assert out == {1: ("x", None, False), 2: ("y", "", False), 3: ("", None, True), 4: ("x", "z", False), 5: ("x", None, False), 6: ("y", "", False), 7: ("", None, True)}


def brute_admissions(times, limit, window):
    held, out = [], []
    for t in times:
        held = [x for x in held if t - x < window]
        out.append(limit <= 0 or len(held) < limit)
        if out[-1] and limit > 0:
            held.append(t)
    return out


@pytest.mark.parametrize("limit", [0, 1, 2, 5])
def test_admissions(spark, limit):
    rng = np.random.default_rng(limit)
    rows = [(int(k), int(t), n) for n, (k, t) in enumerate(zip(rng.integers(0, 4, 200), np.sort(rng.integers(0, 900_000, 200)), strict=True))] + [(9, 0, 900), (9, 59_999, 901), (9, 60_000, 902)]
    got = {(r.k, r.ord): r.admitted for r in records.admitted(spark.createDataFrame(rows, "k long, t long, ord long"), "k", "t", "ord", limit).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((t, n) for k, t, n in rows if k == key)
        assert [got[key, n] for _, n in mine] == brute_admissions([t for t, _ in mine], limit, 60_000)


def test_admission_stream(spark, tmp_path):
    from vellumetry.streaming.admission import admit_stream

    spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 5, 3), ("a", 60_000, 4)], "key string, at_ms long, ord long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at_ms long, ord long").parquet(str(tmp_path / "in"))
    q = admit_stream(stream, 2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.ord: r.admitted for r in spark.table("admitted").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_not_a_number_never_passes_a_gate(spark):
    nan = float("nan")
    box = tuple(F.lit(v) for v in (0.0, 0.0, 2.0, 2.0))
    bad = (F.lit(nan), F.lit(0.0), F.lit(2.0), F.lit(2.0))
    assert one(spark, boxes.iou(box, bad), v=1.0) == 0.0
    assert one(spark, boxes.normalized(F.lit(nan), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(9), F.lit(9)), v=1.0) is None
    assert one(spark, rasters.stored(F.col("v")), v=nan) == 0 and one(spark, rasters.stored(F.col("v")), v=2.5) == 2


def test_components_of_a_spiral():
    mask = np.zeros((41, 41), bool)
    y, x, dy, dx = 0, 0, 0, 1
    for step in [40, 40, 40, 38, 38, 36, 36, 34, 34]:
        for _ in range(step):
            mask[y, x] = True
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    mask[20, 20] = True
    lab = rasters.labelled(mask)
    assert lab.max() == 2 and lab[20, 20] == 2 and (lab > 0).sum() == mask.sum()
    assert rasters.labelled(np.zeros((3, 3), bool)).max() == 0


def test_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    assert one(spark, image_kind(F.col("v")), v=png) == "image/png" and tuple(one(spark, png_size(F.col("v")), v=png)) == (640, 480)
    assert one(spark, image_kind(F.col("v")), v=bytes.fromhex("FFD8FFE0")) == "image/jpeg" and one(spark, image_kind(F.col("v")), v=b"text") is None
    import base64

    good = one(spark, photo_from_data_url(F.col("v")), v="data:image/png;base64," + base64.b64encode(png).decode())
    assert bytes(good.content) == png and good.error is None
    assert one(spark, photo_from_data_url(F.col("v")), v="data:image/png;base64,!!").error == "invalid_photo"
    assert one(spark, photo_from_data_url(F.col("v"), 4), v="data:image/png;base64," + base64.b64encode(png).decode()).error == "photo_too_large"


def test_admissions_of_a_hot_user(spark):
    """Most attempts are one user's; they pass as a stream, not as one row."""
    df = spark.range(200_000).selectExpr("if(id % 50 = 0, id, -1) user", "id * 10 at", "id tie")
    out = records.admitted(df, "user", "at", "tie", 3, 1000)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    times = [k * 10 for k in range(200_000) if k % 50]
    assert out.where("user <> -1 and not admitted").isEmpty() and out.count() == 200_000
    got = [r.admitted for r in out.where("user = -1").orderBy("tie").collect()]
    assert got == brute_admissions(times, 3, 1000)


@pytest.mark.parametrize(("v", "want"), [(5, "5"), (5.0, "5"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (0.000001, "0.000001"), (1e21, "1e+21"), (1e16, "10000000000000000"), (-0.1, "-0.1"), (12345678901234567890, "12345678901234567000"), (1e400, "Infinity")])
def test_number_text(v, want):
    assert replies.number_text(v) == want or float(replies.number_text(v)) == float(v) and len(replies.number_text(v)) == len(want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ([1, 2, 3, 4], [1, 2, 3, 4]), (["1", 2, 3, "4.5"], [1, 2, 3, 4.5]), ({"x1": 1, "y1": 2, "x2": 3, "y2": 4}, [1, 2, 3, 4]), ({"left": 1, "top": "2", "right": 3, "bottom": 4}, [1, 2, 3, 4]),
        ({"x": 1, "y": 2, "width": 3, "height": 4}, [1, 2, 4, 6]), ({"x": 1, "y": 2, "w": 3, "h": 4}, [1, 2, 4, 6]), ({"bbox_2d": [1, 2, 3, 4]}, [1, 2, 3, 4]), ("[1,2,3,4]", [1, 2, 3, 4]), ("1, 2 and 3, 4", [1, 2, 3, 4]),
        ("1 2 3", None), ([1, 2, 3], None), ([1, 2, 3, "x"], None), ({"x1": 1}, None), (None, None), (False, None), ("", None), (7, None), ({"a": 1}, None), ({"x1": True, "y1": 1, "x2": 2, "y2": 3}, None),
    ],
)
def test_box_shapes(raw, want):
    assert replies.box_of(raw) == want


def test_readings_and_their_reconciliation(spark):
    fields = spark.createDataFrame([("f", "name", "text", None), ("f", "note", "multiline", None), ("f", "sex", "choice", ["Male", "Female"]), ("f", "ill", "yesno", None), ("f", "docs", "checklist", ["Birth Certificate", "Photo"]), ("f", "tel", "phone", None)], "form_id string, field string, kind string, options array<string>")
    one_ = '{"fields": {"name": ["Al", "", 2], "note": "a\\n\\nb ", "sex": "FEMALE.", "ill": "unticked", "docs": {"photo": true, "x": "no"}, "tel": null}, "photo": [0, 0, 10, 10], "photoPicture": "2"}'
    two = '{"name": "al, 2", "note": "", "sex": "other", "ill": {}, "docs": ["PHOTO", 3, "birth certificate"], "tel": 5551, "photo_box": "1 2 3 4"}'
    rows = [(1, "f", one_, two), (2, "f", '{"readable": false, "name": "x"}', two), (3, "f", "nonsense", two)]
    df = spark.createDataFrame(rows, "k long, form_id string, a string, b string")
    a, b = (replies.opened(df.select("k", "form_id", F.col(c).alias("reply"))) for c in "ab")
    ra, rb = replies.readings(a, fields, ["k"]), replies.readings(b, fields, ["k"])
    got = {r.field: (r.value, r.unreadable, r.off_list) for r in ra.where("k = 1").collect()}
    assert got == {"name": ("Al, 2", False, False), "note": ("a\nb", False, False), "sex": ("Female", False, False), "ill": ("No", False, False), "docs": ("Photo", False, False), "tel": ("", True, False)}
    got = {r.field: (r.value, r.unreadable, r.off_list) for r in rb.where("k = 1").collect()}
    assert got == {"name": ("al, 2", False, False), "note": ("", False, False), "sex": ("other", False, True), "ill": ("", True, False), "docs": ("Photo, Birth Certificate", False, False), "tel": ("5551", False, False)}
    done = {(r.k, r.field): (r.value, r.alternative, r.unreadable, r.off_list) for r in replies.reconciled_readings(ra, rb, ["k"]).collect()}
    assert done[1, "name"] == ("Al, 2", None, False, False) and done[1, "sex"] == ("Female", "other", False, False) and done[1, "tel"] == ("5551", "", False, False)
    assert done[1, "note"] == ("a\nb", "", False, False) and done[2, "sex"] == ("other", None, False, True) and done[2, "ill"] == ("", None, True, False) and done[3, "sex"] == ("other", None, False, True)
    boxes_ = {r.k: (r.box, r.picture) for r in replies.reconciled_boxes(a.where("error_code is null"), b, ["k"]).collect()}
    assert boxes_ == {1: ([0, 0, 10, 10], 2), 2: ([1, 2, 3, 4], None)}


def test_image_sizes(spark):
    app = b"\xff\xe1" + (40).to_bytes(2, "big") + b"\xff\xc0" * 19
    jpeg = b"\xff\xd8" + app + b"\xff\xff\xc2\x00\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" * 9
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    vp8l = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((30 - 1) | (20 - 1) << 14).to_bytes(4, "little") + bytes(5)
    vp8 = b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + (77).to_bytes(2, "little") + (66).to_bytes(2, "little")
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 5, 7)
    cases = [(jpeg, (640, 480)), (vp8x, (100, 50)), (vp8l, (30, 20)), (vp8, (77, 66)), (png, (5, 7)), (jpeg[:45], (None, None)), (b"", (None, None)), (None, (None, None)), (b"text", (None, None))]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c binary")
    assert [(r.s.width, r.s.height) for r in df.select("k", headers.image_size(F.col("c")).alias("s")).orderBy("k").collect()] == [want for _, want in cases]


def test_a_lone_reading_stands_when_the_other_failed(spark):
    fields = spark.createDataFrame([("f", "name", "text", None), ("f", "tel", "phone", None)], "form_id string, field string, kind string, options array<string>")
    good, bad = '{"name": "Al", "tel": null}', "no JSON"
    df = spark.createDataFrame([(1, "f", good, bad), (2, "f", bad, good), (3, "f", bad, bad), (4, "f", bad, '{"readable": false}'), (5, "f", good, '{"name": "B"}')], "k long, form_id string, a string, b string")
    one_, two = (replies.readings(replies.opened(df.select("k", "form_id", F.col(c).alias("reply"))), fields, ["k"]) for c in "ab")
    got = {(r.k, r.field): (r.value, r.alternative, r.unreadable) for r in replies.reconciled_readings(one_, two, ["k"]).collect()}
    assert got == {(1, "name"): ("Al", None, False), (1, "tel"): ("", None, True), (2, "name"): ("Al", None, False), (2, "tel"): ("", None, True), (4, "name"): ("", None, False), (4, "tel"): ("", None, False), (5, "name"): ("Al", "B", False), (5, "tel"): ("", None, True)}


def test_double_reads_as_a_stream(spark, tmp_path):
    """Both readings, one that its partner never joins, one that comes late, and a restart from the checkpoint."""
    import datetime

    from vellumetry.streaming.readings import double_reads

    columns = "k long, field string, kind string, value string, unreadable boolean, off_list boolean, readable boolean, at timestamp"
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    row = lambda k, value, s: (k, "name", "text", value, False, False, True, at(s))

    def put(side, name, rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / side / name))

    def run():
        one_, two = (spark.readStream.schema(columns).option("recursiveFileLookup", "true").parquet(str(tmp_path / side)) for side in "ab")
        q = double_reads(one_, two, ["k"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        return {r.k: (r.value, r.alternative) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put("a", "1", [row(1, "Al", 0), row(2, "only first", 0), row(4, "kept for later", 0)])
    put("b", "1", [row(1, "Bo", 20), row(3, "only second", 0)])
    assert run() == {1: ("Al", "Bo")}
    put("b", "2", [row(4, "Kept for later.", 50)])  # after the restart, within a minute
    assert run() == {1: ("Al", "Bo"), 4: ("kept for later", None)}
    for side in "ab":
        put(side, "3", [row(99, "z", 1000)])
    whole = run()
    assert whole[2] == ("only first", None) and whole[3] == ("only second", None) and whole[99] == ("z", None)
    put("a", "4", [row(3, "too late", 30)])  # behind the watermark: dropped
    assert run() == whole


def test_data_urls_name_an_accepted_type(spark):
    import base64

    png = base64.b64encode(bytes.fromhex("89504E470D0A1A0A") + bytes(20)).decode()
    error = lambda url: one(spark, photo_from_data_url(F.col("v")), v=url).error
    assert error(f"data:image/jpg;base64,{png[:9]} \n{png[9:]}") is None and error(f"data:image/webp;base64,{png.rstrip('=')}") is None
    for url in (f"data:text/html;base64,{png}", f"data:image/png;base64,{png}!", f"data:image/png,{png}", f"data:image/svg;base64,{png}", "data:image/png;base64,", "data:image/png;base64,=", f" data:image/png;base64,{png}"):
        assert error(url) == "invalid_photo"


def test_boxes_nested_without_bound():
    raw, text = [1, 2, 3, 4], "[1, 2, 3, 4]"
    for k in range(50):
        raw = {replies.NESTED[k % 4]: raw}
        text = '{"box": ' + text + "}"
    assert replies.box_of(raw) == replies.box_of(text) == [1, 2, 3, 4]


def test_image_sizes_after_much_metadata(spark):
    part = b"\xff\xe1" + (60_000).to_bytes(2, "big") + b"\xff\xc0" * 29_999
    frame = b"\xff\xc0\x00\x11\x08" + (100).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03" * 9
    cases = [(b"\xff\xd8" + part * 20 + b"\0\0" + frame, (200, 100)), (b"\xff\xd8\xff\xda\x00\x02" + frame, (None, None)), (b"\xff\xd8\xff\xe1\x00\x01" + frame, (None, None))]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c binary")
    assert [(r.s.width, r.s.height) for r in df.select("k", headers.image_size(F.col("c")).alias("s")).orderBy("k").collect()] == [want for _, want in cases]


def test_values_of_a_record_stay_as_they_are(spark):
    df = spark.createDataFrame([({"a": " x\ny ", "b": None, "z": "gone"},), (None,)], "v map<string,string>")
    assert [r.p for r in df.select(records.projected(F.col("v"), ["a", "b", "c"]).alias("p")).collect()] == [{"a": " x\ny ", "b": "", "c": ""}, {"a": "", "b": "", "c": ""}]


def test_bodies_of_saves(spark):
    from vellumetry.operators import bodies
    from vellumetry.sources import catalogue

    forms = {i: catalogue.keys_of(i) for i in catalogue.FORMS}
    cases = {
        '{"form": "school", "values": {"city": "x", "state": 1e-7, "pinCode": 110001, "board": 2.50, "extra": "y"}}': ("school", "keep", None),
        '{"form": "hospital", "values": {}, "photo": ""}': ("hospital", "remove", None), '{"form": "clinic", "values": {}}': (None, None, "unknown_form"), '{"values": {}}': (None, None, "unknown_form"),
        '{"form": "school", "values": null, "photo": 5}': (None, None, "invalid_values"), '{"form": "school", "values": {}, "photo": {}}': (None, None, "invalid_photo"), "[]": (None, None, "invalid_body"), "{": (None, None, "invalid_body"), '"x"': (None, None, "invalid_body"),
    }
    df = spark.createDataFrame([(b, None) for b in [*cases, None]] + [('{"form": "clinic", "values": {"email": "q"}}', "hospital")], "body string, known_form string").withColumn("k", F.monotonically_increasing_id())
    out = [(r.form, r.photo_op, r.error_code, r["values"]) for r in bodies.parsed_bodies(df, forms).orderBy("k").collect()]
    assert [o[:3] for o in out] == [*cases.values(), (None, None, "invalid_body"), ("hospital", "keep", None)]
    first = out[0][3]
    assert len(first) == 41 and (first["city"], first["state"], first["pinCode"], first["board"], first["address"]) == ("x", "1e-7", "110001", "2.5", "")
    assert out[-1][3] == catalogue.empty_values("hospital") | {"email": "q"} and "extra" not in first


def test_the_catalogue_and_its_prompts(spark):
    from vellumetry.operators import bodies
    from vellumetry.sources import catalogue

    fields = catalogue.catalogue(spark)
    assert {r.form_id: (r.n, r.s) for r in fields.groupBy("form_id").agg(F.count("*").alias("n"), F.count_distinct("section_ord").alias("s")).collect()} == {"school": (41, 5), "hospital": (16, 4)}
    assert fields.where("size(options) > 0").count() == 3 and fields.where("field = 'allergies'").select("form_id", "kind").orderBy("form_id").collect() == [("hospital", "yesno"), ("school", "text")]
    assert all({f.title, *f.summary} <= set(catalogue.keys_of(i)) for i, f in catalogue.FORMS.items()) and catalogue.keys_of("clinic") == []
    prompt = {r.form_id: r.prompt for r in bodies.reader_prompts(fields).collect()}
    rows = prompt["hospital"].split("\n")
    assert rows[0].startswith('This is a filled-in copy of the "Hospital Patient Form".') and rows[1:3] == ['Section "Patient Information":', '- patientName — "Name" — a person\'s name, in the script it is written in'] and len(rows) == 1 + 4 + 16 + 2
    import json

    assert list(json.loads(rows[-1])["fields"]) == catalogue.keys_of("hospital") and json.loads(prompt["school"].split("\n")[-1])["fields"]["documents"] == []
    assert '- gender — "Gender" — one of: Male, Female, Other' in prompt["school"]
