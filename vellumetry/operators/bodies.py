"""What is sent and asked: bodies of saves and edits, checked before anything is stored, and the reader's prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.sources.tables import photo_from_data_url

#: How an answer of each kind is asked for, and what files are accepted.  Fixed values.
ASKED = {
    "yesno": "Yes or No", "date": "a date, digits and separators exactly as written", "phone": "a phone number, digits as written", "email": "an email address",
    "number": "a number, digits as written", "name": "a person's name, in the script it is written in", "multiline": "text, possibly several lines",
}
ACCEPTED, NAMES, MOST_FILE_BYTES = ("image/jpeg", "image/png", "image/webp", "image/heic", "image/heif", ""), r"(?i)\.(jpe?g|png|webp|heic|heif)$", 30 * 1024 * 1024


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _plain(v: Column, nested: bool = False) -> Column:
    """A JSON value as a string: strings as they are, numbers in shortest form (exact from 1e-6 up to 1e15), lists joined by
    commas (one level), other objects by their name; null is blank."""
    number = F.try_variant_get(v, "$", "double")
    digits = F.regexp_replace(F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    rough = F.regexp_replace(F.lower(number.cast("string")), r"\.0e|e(?=\d)", "e+")
    written = F.when(number == 0, "0").when((F.abs(number) >= 1e-6) & (F.abs(number) < 1e15), digits).otherwise(F.regexp_replace(rough, r"e\+(?=-)", "e"))
    kind = _kind(v)
    out = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.isin("VOID", ""), "").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("string"))
    out = out.when(kind == "OBJECT", "[object Object]")
    if not nested:
        out = out.when(kind == "ARRAY", F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(_plain(x, True), F.lit(""))), ","))
    return out.otherwise(written)


def parsed_bodies(bodies: DataFrame, forms: dict[str, list[str]], body: str = "body", known: str = "known_form", most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """bodies with form, values (a map of the form's keys), photo_op, photo (content, kind) and error_code, and without body.

    known: the form of an edit, null for a save, which names its own.  The first failing check gives the code: invalid_body,
    unknown_form, invalid_values, then those of the photo.  photo_op: keep if the body doesn't mention the photo, remove if it is
    null or blank, replace else.  All but the code is null where there is one."""
    rest = [c for c in bodies.columns if c != body]
    v = F.try_parse_json(body)
    parts = bodies.select(*rest, v.alias("_v")).withColumns({"_object": F.coalesce(_kind(F.col("_v")) == "OBJECT", F.lit(False)), "_map": F.try_variant_get("_v", "$", "map<string,variant>")})
    at = lambda k: F.try_element_at("_map", F.lit(k))
    named = F.when(_kind(at("form")) == "STRING", F.try_variant_get(at("form"), "$", "string"))
    form = F.coalesce(known, named) if known in rest else named
    parts = parts.withColumns({"form": F.when(F.col("_object") & form.isin(*forms), form), "_values": at("values"), "_photo": at("photo"), "_said": F.array_contains(F.map_keys("_map"), "photo")})
    keys = F.try_element_at(F.create_map(*(x for i, ks in forms.items() for x in (F.lit(i), F.array(*map(F.lit, ks))))), F.col("form"))
    blank = F.coalesce(_kind(F.col("_photo")) == "VOID", F.lit(True)) | F.coalesce(F.try_variant_get("_photo", "$", "string") == "", F.lit(False)) & (_kind(F.col("_photo")) == "STRING")
    url = F.when(_kind(F.col("_photo")) == "STRING", F.try_variant_get("_photo", "$", "string")).otherwise("")
    parts = parts.withColumns({"_op": F.when(~F.coalesce("_said", F.lit(False)), "keep").when(blank, "remove").otherwise("replace"), "_sent": F.try_variant_get("_values", "$", "map<string,variant>"), "_keys": keys})
    parts = parts.withColumn("_p", F.when(F.col("_op") == "replace", photo_from_data_url(url, most_bytes)))
    code = F.when(~F.col("_object"), "invalid_body").when(F.col("form").isNull(), "unknown_form").when(F.coalesce(_kind(F.col("_values")), F.lit("")) != "OBJECT", "invalid_values").otherwise(F.col("_p.error"))
    parts = parts.withColumn("error_code", code)
    fine = F.col("error_code").isNull()
    values = F.map_from_arrays("_keys", F.transform("_keys", lambda k: F.coalesce(_plain(F.try_element_at("_sent", k)), F.lit(""))))
    photo = F.when(fine & (F.col("_op") == "replace"), F.struct("_p.content", "_p.kind"))
    return parts.select(*rest, F.when(fine, F.col("form")).alias("form"), F.when(fine, values).alias("values"), F.when(fine, F.col("_op")).alias("photo_op"), photo.alias("photo"), "error_code")


def file_error(kind: Column, name: Column, size: Column) -> Column:
    """Why a file can't be read as a form; null if it can.  A file of another type passes by its name."""
    return F.when(~kind.isin(*ACCEPTED) & ~name.rlike(NAMES), "invalid_type").when(size > MOST_FILE_BYTES, "file_too_large")


def asked(kind: Column, options: Column) -> Column:
    """What the reader is told of an answer."""
    listed = F.array_join(options, ", ")
    out = F.when(kind == "choice", F.concat(F.lit("one of: "), listed)).when(kind == "checklist", F.concat(F.lit("checklist of: "), listed, F.lit(" (an array of the ticked items)")))
    for k, words in ASKED.items():
        out = out.when(kind == k, words)
    return out.otherwise("text")


def reader_prompts(fields: DataFrame) -> DataFrame:
    """form_id, prompt: what the reader is told of each form.  fields: rows as of the catalogue."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))
    line = F.concat(F.lit("- "), "field", F.lit(' — "'), "label", F.lit('" — '), asked(F.col("kind"), F.coalesce("options", F.array().cast("array<string>"))))
    blank = F.concat(quoted(F.col("field")), F.when(F.col("kind") == "checklist", ":[]").otherwise(':""'))
    rows = fields.select("form_id", "form", "section", F.struct("section_ord", "field_ord", line.alias("line"), blank.alias("blank"), "section").alias("r"))
    forms = rows.groupBy("form_id").agg(F.first("form").alias("form"), F.sort_array(F.collect_list("r")).alias("rs"))
    opens = lambda r, i: (i == 0) | (r["section_ord"] != F.get("rs", i - 1)["section_ord"])
    body = F.flatten(F.transform("rs", lambda r, i: F.when(opens(r, i), F.array(F.concat(F.lit('Section "'), r["section"], F.lit('":')), r["line"])).otherwise(F.array(r["line"]))))
    first = F.concat(F.lit('This is a filled-in copy of the "'), "form", F.lit('". Its fields, as key — printed label — expected answer:'))
    shape = F.concat(F.lit('{"readable":true,"photo":"[x1, y1, x2, y2] or null","photoPicture":"1 or 2","fields":{'), F.array_join(F.transform("rs", lambda r: r["blank"]), ","), F.lit("}}"))
    last = F.lit("Reply with the JSON object only, in this shape with every value filled in:")
    return forms.select("form_id", F.array_join(F.concat(F.array(first), body, F.array(last, shape)), "\n").alias("prompt"))


def photo_url(record_id: Column, path: Column, updated: Column) -> Column:
    """Where a record's photo is read; null for none.  The time of the last change keeps a replaced photo from being served old."""
    part = F.url_encode(updated)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        part = F.replace(part, F.lit(code), F.lit(mark))
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("/api/scans/"), record_id, F.lit("/photo?v="), part))


def with_photos(records: DataFrame, photos: DataFrame, path: str = "photo_path") -> DataFrame:
    """records with the content of their photos (path, content); null for none, or for one that is missing."""
    return records.join(photos.select(F.col("path").alias(path), "content"), path, "left")
