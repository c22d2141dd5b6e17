"""Readings out of untrusted replies, and two readings of a form reconciled.

A reply is opened once, in a small Arrow map: whether it is readable, its photo's box, and each of its fields as a kind
of JSON value with its text and items.  All that follows is a join with the form's fields (form_id, key, kind, options) and
column expressions: coercion by kind of field and kind of value, unreadable and off-list flags, and reconciliation.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import text
from vellumetry.operators.records import reply_object

OPENED = "readable boolean, box array<double>, picture int, error_code string, fields map<string, struct<kind:string, text:string, items:array<struct<text:string, plain:boolean>>>>"
#: Names under which a box is nested, and names of its corners, in order of precedence.  Fixed values.
NESTED, CORNERS = ("bbox_2d", "bbox", "box", "photo"), (("x1", "y1", "x2", "y2"), ("left", "top", "right", "bottom"))
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def number_text(v: float) -> str:
    """A JSON number as JavaScript writes it: shortest digits, plain from 1e-6 up to 1e21."""
    if isinstance(v, int) and abs(v) < 1 << 53:
        return str(v)
    v = float(v)
    if not math.isfinite(v):
        return "Infinity" if v > 0 else "-Infinity"
    if v == 0:
        return "0"
    if 1e-6 <= abs(v) < 1e21:
        plain = format(Decimal(repr(v)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    digits, _, power = repr(v).partition("e")
    return f"{digits.removesuffix('.0')}e{int(power):+d}"


def _kind(v: object) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def _text(v: object) -> str | None:
    if isinstance(v, bool):
        return "Yes" if v else "No"
    if isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return number_text(v)
    return None


def _items(v: object) -> list[dict]:
    """The scalars of an array, nested ones too, or the ticked names of an object; plain: a string of the array itself."""
    if isinstance(v, dict):
        return [{"text": k, "plain": True} for k, ticked in v.items() if ticked is True or ticked in ("Yes", "yes")]
    out, todo = [], [(x, isinstance(x, str)) for x in reversed(v)] if isinstance(v, list) else []
    while todo:
        x, plain = todo.pop()
        if isinstance(x, list):
            todo += [(y, False) for y in reversed(x)]
        elif (t := _text(x)) is not None:
            out.append({"text": t, "plain": plain})
    return out


def _number(v: object) -> float:
    """As a loose conversion to a number; not-a-number where there is none."""
    if isinstance(v, str):
        s = v.strip()
        return 0.0 if not s else float(s) if _NUMBER.fullmatch(s) else math.nan
    return math.nan if isinstance(v, (list, dict)) else float(v or 0)


def box_of(raw: object) -> list[float] | None:
    """Four finite numbers, as corners, out of any shape in which replies give a box, however deep it is nested; else None,
    never a guess."""
    while True:
        if raw is None or raw is False or raw == "":
            return None
        if isinstance(raw, dict) and (inner := next((k for k in NESTED if k in raw), None)):
            raw = raw[inner]
        elif isinstance(raw, str):
            try:
                raw = json.loads(raw)
            except (ValueError, RecursionError):
                raw = re.findall(r"-?\d+(?:\.\d+)?", raw, re.A)
                break
        else:
            break
    if isinstance(raw, list):
        found = [_number(x) for x in raw] if len(raw) == 4 else []
    elif isinstance(raw, dict):
        at = lambda k: math.nan if isinstance(raw.get(k), bool) or not isinstance(raw.get(k), (int, float, str)) else _number(raw[k])
        names = next((c for c in CORNERS if c[0] in raw), None)
        if names:
            found = [at(k) for k in names]
        elif "x" in raw:
            w, h = at("width" if "width" in raw else "w"), at("height" if "height" in raw else "h")
            found = [at("x"), at("y"), at("x") + w, at("y") + h]
        else:
            found = []
    else:
        found = []
    return found if len(found) == 4 and all(map(math.isfinite, found)) else None


def picture_of(raw: object) -> int | None:
    v = _number(raw) if isinstance(raw, (str, int, float)) and not isinstance(raw, bool) else math.nan
    return int(v) if v in range(1, 10) else None


def opened(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The OPENED columns, beside the others but the reply."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    names = [c for c in replies.columns if c != reply]
    made = StructType.fromDDL(OPENED)
    schema = StructType([replies.schema[c] for c in names] + made.fields)
    types = [to_arrow_type(f.dataType) for f in made.fields]

    def one(body: str | None) -> tuple:
        o = reply_object(body)
        if o is None:
            return None, None, None, "reader_reply_invalid", None
        source = o["fields"] if isinstance(o.get("fields"), dict) else o
        first = lambda *vs: next((v for v in vs if v is not None), None)
        readable = o.get("readable") is not False
        box = box_of(first(o.get("photo"), o.get("photoBox"), o.get("photo_box"), source.get("photo"))) if readable else None
        picture = picture_of(first(o.get("photoPicture"), o.get("photo_picture"), source.get("photoPicture"))) if box else None
        return readable, box, picture, None, [(k, {"kind": _kind(v), "text": _text(v), "items": _items(v)}) for k, v in source.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t) for t in batch.column(reply).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=schema.fieldNames())

    return replies.select(*names, reply).mapInArrow(run, schema)


def printed(key: Column, options: Column, keys: Column) -> Column:
    """The option of a key, in its printed spelling; null if there is none.  keys: the options' keys, in their order."""
    return F.get(options, (F.array_position(keys, key) - 1).cast("int"))


def readings(replies: DataFrame, fields: DataFrame, key: list[str], form: str = "form_id") -> DataFrame:
    """A row for each field of the form of each parsed reply: key, form, field, value, unreadable, off_list, readable.

    fields: form_id, field, kind, options, a small relation that joins by the form.  Replies that can't be parsed have no
    rows.  A field that the reply leaves out is blank, a null or a value of the wrong shape unreadable.  Each step binds what the
    next one mentions, so that nothing is computed, or compiled, twice."""
    options = F.coalesce("options", F.array().cast("array<string>"))
    listed = F.when(F.col("kind") == "yesno", F.array(F.lit("Yes"), F.lit("No"))).otherwise(options)
    catalogue = fields.select(form, "field", "kind", listed.alias("options")).withColumn("option_keys", F.transform("options", text.option_key))
    each = replies.where("error_code is null").join(catalogue, form)
    raw, kind, multiline = F.col("raw"), F.col("kind"), F.col("kind") == "multiline"
    each = each.select(*key, form, "field", "kind", "readable", "options", "option_keys", F.try_element_at("fields", F.col("field")).alias("raw"))
    # the items, as they stand: of a list or an object, or of a string that lists them
    plain = F.transform(F.filter(raw["items"], lambda i: i["plain"]), lambda i: i["text"])
    ticked = F.when(raw["kind"] == "string", F.split(raw["text"], r"[,;\n]", -1)).when(raw["kind"].isin("array", "object"), plain)
    items = F.when(kind == "checklist", ticked).when((kind != "yesno") & (raw["kind"] == "array"), F.transform(raw["items"], lambda i: i["text"]))
    each = each.withColumn("items", F.filter(F.transform(items, lambda x: text.clean(x, multiline)), lambda x: x != ""))
    single = (raw["kind"] == "string") | (raw["kind"] == "array")
    each = each.withColumn("said", F.when(kind.isin("checklist", "yesno"), raw["text"]).when(raw["kind"] == "array", F.array_join("items", ", ")).otherwise(raw["text"]))
    each = each.withColumn("flat", F.when(single & ~kind.isin("checklist", "yesno"), text.clean(F.col("said"), multiline)).otherwise(F.col("said")))
    # of a checklist the printed spellings, the first of each key
    each = each.withColumn("named", F.when(kind == "checklist", F.transform("items", lambda x: F.coalesce(printed(text.option_key(x), F.col("options"), F.col("option_keys")), x))))
    each = each.withColumn("named_keys", F.transform("named", text.option_key))
    ticks = F.array_join(F.filter("named", lambda x, i: F.array_position("named_keys", F.get("named_keys", i)) == i + 1), ", ")
    answer = F.when(raw["kind"].isin("boolean", "number", "string"), text.yes_no(F.col("flat")))
    each = each.withColumn("found", F.when(kind == "checklist", ticks).when(kind == "yesno", answer).otherwise(F.col("flat")))
    each = each.withColumn("option", F.when(kind.isin("choice", "yesno"), printed(text.option_key(F.col("found")), F.col("options"), F.col("option_keys"))))
    blank = ~F.col("readable") | raw.isNull()
    value = F.when(blank, "").otherwise(F.coalesce(F.when(kind == "choice", F.col("option")), "found", F.lit("")))
    each = each.withColumn("value", value)
    off = kind.isin("choice", "yesno") & (F.col("value") != "") & F.col("option").isNull()
    return each.select(*key, form, "field", "kind", "value", (~blank & F.col("found").isNull()).alias("unreadable"), off.alias("off_list"), "readable")


def paired(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as from readings() with their values in one column, a for the first reading and b for the second, and its kind beside it."""
    made = ("kind", "value", "unreadable", "off_list", "readable")
    one = lambda df, n: df.select(*(c for c in df.columns if c not in made), F.col("kind").alias(f"kind_{n}"), F.struct(*made[1:]).alias(n))
    return one(first, "a"), one(second, "b")


def agreed(both: DataFrame, on: list[str]) -> DataFrame:
    """The reconciled rows of paired ones that have been joined; the side of a failed reading is null."""
    failed = F.struct(F.lit("").alias("value"), F.lit(False).alias("unreadable"), F.lit(False).alias("off_list"), F.lit(False).alias("readable"))
    both = both.select(*on, F.coalesce("kind_a", "kind_b").alias("kind"), F.coalesce("a", failed).alias("a"), F.coalesce("b", failed).alias("b"))
    a, b = F.col("a.value"), F.col("b.value")
    both = both.withColumn("same", text.same_by_kind(a, b, F.col("kind")))
    single = ~F.col("a.readable") | ~F.col("b.readable")
    both = both.withColumns({"other": F.when(single, ~F.col("a.readable")).otherwise(~F.col("same") & (a == "")), "differ": ~single & ~F.col("same"), "single": single})
    other, differ, single = F.col("other"), F.col("differ"), F.col("single")
    side = F.when(other, F.col("b")).otherwise(F.col("a"))
    unreadable = F.when(single, side["unreadable"]).otherwise(F.col("a.unreadable") & ~other)
    return both.select(*on, side["value"].alias("value"), F.when(differ, F.when(a == "", "").otherwise(b)).alias("alternative"), unreadable.alias("unreadable"), side["off_list"].alias("off_list"))


def reconciled_readings(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two readings of the same forms, rows as from readings(): key, field, value, alternative, unreadable, off_list.

    A reading that failed, or that saw no form, yields to the other one; where both did there is a row of the first, or none.
    Else the first wins a disagreement and keeps the other's value as alternative; where it is blank the second's value
    stands, marked by a blank alternative."""
    on = [*key, "field"]
    one, two = (df.select(*on, "kind", "value", "unreadable", "off_list", "readable") for df in (first, second))
    a, b = paired(one, two)
    return agreed(a.join(b, on, "full_outer"), on)


def reconciled_boxes(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """The photo's box and picture of two opened replies: the first's if it has one and saw the form."""
    both = first.select(*key, F.struct("readable", "box", "picture").alias("a")).join(second.select(*key, F.struct("readable", "box", "picture").alias("b")), key)
    side = F.when(F.col("a.readable") & (F.col("a.box").isNotNull() | ~F.col("b.readable")), F.col("a")).otherwise(F.col("b"))
    return both.select(*key, side["box"].alias("box"), side["picture"].alias("picture"))


def filled(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count_if(F.col("value") != "").alias("filled"), F.count_if("unreadable").alias("unreadable"), F.count_if("off_list").alias("off_list"))
