"""Saved records: change log, lists, search, facets, reconciling two readings, admissions, and untrusted replies."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.functions.text import same_reading, trimmed


def latest(log: DataFrame, key: list[str], order: list[str], gone: Column) -> DataFrame:
    """The last change of each key, without keys whose last change is a deletion.  A partial aggregate, no window: a hot
    key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    last = log.withColumn("_gone", gone).groupBy(*key).agg(F.max_by(F.struct(*rest, "_gone"), F.struct(*order)).alias("r"))
    return last.where(~F.col("r._gone")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def newest(df: DataFrame, when: str, tie: str, limit: int | None = 500) -> DataFrame:
    """The list screen: newest first, ties by key; at most `limit` rows (a top-k), or all where it is None."""
    ordered = df.orderBy(F.desc(when), F.asc(tie))
    return ordered if limit is None else ordered.limit(limit)


def search(df: DataFrame, needle: str, parts: list[str]) -> DataFrame:
    """Rows whose parts, joined by spaces and lower-cased, hold the needle as plain text; an empty needle takes all."""
    wanted = needle.strip().lower()
    return df if not wanted else df.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(wanted)))


def facets(df: DataFrame, by: str, every: DataFrame) -> DataFrame:
    """Rows by facet, zero for facets without any, and the total under a null facet."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    full = every.join(counted, by, "left").select(by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias(by), "n"))


def reconciled(first: DataFrame, second: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Two readings (key, value) of the same fields; a null value is unreadable.  The first wins a disagreement and
    keeps the other as its alternative; a blank first takes the second, marked uncertain."""
    both = first.withColumnsRenamed({"value": "a"}).withColumn("in_a", F.lit(True)).join(second.withColumnsRenamed({"value": "b"}).withColumn("in_b", F.lit(True)), key, "full_outer")
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    single = F.col("in_a").isNull() | F.col("in_b").isNull()
    same = single | same_reading(a, b, kind)
    value = F.when(F.col("in_a").isNull(), b).when(same | (a != ""), a).otherwise(b)
    alternative = F.when(~same, F.when(a == "", F.lit("")).otherwise(b))
    unreadable = F.when(F.col("in_a").isNull(), F.col("b").isNull()).otherwise(F.col("a").isNull()) & (value == "")
    return both.select(*key, value.alias("value"), alternative.alias("alternative"), unreadable.alias("unreadable"))


def admitted(attempts: DataFrame, key: str, at_ms: str, tie: str, limit: int, window_ms: int = 60_000) -> DataFrame:
    """A sliding-window limiter: an attempt is admitted if fewer than `limit` admitted ones started within the window.
    Refused attempts hold no slot, so admission is a fold over a key's attempts in order, by its nature one row of state
    per key: the times of the last `limit` admissions.  Attempts are sorted by key and time and stream through the fold, so
    a hot key is never held at once.  An attempt without a time is admitted and holds no slot.  A limit of 0 or less admits
    all."""
    if limit <= 0:
        return attempts.select(key, tie, F.lit(True).alias("admitted"))
    from pyspark.sql.types import BooleanType, LongType, StructType

    rows = attempts.select(key, F.col(at_ms).cast("long").alias("_t"), F.col(tie).cast("long").alias(tie))
    schema = StructType([rows.schema[key]]).add(tie, LongType()).add("admitted", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run  # equal to no key
        held: deque[int] = deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last:
                    last = k
                    held.clear()
                if t is None:
                    out.append(True)
                    continue
                while held and t - held[0] >= window_ms:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], names=schema.fieldNames())

    return rows.repartition(key).sortWithinPartitions(key, "_t", tie).mapInArrow(run, schema)


_FENCE = re.compile(r"```(?:json)?", re.I)


def reply_object(text: str | None) -> dict | None:
    """The JSON object of an untrusted reply: the text itself, without code fences, or from its first to its last brace.
    Strict JSON: no trailing text, no NaN; of a repeated key the last one counts."""

    def refuse(name: str):
        raise ValueError(name)

    whole = text or ""
    stripped, plain = whole.strip(), _FENCE.sub("", whole).strip()
    inner = whole[whole.find("{") : whole.rfind("}") + 1] if "{" in whole else ""
    for candidate in (stripped, plain, inner):
        try:
            found = json.loads(candidate, parse_constant=refuse)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    return None


REPLY = "readable boolean, fields map<string,string>, kinds map<string,string>, error_code string"


def parsed_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add readable, fields (scalars as text), kinds (the JSON type of each) and error_code."""
    from pyspark.sql.types import StructType

    names = df.columns
    schema = StructType(df.schema.fields + StructType.fromDDL(REPLY).fields)

    def scalar(v) -> str | None:
        if v is None or isinstance(v, (dict,)):
            return None
        if isinstance(v, bool):
            return "Yes" if v else "No"
        if isinstance(v, list):
            return ", ".join(x for x in map(scalar, v) if x is not None)
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
        return str(v)

    def kind(v) -> str:
        return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_map = pa.map_(pa.string(), pa.string())
        for batch in batches:
            objects = [reply_object(t) for t in batch.column(reply).to_pylist()]
            fields = [None if o is None else o["fields"] if isinstance(o.get("fields"), dict) else o for o in objects]
            made = [
                pa.array([None if o is None else o.get("readable") is not False for o in objects], pa.bool_()),
                pa.array([None if f is None else [(k, scalar(v)) for k, v in f.items()] for f in fields], text_map),
                pa.array([None if f is None else [(k, kind(v)) for k, v in f.items()] for f in fields], text_map),
                pa.array(["reader_reply_invalid" if o is None else None for o in objects], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def filled(values: Column) -> Column:
    return F.size(F.filter(F.map_values(values), lambda v: trimmed(F.coalesce(v, F.lit(""))) != ""))


def projected(values: Column, keys: list[str]) -> Column:
    """Values on a form's keys, as they are: unknown keys go, missing and null ones are blank.  No values at all are all blank."""
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")) for k in keys)))


def by_id(df: DataFrame, key: str, wanted: Column) -> DataFrame:
    """The row of one key: no row if there is none, an error if there are several.  Two rows tell."""
    rows = F.collect_list(F.struct(*df.columns))
    found = df.where(F.col(key) == wanted).limit(2).agg(rows.alias("r"))
    one = F.when(F.size("r") > 1, F.raise_error(F.lit("more than one row of a key")).cast(found.schema["r"].dataType)).otherwise(F.col("r"))
    return found.select(F.inline(one))


def applied(log: DataFrame, key: list[str], seq: str, deleted: Column, photo_op: Column, photo: Column, values: list[str]) -> DataFrame:
    """The records that a log of saves and deletions leaves: key, the last values, photo, first_seq and last_seq.

    photo_op: 'keep' leaves the photo that earlier saves set, 'remove' clears it, 'replace' sets it.  A save after a
    deletion begins a new record.  Two partial aggregates; no window, so that a hot key is combined before the shuffle."""
    rows = log.select(*key, seq, *values, deleted.alias("_gone"), photo_op.alias("_op"), photo.alias("_photo"))
    ended = rows.where("_gone").groupBy(*key).agg(F.max(seq).alias("_end"))
    live = rows.join(ended, key, "left").where(~F.col("_gone") & (F.col("_end").isNull() | (F.col(seq) > F.col("_end"))))
    said = F.when(F.col("_op") != "keep", F.col(seq))
    kept = F.when(F.col("_op") == "replace", F.col("_photo"))
    last = F.max_by(F.struct(*values), F.col(seq))
    out = live.groupBy(*key).agg(last.alias("r"), F.max_by(F.struct(kept.alias("p")), said)["p"].alias("photo"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
    return out.select(*key, *(F.col(f"r.{v}").alias(v) for v in values), "photo", "first_seq", "last_seq")
