"""Cleaning and comparing the answers of a form, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the records define it.  A fixed value.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Answers that count as yes or no.  Fixed values.
YES, NO = ("yes", "y", "true", "ticked", "checked", "1"), ("no", "n", "false", "unticked", "unchecked", "0")
#: The longest answer, what doesn't count in a comparison, and the form of a reference.  Fixed values.
LONGEST_ANSWER, LIGHT, REFERENCE = 2000, ".,;:'\"`()\\-_/", "^[A-Z]{2,5}-[0-9A-HJKMNP-TV-Z]{6}$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(c: Column, multiline: bool | Column) -> Column:
    """Line ends become LF, other control characters go (tabs too, before white space is collapsed), blank lines go; lines are
    joined by commas unless multiline.  Most answers need none of it, which one search tells.  c is mentioned several times:
    pass a column."""
    whole = c
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\x00-\x09\x0B-\x1F\x7F]", "")
    c = F.regexp_replace(c, f"[{SPACE}&&[^\n]]+", " ")
    lines = F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")
    between = F.when(multiline, "\n").otherwise(", ") if isinstance(multiline, Column) else F.lit("\n" if multiline else ", ")
    tidy = F.substring(F.call_function("array_join", lines, between), 1, LONGEST_ANSWER)
    dirty = f"[\\x00-\\x1F\\x7F]|[{SPACE}&&[^ ]]|  |^ | $"
    return F.when(whole.rlike(dirty) | (F.char_length(whole) > LONGEST_ANSWER), tidy).otherwise(whole)


def option_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def yes_no(c: Column) -> Column:
    """An answer without a Latin letter or digit counts as blank."""
    key = option_key(c)
    return F.when(key == "", "").when(key.isin(*YES), "Yes").when(key.isin(*NO), "No").otherwise(clean(c, False))


def checklist(c: Column) -> Column:
    """Items split at commas, semicolons and line ends; the first of each key stays; joined by a comma and a space."""
    items = F.filter(F.transform(F.split(c, r"[,;\n]"), lambda x: clean(x, False)), lambda x: x != "")
    firsts = F.filter(items, lambda x, i: F.array_position(F.transform(items, option_key), option_key(x)) == i + 1)
    return F.array_join(firsts, ", ")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


@F.pandas_udf(StringType())
def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda s: s and unicodedata.normalize("NFC", s), na_action="ignore")


def composed(c: Column) -> Column:
    """Unicode's composed form.  Plain ASCII, which is composed as it is, goes to Python as a null."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def loose(c: Column) -> Column:
    """For comparing: lower case, runs of white space and light punctuation as one space.  Composed text is expected."""
    return trimmed(F.regexp_replace(F.lower(c), f"[{SPACE}{LIGHT}]+", " "))


def _items_key(c: Column) -> Column:
    items = F.filter(F.transform(F.split(c, ","), trimmed), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(items, loose)))


def same_by_kind(a: Column, b: Column, kind: Column) -> Column:
    """Whether two readings of a field agree: by digits, as sets of items, or loosely."""
    a, b = composed(a), composed(b)
    return F.when(kind.isin("phone", "number"), digits(a) == digits(b)).when(kind == "checklist", _items_key(a) == _items_key(b)).otherwise(loose(a) == loose(b))


def same_reading(a: Column, b: Column, kind: str) -> Column:
    return same_by_kind(a, b, F.lit(kind))


def initials(c: Column) -> Column:
    words = F.slice(F.filter(F.split(trimmed(c), f"[{SPACE}]+"), lambda w: w != ""), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def is_reference(c: Column) -> Column:
    return c.rlike(REFERENCE)


def summary(parts: list[Column]) -> Column:
    kept = F.filter(F.transform(F.array(*parts), lambda x: trimmed(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_join(kept, " · ")


def is_uuid(c: Column) -> Column:
    return c.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def section_lines(values: Column, keys: Column, labels: Column) -> Column:
    """A section's fields that aren't blank, in order: an array of (label, value)."""
    pairs = F.zip_with(labels, keys, lambda name, k: F.struct(name.alias("label"), trimmed(F.coalesce(F.try_element_at(values, k), F.lit(""))).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")
