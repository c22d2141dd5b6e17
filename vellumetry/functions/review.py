"""What a person sees and types when a record is reviewed, and what the reader's service answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumetry.functions.text import SPACE, trimmed

#: The letters of a reference, the notes beside a field, and the types of pictures.  Fixed values.
LETTERS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
NOTES = {"unreadable": "Could not be read — check the paper", "notInOptions": "Not one of the printed options — check the paper"}
ONE_PASS = "Read on one pass only, blank on the other — check the paper"
JPEG, WEBP, PNG = "image/jpeg", "image/webp", "image/png"
#: The longest wait that an answer may ask for, in seconds.  A fixed value.
LONGEST_WAIT = 30


def flag(unreadable: Column, uncertain: Column, off_list: Column) -> Column:
    """The one flag that a field shows, the first that holds; null if none does."""
    return F.when(unreadable, "unreadable").when(uncertain, "uncertain").when(off_list, "notInOptions")


def note(shown: Column, alternative: Column) -> Column:
    """The note beside a flagged field; an uncertain one quotes the other reading."""
    quoted = F.when(F.coalesce(alternative, F.lit("")) == "", ONE_PASS).otherwise(F.concat(F.lit("Also read as “"), alternative, F.lit("” — check the paper")))
    plain = F.lit(None).cast("string")
    for name, words in NOTES.items():
        plain = F.when(shown == name, words).otherwise(plain)
    return F.when(shown == "uncertain", quoted).otherwise(plain)


def still_uncertain(alternative: Column, read: Column, now: Column) -> Column:
    """The other reading, as long as the value is the one that was read; null after an edit."""
    return F.when(read.eqNullSafe(now), alternative)


def save_error(title: Column, label: Column) -> Column:
    """Why a record can't be saved: it lacks its title."""
    return F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit("Enter the "), F.lower(label), F.lit(" before saving.")))


def typed_phone(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^0-9+()\-.{SPACE}]", "")


def shown_date(c: Column) -> Column:
    """A date or time stamp as 'Mar 05, 2026' in the session's time zone; other text as it is."""
    stamp = F.when(c.rlike(r"^\d{4}"), F.try_to_timestamp(c))
    return F.coalesce(F.date_format(stamp, "MMM dd, yyyy"), c)


def new_reference(prefix: Column, draws: list[Column] | None = None) -> Column:
    """The prefix, a dash and six letters by draws from [0, 1); random ones by default."""
    draws = draws or [F.rand() for _ in range(6)]
    letter = lambda d: F.substring(F.lit(LETTERS), F.floor(d * len(LETTERS)).cast("int") + 1, F.lit(1))
    return F.concat(prefix, F.lit("-"), *(letter(d) for d in draws))


def content_type(path: Column) -> Column:
    return F.when(path.endswith(".jpg") | path.endswith(".jpeg"), JPEG).when(path.endswith(".webp"), WEBP).otherwise(PNG)


def _string_at(body: Column, path: str) -> Column:
    """The string at a path of a JSON text; null for other types, for none, and for text that isn't JSON."""
    v = F.try_variant_get(F.try_parse_json(body), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def message_content(body: Column) -> Column:
    return _string_at(body, "$.choices[0].message.content")


def finish_reason(body: Column) -> Column:
    return _string_at(body, "$.choices[0].finish_reason")


def refusal(body: Column) -> Column:
    """The parts of the error in a refusal, null where it has none, and the whole text."""
    parts = {"message": "message", "code": "code", "type": "type", "failed_generation": "failed_generation"}
    return F.struct(*(_string_at(body, f"$.error.{at}").alias(name) for name, at in parts.items()), F.coalesce(body, F.lit("")).alias("text"))


def retry_after_ms(header: Column) -> Column:
    """The wait that an answer asks for, LONGEST_WAIT at most; null without a number from 0 up."""
    number = F.when(trimmed(header).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed(header).try_cast("double"))
    return F.when(number >= 0, F.least(number, F.lit(float(LONGEST_WAIT))) * 1000)
