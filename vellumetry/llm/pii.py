"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

A proposal starts at its kind's prior.  A validator that fails drops it (Luhn for cards, mod-97 for account numbers,
part ranges for addresses).  Words of the kind within CONTEXT characters before or after raise the score, words that
speak against it lower it; spans at THRESHOLD or more stay.  The four base kinds start at the threshold and can't lose
(their rules alone decide); account numbers and local numbers are added by score.

Defined cases: null text counts as empty and has no spans; repeated rows are searched each; other columns are carried.
All searches are linear in the text, for long runs too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import map_columns, small_batches

#: Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone", "national_id")
CONTEXT, THRESHOLD = 48, 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20-])[0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9A-Za-z-])")
_NATIONAL_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

#: Words that speak for a kind, in several languages, and words that speak against any.  Fixed values.
FOR = {
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "banque", "banco"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "rufnummer"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
}
AGAINST = ("isbn", "order no", "invoice", "version", "serial", "part no", "sku")
_words = lambda words: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)")
_FOR, _AGAINST = {k: _words(w) for k, w in FOR.items()}, _words(AGAINST)
PRIOR = {"iban": 0.6, "local_phone": 0.3, "national_id": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    rest = 0
    for c in s[4:] + s[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return 15 <= len(s) <= 34 and rest == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local-part@domain, found from each @: the local part is the run before it, since @ isn't in it."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            before = text[free:at]
            start = free + len(before.rstrip(_LOCAL))
            if start < at:
                yield start, domain.end()
                free = domain.end()
                at = text.find("@", free)
                continue
        free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """The base spans: (start, kind, end)."""
    out = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each proposal the longest prefix, ending where a space or the proposal does, that passes mod-97; else the search
    goes on inside the proposal.  A proposal has 43 characters at most, so this stays linear."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        end = next((e for e in range(b, a, -1) if (e == b or text[e] == " ") and mod97(text[a:e])), a)
        if end > a:
            yield a, end
        m = _IBAN.search(text, max(end, a + 1))


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    return PRIOR[kind] + 0.35 * bool(_FOR[kind].search(near)) - 0.35 * bool(_AGAINST.search(near))


def added_spans(text: str) -> list[tuple[int, str, int]]:
    found = [("iban", a, b) for a, b in _ibans(text)]
    for kind, pattern in (("local_phone", _LOCAL_PHONE), ("national_id", _NATIONAL_ID)):
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return [(a, kind, b) for kind, a, b in found if _score(text, kind, a, b) >= THRESHOLD]


_ORDER = {k: i for i, k in enumerate(KINDS)}


def listed(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[1]]))


def spans_of(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    if not text:
        return [], []
    base = base_spans(text)
    return listed(base), listed(base + added_spans(text))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add base (joined base spans), spans (joined, all) and n_<base kind>."""

    def row(t: str | None) -> tuple:
        base, every = spans_of(t)
        kinds = [k for _, k, _ in base]
        return joined(base), joined(every), *map(kinds.count, BASE_KINDS)

    small_batches(df.sparkSession)
    added = ["base", "spans", *(f"n_{k}" for k in BASE_KINDS)]
    keep = [c for c in (keep or df.columns) if c not in added]
    return map_columns(df, [text], keep, lambda: lambda rows: (row(t) for (t,) in rows), "base string, spans string, " + ", ".join(f"n_{k} long" for k in BASE_KINDS))


def masked(text: str | None) -> str | None:
    """The text with each found span, overlapping ones together, replaced by its kind in angle brackets."""
    if not text:
        return text
    out, at = [], 0
    for a, kind, b in spans_of(text)[1]:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by its masked form; null stays null."""
    small_batches(df.sparkSession)
    names = df.columns
    kept = map_columns(df, [text], [c for c in names if c != text], lambda: lambda rows: ((masked(t),) for (t,) in rows), f"`{text}` string")
    return kept.select(*names)


def digests(documents: DataFrame) -> DataFrame:
    found = find_spans(documents.select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
