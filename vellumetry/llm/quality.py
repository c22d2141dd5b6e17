"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose feature lies beyond a cutoff.  The rules' cutoffs move together over fixed levels, from
lax to strict, and a level is chosen per stratum (language) on labelled documents: levels are tested in that order, and
testing ends at the first one whose false rejection rate, the share of good documents that any rule would reject, has an
exact (Clopper-Pearson) upper bound above the allowed risk.  A fixed order needs no correction over levels; the confidence is
split over the strata (Bonferroni), so that all bounds hold together.  The levels are fixed in advance and nothing is
fitted but the stopping point, so the labelled documents are a holdout as they are.

Features come from one narrow pass over the texts.  Labels only meet the features, a few numbers a document; counts by
stratum are aggregated, tested and joined back in Spark, with as many strata as there are.

Defined cases: null text counts as empty and is rejected by the base rule; a null stratum counts as its own; strata
without enough labels take no level, so their rules reject nothing; repeated rows are judged each; several labels for
a document count each; columns named like a feature are carried by keep_good; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.common import few, fresh, map_columns, small_batches, written

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"


def features(text: str | None) -> tuple[int, ...]:
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() splits by exactly the six ASCII white-space characters
    n = len(words)
    continued = len(data) - len(data.translate(None, bytes(range(0x80, 0xC0))))
    space = len(data) - sum(map(len, words))
    word_chars = len(data) - continued - space
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    upper = len(data) - len(data.translate(None, _UPPER))
    marks = len(data) - len(data.translate(None, _MARKS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        codes: dict[bytes, int] = {}
        c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
        v = len(codes)
        pair = np.unique(c[:-1] * v + c[1:], return_inverse=True)[1]  # exact ids, no hashing
        three = np.unique(pair[:-1] * v + c[2:], return_inverse=True, return_counts=True)
        often = three[2][three[1]] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= often
        repeated = int(covered.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, marks


def with_features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the FEATURES columns; columns of those names are replaced."""
    small_batches(df.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    keep = [c for c in (keep or df.columns) if c not in names]
    return map_columns(df, [text], keep, lambda: lambda rows: (features(t) for (t,) in rows), FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects where value > cutoff.  levels: cutoffs to choose from, strictest first, as many for each rule."""

    name: str
    value: str
    levels: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6)),
    Rule("upper", "n_upper / greatest(word_chars, 1)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)),
    Rule("marks", "n_marks / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)),
)


def beyond(level: int, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where any rule rejects at a level."""
    return F.expr(" or ".join(f"{r.value} > {r.levels[level]!r}D" for r in rules))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws: the regularized incomplete beta function at 1 - p of n - k and k + 1, by its continued
    fraction, whose length grows with the root of n."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = float(n - k), k + 1.0, 1 - p
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # evaluated forwards as a ratio of products, one pair of terms a turn
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value, m = d, 0
    while True:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + t * d) or 1e-300), (1 + t / c) or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10_000_000:
            break
    return min(1.0, max(0.0, 1 - front * value if turned else front * value))


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact one-sided upper confidence bound of a rate seen k times in n."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > error else (low, mid)
    return high


def strictest(n: int, found: tuple[int, ...], risk: float, error: float) -> int | None:
    """The strictest level, tested from the laxest on, before the first one whose bound is above the risk.  found: good
    documents rejected at each level, strictest first, of n."""
    chosen = None
    for level in reversed(range(len(found))):
        if binomial_tail(found[level], n, risk) > error:  # as upper_bound(...) > risk
            break
        chosen = level
    return chosen


def thresholds(featured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """stratum and level of each stratum that has one.  risk: the most good documents, as a share, that the rules of a
    stratum may reject together.  Holds for all strata with probability 1 - error."""
    good = labels.where("quality = 1").select("doc_id")
    seen = featured.where(~base_failed()).join(good, "doc_id")
    levels = range(len(rules[0].levels))
    found = seen.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *(F.count_if(beyond(k, rules)).alias(f"at{k}") for k in levels))
    found = written(found, "strata")
    share = error / max(1, found.count())
    out = map_columns(found, ["n", *(f"at{k}" for k in levels)], ["stratum"], lambda: lambda rows: ((strictest(n, at, risk, share),) for n, *at in rows), "level int")
    return written(out.where("level is not null"), "levels")


def rejecting(featured: DataFrame, levels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Column]:
    """featured with the level of its stratum, and whether a rule rejects there.  Strata without a level reject nothing."""
    key, level = fresh(featured.columns, "stratum"), fresh(featured.columns, "level")
    joined = featured.join(few(levels.toDF(key, level)), F.col(stratum).eqNullSafe(F.col(key)), "left")
    over = [F.expr(f"{r.value} > element_at(array({', '.join(f'{c!r}D' for c in r.levels)}), {level} + 1)") for r in rules]
    return joined, F.coalesce(reduce(Column.__or__, over), F.lit(False))


def judged(documents: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The features of every document with base_failed and kept, each column of keep carried."""
    featured = written(with_features(documents, keep=keep), "features")
    joined, rejected = rejecting(featured, thresholds(featured, labels))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | rejected))


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = judged(documents.select("doc_id", "lang", "text"), labels, ["doc_id", "lang"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.  Two passes over the texts: cutoffs first, then the
    filter, so that no text is shuffled or written in between."""
    names = documents.columns
    featured = written(with_features(documents.select("doc_id", "lang", "text"), keep=["doc_id", "lang"]), "features")
    taken = {c: fresh(names, f"own_{c}") for c in names if c in {x.split()[0] for x in FEATURES.split(", ")}}
    again, rejected = rejecting(with_features(documents.withColumnsRenamed(taken)), thresholds(featured, labels))
    kept = again.where(~(base_failed() | rejected))
    return kept.select(*(F.col(taken.get(c, c)).alias(c) for c in names))
