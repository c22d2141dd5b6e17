"""The two readings of a form as streams: joined within a time, or the one that came alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.operators.replies import agreed, paired


def double_reads(first: DataFrame, second: DataFrame, key: list[str], at: str = "at", apart: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """The rows of reconciled_readings() for two streams of rows as from readings(), each with its time `at`.

    Readings of a field meet if they are at most `apart` from each other.  A reading whose partner stays away comes out
    alone once the watermark, `late` behind the newest rows of the slower stream, is past all times at which the partner could
    still come; rows later than the watermark are dropped.  State holds the readings of that span only."""
    on = [*key, "field"]
    one, two = paired(first.withWatermark(at, late), second.withWatermark(at, late))
    two = two.withColumnsRenamed({c: f"_{c}" for c in (*on, at)})
    same = F.col(f"_{at}").between(F.col(at) - F.expr(f"interval {apart}"), F.col(at) + F.expr(f"interval {apart}"))
    for c in on:
        same &= F.col(c) == F.col(f"_{c}")
    both = one.join(two, same, "full_outer")
    return agreed(both.select(*(F.coalesce(c, f"_{c}").alias(c) for c in on), "kind_a", "kind_b", "a", "b"), on)
