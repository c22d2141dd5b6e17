"""The admission limiter as a stream: one small state a key, the times of its recent admissions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit_stream(attempts: DataFrame, limit: int, window_ms: int = 60_000) -> DataFrame:
    """attempts: key (string), at_ms, ord.  Attempts of one trigger are taken in order of at_ms, ord."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else ())
        rows = pd.concat(parts).sort_values(["at_ms", "ord"])
        out = []
        for at in rows["at_ms"].tolist():
            while held and at - held[0] >= window_ms:
                held.popleft()
            ok = limit <= 0 or len(held) < limit
            if ok and limit > 0:
                held.append(at)
            out.append(ok)
        state.update((list(held),))
        yield pd.DataFrame({"key": key[0], "at_ms": rows["at_ms"].tolist(), "ord": rows["ord"].tolist(), "admitted": out})

    return attempts.groupBy("key").applyInPandasWithState(step, "key string, at_ms long, ord long, admitted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)
