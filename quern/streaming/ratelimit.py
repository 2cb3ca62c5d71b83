"""A token bucket per key as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def take(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float]:
    """(allowed, tokens left) at time ``now``; time that runs backwards gives no tokens."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def limited(events: DataFrame, key: str, ts: str, rate: float = 1.0, burst: float = 5.0) -> DataFrame:
    """(key, t, allowed) for a stream of events.

    Events of a key within a batch are taken in order of time. The state of a key is two numbers;
    a key that was idle for burst / rate seconds has a full bucket, as a new one has. There is no
    timeout, because a processing-time timeout makes a stream run empty batches for ever.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        tokens, last = state.get if state.exists else (burst, float(rows["t"].iloc[0]))
        out = []
        for t in rows["t"].tolist():
            ok, tokens = take(tokens, last, t, rate, burst)
            last = max(last, t)
            out.append((k[0], t, ok))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=[key, "t", "allowed"])

    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).cast("double").alias("t"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, t double, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
