"""Words that a query adds to its session's previous one, over a stream.

The batch form is ``segment.query_diff``.  Here the last query of each session is state, kept
for ``idle`` after the session's latest event and dropped with the watermark, so state is bounded
by the sessions that are live.  Inside a micro-batch queries are taken in event order; one
that is later than the watermark is dropped before it gets here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "session_id string, query_id bigint, ts timestamp, new_words array<string>"


def _step(idle_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "query_id"])
        before, out = list(state.get[0]) if state.exists else None, []
        for r in rows.itertuples():
            words = [] if r.tokens is None else list(r.tokens)
            out.append((key[0], r.query_id, r.ts, [] if before is None else [w for w in words if w not in set(before)]))
            before = words
        state.update((before,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "query_id", "ts", "new_words"])

    return run


def query_diff(queries: DataFrame, late: str = "10 minutes", idle_ms: int = 30 * 60_000) -> DataFrame:
    """``session_id``, ``query_id``, ``ts`` and ``new_words`` of a stream with ``session_id``, ``query_id``, ``ts`` and ``tokens``.

    A session's first query, and the first after ``idle_ms`` without one, adds no words.
    """
    rows = queries.select(F.col("session_id").cast("string").alias("session_id"), F.col("query_id").cast("bigint").alias("query_id"), "ts", "tokens").withWatermark("ts", late)
    return rows.groupBy("session_id").applyInPandasWithState(_step(idle_ms), _OUT, "last array<string>", "append", GroupStateTimeout.EventTimeTimeout)
