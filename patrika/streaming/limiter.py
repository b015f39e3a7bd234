"""A sliding-log rate limiter over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patrika.operators.sequences import admit


def limited_stream(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """(client, request_id, allowed) for a stream of (client string, request_id bigint, at bigint seconds).

    The state of a client is the times of its admitted requests within the window, at most `limit` of them. Requests of
    one micro-batch are decided by time, then id; a request older than an earlier batch's is decided as if it came now.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"], kind="stable")
        times = [max(t, log[-1]) if log else t for t in rows["at"].tolist()]
        allowed = admit([*log, *times], limit, window_seconds)[len(log) :]
        kept = [t for t, ok in zip([*log, *times], [*([True] * len(log)), *allowed]) if ok]
        state.update(([int(t) for t in kept if t > times[-1] - window_seconds][-limit:],))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "allowed": allowed})

    return requests.groupBy("client").applyInPandasWithState(decide, "client string, request_id bigint, allowed boolean", "log array<bigint>", "append", GroupStateTimeout.NoTimeout)
