"""Structured Streaming forms of the log's join, the rate limit and event-time volume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S = 60.0


def hourly_volume(events: DataFrame, ts: str = "ts", late: str = "24 hours") -> DataFrame:
    """Rows an hour and kind, closed when the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def rate_limited(requests: DataFrame, per_minute: int) -> DataFrame:
    """``caller``, ``ts``, ``key``, ``admitted`` of a stream of requests: the batch operator's fold with kept state.

    State is the admitted times of the last minute, at most ``per_minute`` numbers a caller.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        # One caller's part of one micro-batch, which the trigger bounds.
        f = pd.concat(list(frames)).sort_values(["ts", "key"])
        out = []
        for t in f.ts:
            hits = [h for h in hits if t - h < WINDOW_S]
            ok = len(hits) < per_minute
            if ok:
                hits.append(float(t))
            out.append(ok)
        state.update((hits,))
        yield pd.DataFrame({"caller": key[0], "ts": f.ts, "key": f["key"], "admitted": out})

    return requests.groupBy("caller").applyInPandasWithState(fold, "caller string, ts double, key long, admitted boolean", "hits array<double>", "append", GroupStateTimeout.NoTimeout)


def joined_outcomes(log: DataFrame, keep: str = "30 days") -> DataFrame:
    """Every ask with its outcomes so far, sent again whenever an outcome arrives or changes.

    ``log`` is a stream with ``log_pos``, ``received_at``, ``kind``, ``id`` and ``outcomes``. A
    stream-stream join sends a row once and can't correct it, so the latest ask and outcome by
    log position are kept as state for each id, and dropped once the stream is ``keep`` past it.
    """

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ask, out_pos, out = state.get if state.exists else (-1, -1, None)
        last = state.getCurrentWatermarkMs()
        for f in frames:
            for kind, pos, outcomes, at in zip(f.kind, f.log_pos, f.outcomes, f.received_ms, strict=True):
                last = max(last, int(at))
                if kind == "ask":
                    ask = max(ask, int(pos))
                elif pos > out_pos:
                    out_pos, out = int(pos), outcomes
        state.update((ask, out_pos, out))
        state.setTimeoutTimestamp(last + 1)
        if ask >= 0:
            yield pd.DataFrame({"id": [key[0]], "ask_pos": [ask], "outcome_pos": [out_pos if out_pos >= 0 else None], "outcomes": [out]})

    timed = log.where(F.col("id").isNotNull()).withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", keep)
    keyed = timed.withColumn("received_ms", F.unix_millis("received_at")).groupBy("id")
    return keyed.applyInPandasWithState(merge, "id string, ask_pos long, outcome_pos long, outcomes string", "ask long, pos long, outcomes string", "append", GroupStateTimeout.EventTimeTimeout)
