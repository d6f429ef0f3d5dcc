"""Structured Streaming forms of span merging, window scores and chunk packing.

These are extensions: the batch operators define the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_spans(events: DataFrame, gap: str, delay: str = "1 hour", key: str = "track_id") -> DataFrame:
    """Spans of events (key, ts) no more than ``gap`` apart, closed once the watermark has passed."""
    sessions = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("_w"))
    return sessions.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).select(key, "start", "end", "n")


def window_scores(events: DataFrame, width: str = "2 seconds", hop: str = "1 second", delay: str = "10 seconds", key: str = "track_id") -> DataFrame:
    """Mean and greatest value of (key, ts, value) in sliding windows."""
    frames = events.withWatermark("ts", delay).groupBy(key, F.window("ts", width, hop).alias("_w"))
    return frames.agg(F.avg("value").alias("mean"), F.max("value").alias("peak")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "mean", "peak")


def pack_stream(segments: DataFrame, max_s: float, delay: str = "1 hour", idle_ms: int = 60_000) -> DataFrame:
    """Greedy chunks over a stream of segments (track_id, ts, start, end); state per track is one open chunk.

    Segments that arrive in one batch are taken in order of start. A chunk is emitted when
    the next segment no longer fits, and once the watermark is ``idle_ms`` past the track's last segment.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        out, latest = [], state.getCurrentWatermarkMs() + 1
        if state.hasTimedOut:
            out, open_ = [open_], None
        for frame in frames:
            latest = max(latest, int(frame["ts"].max().timestamp() * 1000) + idle_ms)
            for s, e in frame.sort_values(["start", "end"])[["start", "end"]].itertuples(index=False):
                if open_ and e - open_[0] <= max_s:
                    open_ = (open_[0], max(open_[1], e))
                    continue
                out += [open_] if open_ else []
                while e - s > max_s:
                    out.append((s, s + max_s))
                    s += max_s
                open_ = (s, e)
        if open_:
            state.update(open_)
            state.setTimeoutTimestamp(latest)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *c) for c in out], columns=["track_id", "start", "end"])

    kind = segments.schema["track_id"].dataType.simpleString()
    return (
        segments.withWatermark("ts", delay)
        .groupBy("track_id")
        .applyInPandasWithState(run, f"track_id {kind}, start double, end double", "start double, end double", "append", GroupStateTimeout.EventTimeTimeout)
    )
