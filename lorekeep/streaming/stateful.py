"""Operators that remember something per key between batches: live conversations and token buckets."""

from __future__ import annotations

from heapq import merge
from typing import Any, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators.admission import take

TURN = ["seq", "us", "role", "content"]
CONVERSATION_STATE = "seq array<long>, us array<long>, role array<string>, content array<string>"


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> Iterator[tuple]:
    """The rows of one key in order, a frame at a time where the frames follow one another, else merged by sorted frame."""
    parts = [frame.sort_values(order)[order].itertuples(index=False, name=None) for frame in frames]
    return merge(*parts)


def conversation_state(turns: DataFrame, max_stored: int, idle_seconds: int, late: str = "1 hour") -> DataFrame:
    """Stream of turns(site_id, conversation_id, seq, at, role, content) -> the live turns after each batch.

    The newest ``max_stored`` turns are kept, and a pause longer than the idle time empties the conversation first. Time
    is event time only: state leaves the store once the watermark (``late`` behind the newest turn) has passed the
    last turn by the idle time, so the answer does not depend on how fast the job runs, and a stream ends when its
    input does. A turn that comes behind the watermark is still taken.
    """
    idle_us = idle_seconds * 1_000_000
    conversation = turns.schema["conversation_id"].dataType.simpleString()

    def update(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        for us, seq, role, content in _rows(frames, ["us", "seq", "role", "content"]):
            if kept and us - kept[-1][1] > idle_us:
                kept = []
            kept = [*kept, (seq, us, role, content)][-max_stored:]
        state.update(tuple(list(column) for column in zip(*kept)))
        state.setTimeoutTimestamp(max(kept[-1][1] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        out = pd.DataFrame(kept, columns=TURN)
        out.insert(0, "site_id", key[0])
        out.insert(1, "conversation_id", key[1])
        yield out.assign(position=range(1, len(out) + 1))

    return (
        turns.withWatermark("at", late)
        .withColumn("us", F.unix_micros("at"))
        .groupBy("site_id", "conversation_id")
        .applyInPandasWithState(
            update,
            f"site_id string, conversation_id {conversation}, seq long, us long, role string, content string, position long",
            CONVERSATION_STATE,
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def rate_limit_stream(requests: DataFrame, window_ms: int, max_requests: int, late: str = "1 hour") -> DataFrame:
    """Stream of requests(client, request_id, at) -> allowed per request, in event-time order within each batch.

    A client is forgotten once the watermark has passed the time at which its bucket is full again, never before, so a
    backlog or a replay gives the same answers.
    """
    client = requests.schema["client"].dataType.simpleString()
    request = requests.schema["request_id"].dataType.simpleString()
    token, room = window_ms, (max_requests - 1) * window_ms

    def update(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        full_at = int(state.get[0]) if state.exists else 0
        out = []
        for ms, request_id in _rows(frames, ["ms", "request_id"]):
            allowed, _, full_at = take(full_at, int(ms) * max_requests, token, room)
            out.append((key[0], request_id, allowed))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["client", "request_id", "allowed"])
                out = []
        state.update((full_at,))
        state.setTimeoutTimestamp(max(-(-full_at // max_requests), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["client", "request_id", "allowed"])

    at = F.col("at").cast("timestamp")
    timed = requests.select("client", "request_id", at.alias("at")).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("client").applyInPandasWithState(
        update,
        f"client {client}, request_id {request}, allowed boolean",
        "full_at long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
