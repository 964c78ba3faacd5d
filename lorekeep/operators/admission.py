"""Admission over a request log: token buckets per client, and requests in flight.

Both depend on order, yet neither is replayed in one long scan. Time is cut into blocks. What a block does to the
state it starts from is worked out in parallel, the small table of those effects is chained, and each block is then
replayed from its true start. One client with a third of all requests is therefore spread over all of its blocks.
"""

from __future__ import annotations

from typing import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.scale import ranged_sum, scan_groups

HOUR_MS = 3_600_000

# A token bucket in whole numbers. Time is ms * max_requests; a token takes ``window_ms`` of it to come back. The state
# is the time at which the bucket is full again, so the debt at time u is max(0, state - u).


def take(state: int, u: int, token: int, room: int) -> tuple[bool, int, int]:
    """(allowed, debt before, state after) for one request; ``room`` is the debt that still leaves one token."""
    debt = max(0, state - u)
    return (True, debt, u + debt + token) if debt <= room else (False, debt, state)


def effect_of(times: list[int], token: int, room: int) -> list[tuple[int, int, int, int]]:
    """End state of a block as a function of the state it starts from.

    Pieces (low, high, slope, base) over the debt d at the first request: the end state is base + slope * d. A request
    splits a piece where it would be treated differently; pieces that fill up become constant and melt together.
    """
    pieces = [(0, room + token, 1, times[0])]
    for u in times:
        after: list[tuple[int, int, int, int]] = []
        for low, high, slope, base in pieces:
            cuts = sorted({low, *(edge - base + 1 for edge in (u, u + room) if slope and low <= edge - base < high)})
            for start, stop in zip(cuts, [*cuts[1:], high + 1]):
                last = base + slope * (stop - 1)
                kind = (0, u) if last <= u else (slope, base)
                if last <= u + room:
                    kind = (kind[0], kind[1] + token)
                if after and after[-1][2:] == kind:
                    after[-1] = (after[-1][0], stop - 1, *kind)
                else:
                    after.append((start, stop - 1, *kind))
        pieces = after
    return pieces


def token_bucket(requests: DataFrame, window_ms: int, max_requests: int, block_ms: int = HOUR_MS) -> DataFrame:
    """requests(client, at, request_id) -> allowed, remaining, reset_seconds, retry_after_seconds.

    Continuous refill, a full bucket at the start, and a refused request takes nothing. Ties follow request_id.
    """
    token, room = window_ms, (max_requests - 1) * window_ms
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    timed = requests.select("client", "request_id", ms.alias("ms"), F.floor(ms / block_ms).cast("long").alias("block"))
    client = timed.schema["client"].dataType.simpleString()
    request = timed.schema["request_id"].dataType.simpleString()

    def effect(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        times = [int(t) * max_requests for (t,) in rows]
        yield (*key, times[0], [list(p) for p in effect_of(times, token, room)])

    def chain(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        state = 0
        for block, first, pieces in rows:
            state = max(state, int(first))
            yield (*key, block, state)
            debt = state - int(first)
            state = next(int(b) + int(s) * debt for low, high, s, b in pieces if low <= debt <= high)

    def replay(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        state = None
        for at, request_id, start in rows:
            allowed, debt, state = take(int(start) if state is None else state, int(at) * max_requests, token, room)
            left = room + token - debt
            reset = -(-debt // (max_requests * 1000))
            wait = -(-(token - left) // (max_requests * 1000))
            yield key[0], request_id, allowed, (left - token * allowed) // token, reset, max(1, wait)

    effects = scan_groups(
        timed, ["client", "block"], ["ms"], ["ms"], effect, f"client {client}, block long, first long, pieces array<array<long>>"
    )
    starts = scan_groups(
        effects, ["client"], ["block"], ["block", "first", "pieces"], chain, f"client {client}, block long, state long"
    )
    return scan_groups(
        timed.join(starts, ["client", "block"]),
        ["client", "block"],
        ["ms", "request_id"],
        ["ms", "request_id", "state"],
        replay,
        f"client {client}, request_id {request}, allowed boolean, remaining long, reset_seconds long, retry_after_seconds long",
    )


def in_flight(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests in flight after each start or end: keys, at, change, running. Ends come before starts at one instant.

    Edges are summed over time ranges of equal row counts, so a rush on one day spreads over many tasks.
    """
    keys = keys or []
    edges = F.explode(
        F.array(
            F.struct(F.col("started").alias("at"), F.lit(1).alias("change")),
            F.struct(F.col("ended").alias("at"), F.lit(-1).alias("change")),
        )
    )
    steps = intervals.select(*keys, edges.alias("_e")).select(*keys, "_e.at", "_e.change")
    # equal (time, change) edges are one step: fewer rows, and a total order
    merged = steps.groupBy(*keys, "at", "change").agg(F.sum("change").alias("moved"))
    return ranged_sum(merged, keys, ["at", "change"], F.col("moved"), "running")


def high_water(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Most requests in flight at once, per key or overall."""
    return in_flight(intervals, keys).groupBy(*(keys or [])).agg(F.max("running").alias("high_water"))
