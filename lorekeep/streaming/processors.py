"""Keyed state with event-time timers: taken proposals, first outcomes, answers put together, first tokens.

State of the confirmations, first outcomes and first tokens lies in buckets by a hash of the key: a batch reads the buckets
of its keys, with all that is still remembered in them, so its cost follows the keys that are alive. Each key's state goes
when the watermark has passed the last time at which it can matter. Rows that come later than the watermark allows are left
out by Spark itself, and counted in its progress. Run these with ``drain(..., keyed=True)`` or a session whose state
store is RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GONE, APPLIED, REJECTED = "gone", "applied", "rejected"
VERDICT = ("site_id", "confirm_id", "proposal_id", "subject", "at", "status")
REPLY = ("request_id", "owner", "key", "outcome", "replayed", "error")


def ordered(value: Any) -> Any:
    """A struct as its values, so that it can be compared."""
    return tuple(value.values()) if isinstance(value, dict) else value


def frozen(value: Any) -> Any:
    """A key as a value that can be looked up: structs and arrays as tuples."""
    if isinstance(value, dict):
        value = tuple(value.values())
    return tuple(map(frozen, value)) if isinstance(value, (list, tuple)) else value


#: Keys are looked after together, in buckets by their hash: a call, a timer and a batch of results for each key cost a
#: thousand times what its rows do.
KEY_BUCKETS = 1024


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket")


class Bucketed(StatefulProcessor):
    """What is remembered of the keys of a bucket, each until a time of its own (``until_ms``, the last field).

    ``state`` lists the fields, ``width`` of them the key. One timer, at the earliest of the times, clears what is over.
    """

    def __init__(self, state: str, width: int):
        self.state, self.width = f"{state}, until_ms long", width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", self.state)

    def known(self) -> dict[Any, tuple]:
        entries = map(tuple, self.kept.get()) if self.kept.exists() else ()
        return {frozen(entry[: self.width]): entry for entry in entries}

    def remember(self, known: dict[Any, tuple], changed: dict[Any, tuple]) -> None:
        if not changed:
            return
        due = min((entry[-1] for entry in known.values()), default=None)
        if known.keys().isdisjoint(changed):
            self.kept.appendList(list(changed.values()))
        else:
            self.kept.put(list((known | changed).values()))
        self._wake(due, min(entry[-1] for entry in (known | changed).values()))

    def _wake(self, before: int | None, due: int) -> None:
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        left = [entry for entry in self.known().values() if entry[-1] > now]
        if left:
            self.kept.put(left)
            self._wake(None, min(entry[-1] for entry in left))
        else:
            self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


class Settle(Bucketed):
    """The first valid confirmation of a proposal is applied or rejected, every other one is gone."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, best, verdict = None, {}, Row(*VERDICT)
        for site, confirm, proposal, subject, at, accepted, valid, us, until, _ in rows:
            told = (site, confirm, proposal, subject, at)
            if valid:
                known = self.known() if known is None else known
                name = frozen((site, proposal))
                if name not in known:
                    new = ((us, ordered(confirm)), told, accepted, until)
                    old = best.get(name)
                    if old is None or new[0] < old[0]:
                        best[name] = new
                        told = old and old[1]
            if told is not None:
                yield verdict(*told, GONE)
        for _, told, accepted, _ in best.values():
            yield verdict(*told, APPLIED if accepted else REJECTED)
        self.remember(known or {}, {name: (told[0], told[2], until) for name, (_, told, _, until) in best.items()})  # nobody can validly confirm after that


def confirm_stream(confirms: DataFrame, proposals: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of confirms(confirm_id, site_id, proposal_id, subject, at) against the table of proposals -> status per row.

    As in the batch form, valid means same subject and not expired, and a stranger uses nothing up. The earliest valid one
    of the first batch that holds any wins. A taken proposal is remembered until it expires, and no longer; of a million
    confirmations in one batch only the best so far is held.
    """
    known = proposals.select("site_id", F.col("id").alias("proposal_id"), F.col("subject").alias("_owner"), "expires_at", "accepted")
    valid = F.coalesce((F.col("subject") == F.col("_owner")) & (F.col("expires_at") > F.col("at")), F.lit(False))
    matched = confirms.withWatermark("at", late).join(known, ["site_id", "proposal_id"], "left")
    times = [F.unix_micros("at").alias("us"), (F.unix_millis("expires_at") + 1).alias("until")]
    rows = matched.select(*VERDICT[:-1], "accepted", valid.alias("valid"), *times, bucket("site_id", "proposal_id"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in VERDICT[:-1]}
    settle = Settle(f"site_id {kind['site_id']}, proposal_id {kind['proposal_id']}", 2)
    schema = ", ".join(f"{c} {kind[c]}" for c in kind)
    return rows.groupBy("_bucket").transformWithState(settle, f"{schema}, status string", "append", "EventTime")


class FirstOutcome(Bucketed):
    """Every request of a key gets the outcome of the first."""

    def __init__(self, state: str, width: int, keep_ms: int):
        super().__init__(state, width)
        self.keep_ms = keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, changed, reply = self.known(), {}, Row(*REPLY)
        requests = sorted(((us, ordered(request), request, owner, name, outcome) for request, owner, name, outcome, _, us, _ in rows), key=lambda r: r[:2])
        for us, _, request, owner, name, outcome in requests:
            place = frozen((owner, name))
            first = changed.get(place) or known.get(place)
            replayed = first is not None and us <= first[3] + self.keep_ms * 1000
            if not replayed:
                first = changed[place] = (owner, name, outcome, us, us // 1000 + self.keep_ms)
            yield reply(request, owner, name, first[2], replayed, None)
        self.remember(known, changed)


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType)
PLAIN = (*WHOLE, T.StringType, T.FloatType, T.DoubleType)


def packed(value: Column, kind: T.DataType) -> Column:
    """A plain value as a long, a double or a text that pandas keeps exactly; nulls are told apart beside it."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(value.cast("double"), F.lit(0.0))
    number = F.unix_date(value) if isinstance(kind, T.DateType) else F.unix_micros(value) if isinstance(kind, T.TimestampType) else value
    return F.coalesce(number.cast("long"), F.lit(0).cast("long"))


def packed_type(kind: T.DataType) -> str:
    return "string" if isinstance(kind, T.StringType) else "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "long"


def unpacked(name: str, kind: T.DataType, null: Column) -> Column:
    value = F.col(name)
    if isinstance(kind, T.DateType):
        value = F.date_from_unix_date(value.cast("int"))
    elif isinstance(kind, T.TimestampType):
        value = F.timestamp_micros(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.coalesce(value, F.lit(float("nan")))  # pandas has no other null
    return F.when(~null, value.cast(kind))


class FirstOutcomes(Bucketed):
    """``FirstOutcome`` of plain columns, a bucket's rows of a batch at a time.

    Rows hold the packed fields of the request (``width`` of them, r0 ..), owner, key, outcome, us and ``nulls``, a bit for
    each field, then for owner and outcome.
    """

    def __init__(self, state: str, fields: int, keep_ms: int):
        super().__init__(state, 2)
        self.fields, self.keep_ms = fields, keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        if not len(frame):
            return
        if frame["us"].isna().any():
            raise ValueError("a request needs a time")
        known, keep = self.known(), self.keep_ms * 1000
        nulls = frame["nulls"].to_numpy()
        null = lambda i: (nulls >> i) & 1
        owners, names = pd.factorize(frame["owner"])[0] + 1, pd.factorize(frame["key"])[0]
        pairs = (owners * (int(names.max()) + 1) + names) * 2 + null(self.fields)
        _, sample, group = np.unique(pairs, return_index=True, return_inverse=True)
        order = np.lexsort([*self._ranks(frame, null), frame["us"].to_numpy(), group])
        at, group = frame["us"].to_numpy()[order], group[order]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        one = frame.iloc[sample]
        places = [(None if n else o, k) for o, k, n in zip(one["owner"].tolist(), one["key"].tolist(), null(self.fields)[sample].tolist())]
        before = [known.get(place) for place in places]
        held = np.array([b is not None for b in before])
        first_at = np.where(held, [b[3] if b else 0 for b in before], at[start])
        # the row whose outcome counts, or the group, from -1 down, whose known one does
        source = np.where(held, -1 - np.arange(len(start)), start)[group]
        newest = np.where(held, -1, start)
        over = np.flatnonzero(at > first_at[group] + keep)
        for g, i in zip(*np.unique(group[over], return_index=True)):
            low, end = over[i], start[g + 1] if g + 1 < len(start) else len(at)
            while low < end:
                high = low + np.searchsorted(at[low:end], at[low] + keep, "right")
                source[low:high], newest[g], low = low, low, high
        outcomes, none = frame["outcome"].to_numpy()[order], null(self.fields + 1)[order] == 1
        told, empty = outcomes[np.maximum(source, 0)], none[np.maximum(source, 0)]
        old = np.flatnonzero(source < 0)
        if len(old):
            values = [b[2] if b else None for b in before]
            of = -1 - source[old]
            told[old] = np.array([None if v is None and told.dtype == object else v or 0 for v in values], dtype=told.dtype)[of]
            empty[old] = np.array([v is None for v in values])[of]
        columns = [*(f"r{i}" for i in range(self.fields)), "owner", "key"]
        out = {c: frame[c].to_numpy()[order] for c in columns}
        yield pd.DataFrame(out | {"outcome": told, "nulls": nulls[order], "no_outcome": empty, "replayed": source != np.arange(len(at))})
        new = np.flatnonzero(newest >= 0)
        rows_of = newest[new]
        made = zip(new.tolist(), outcomes[rows_of].tolist(), none[rows_of].tolist(), at[rows_of].tolist())
        self.remember(known, {places[g]: (*places[g], None if no else o, us, us // 1000 + self.keep_ms) for g, o, no, us in made})

    def _ranks(self, frame: pd.DataFrame, null) -> list[np.ndarray]:
        """Sort keys of the request, the last field first; nulls come first."""
        keys: list[np.ndarray] = []
        for i in reversed(range(self.fields)):
            values = frame[f"r{i}"]
            keys.append(pd.factorize(values, sort=True)[0] if values.dtype == object else values.to_numpy())
            if (unknown := null(i)).any():
                keys.append(1 - unknown)
        return keys


def _plain_replies(timed: DataFrame, keep_seconds: int) -> DataFrame | None:
    """The replies of ``apply_once_stream`` without Python objects per row, if all columns are plain or flat structs of such."""
    request, owner, key, outcome = (timed.schema[c].dataType for c in ("request_id", "owner", "key", "outcome"))
    flat = isinstance(request, T.StructType)
    kinds = [f.dataType for f in request.fields] if flat else [request]
    parts = [F.col("request_id").getField(f.name) for f in request.fields] if flat else [F.col("request_id")]
    texts = [k for k in (*kinds, owner, key, outcome) if isinstance(k, T.StringType)]
    if len(kinds) > 50 or not all(isinstance(k, PLAIN) for k in (*kinds, outcome)) or not isinstance(owner, (*WHOLE, T.StringType)) or not isinstance(key, T.StringType) or any(k != T.StringType() for k in texts):
        return None
    places = [*parts, F.col("owner"), F.col("outcome")]
    nulls = sum((F.when(c.isNull(), 1 << i).otherwise(0).cast("long") for i, c in enumerate(places)), F.lit(0).cast("long"))
    whole = F.col("request_id").isNull().cast("long") * (1 << len(places))  # a null struct is not a struct of nulls
    packs = {f"r{i}": packed(c, k) for i, (c, k) in enumerate(zip(parts, kinds))} | {"owner": packed(F.col("owner"), owner), "outcome": packed(F.col("outcome"), outcome)}
    rows = timed.select(*[c.alias(n) for n, c in packs.items()], "key", "at", "us", (nulls + whole).alias("nulls"), "_bucket")
    state = f"owner {packed_type(owner)}, key string, outcome {packed_type(outcome)}, us long"
    schema = ", ".join([*(f"r{i} {packed_type(k)}" for i, k in enumerate(kinds)), f"owner {packed_type(owner)}", "key string", f"outcome {packed_type(outcome)}", "nulls long, no_outcome boolean, replayed boolean"])
    told = rows.groupBy("_bucket").transformWithStateInPandas(FirstOutcomes(state, len(kinds), keep_seconds * 1000), schema, "append", "EventTime")
    bit = lambda i: F.col("nulls").bitwiseAND(F.lit(1 << i)) != 0
    fields = [unpacked(f"r{i}", k, bit(i)) for i, k in enumerate(kinds)]
    named = F.when(~bit(len(places)), F.struct(*[c.alias(f.name) for c, f in zip(fields, request.fields)])) if flat else fields[0]
    return told.select(
        named.cast(request).alias("request_id"), unpacked("owner", owner, bit(len(kinds))).alias("owner"), "key",
        unpacked("outcome", outcome, F.col("no_outcome")).alias("outcome"), "replayed", F.lit(None).cast("string").alias("error"),
    )


def apply_once_stream(requests: DataFrame, keep_seconds: int, late: str = "1 hour") -> DataFrame:
    """Stream of requests(request_id, owner, key, outcome, at) -> request_id, owner, key, outcome, replayed, error.

    ``outcome`` of a request is what applying it would give; a repeat within ``keep_seconds`` of the first gets the first
    one's, one after that begins anew. Requests without a key have an error and no outcome, and no state. The requests of a
    batch are ordered by time within their bucket of keys, so those are held; the size of a batch is set at the source.
    """
    keyed = F.coalesce("key", F.lit("")) != ""
    kind = {c: requests.schema[c].dataType.simpleString() for c in ("request_id", "owner", "key", "outcome")}
    schema = ", ".join(f"{c} {kind[c]}" for c in kind) + ", replayed boolean, error string"
    timed = requests.withWatermark("at", late).select(*kind, "at", F.unix_micros("at").alias("us"), bucket("owner", "key"))
    replies = _plain_replies(timed.filter(keyed), keep_seconds)
    if replies is None:
        first = FirstOutcome(", ".join(f"{c} {kind[c]}" for c in ("owner", "key", "outcome")) + ", us long", 2, keep_seconds * 1000)
        replies = timed.filter(keyed).groupBy("_bucket").transformWithState(first, schema, "append", "EventTime")
    errors = timed.filter(~keyed).select(
        "request_id", "owner", "key", F.lit(None).cast(kind["outcome"]).alias("outcome"), F.lit(None).cast("boolean").alias("replayed"), F.lit("IDEMPOTENCY_KEY_REQUIRED").alias("error")
    )
    return replies.union(errors)


class Reorder(StatefulProcessor):
    """Pieces of an answer in a list, until ``done`` and all before it are there, or the turn is idle."""

    def __init__(self, key_type: str, idle_ms: int):
        self.key_type, self.idle_ms = key_type, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, text string")
        self.seen = handle.getValueState("seen", "events long, last long, timer long, emitted boolean")

    def _answer(self, key: Any) -> Iterator[Row]:
        said = "".join(text for _, text in sorted((p[0], p[1]) for p in self.pieces.get()))
        self.pieces.clear()
        if said:
            yield Row("key", "answer")(key[0], said)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events, last, timer, emitted = self.seen.get() if self.seen.exists() else (0, -1, 0, False)
        new, latest = [], 0
        for row in rows:
            events += 1
            latest = max(latest, row["ms"])
            if row["type"] == "done":
                last = row["seq"]
            elif row["type"] == "delta" and row["text"] and not emitted:
                new.append((row["seq"], row["text"]))
        if new:
            self.pieces.appendList(new)
        if not emitted and last >= 0 and events > last:  # events are numbered from 0
            emitted = True
            yield from self._answer(key)
        due = latest + self.idle_ms
        if due > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.seen.update((events, last, timer, emitted))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.seen.get()[3]:
            yield from self._answer(key)
        self.seen.clear()

    def close(self) -> None:
        pass


def answers_stream(events: DataFrame, key: str = "turn_id", idle_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Stream of events(key, type, seq, text, at) in any order -> one row per turn: its key and answer.

    Events of a turn are numbered from 0 without gaps. An answer goes out as soon as ``done`` and everything before it has
    arrived; a turn without an end, or with a piece missing, goes out with what there is once the watermark is past its
    newest event by ``idle_seconds``. Pieces that come after that are a turn of their own; turns without text have no row.
    """
    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return timed.groupBy(key).transformWithState(Reorder(kind, idle_seconds * 1000), f"key {kind}, answer string", "append", "EventTime").withColumnRenamed("key", key)


class FirstToken(Bucketed):
    """One row at a turn's first delta; later ones find the flag."""

    def __init__(self, state: str, width: int, idle_ms: int):
        super().__init__(state, width)
        self.idle_ms = idle_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen: dict[Any, list] = {}  # of each turn in this batch: its name, start, first delta and newest event
        for turn, kind, ms, _, _ in rows:
            at = seen.setdefault(frozen(turn), [turn, None, None, 0])
            at[3] = max(at[3], ms)
            place = 1 if kind == "start" else 2
            at[place] = ms if at[place] is None else min(at[place], ms)
        known, changed, token = self.known(), {}, Row("key", "first_token_ms")
        for name, (turn, start, first, latest) in seen.items():
            before = known.get(frozen((turn,)))
            _, begun, told, until = before or (turn, None, False, latest + self.idle_ms)
            if start is not None:
                begun = start if begun is None else min(begun, start)
            if first is not None and begun is not None and not told:
                told = True
                yield token(turn, first - begun)
            if (now := (turn, begun, told, until)) != before:
                changed[frozen((turn,))] = now
        self.remember(known, changed)


def first_token_stream(events: DataFrame, key: str = "turn_id", idle_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Stream of events(key, type, at) -> key, first_token_ms, told at the first delta, long before the turn ends.

    The events of a turn must come in batches in order (any order within one). A turn is forgotten ``idle_seconds`` after
    its first batch, so give more than the longest turn takes.
    """
    kind = events.schema[key].dataType.simpleString()
    timed = events.filter(F.col("type").isin("start", "delta")).withWatermark("at", late).select(F.col(key).alias("key"), "type", F.unix_millis("at").alias("ms"), "at", bucket(key))
    first = FirstToken(f"key {kind}, start_ms long, told boolean", 1, idle_seconds * 1000)
    return timed.groupBy("_bucket").transformWithState(first, f"key {kind}, first_token_ms long", "append", "EventTime").withColumnRenamed("key", key)
