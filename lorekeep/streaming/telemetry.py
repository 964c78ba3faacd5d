"""Metrics over arriving events. The batch operators run on streaming frames; these add watermarks and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.telemetry import REJECTIONS, counter, finish_reason, histogram, route_fold, turn_outcome, turn_summary


def windowed_counter(events: DataFrame, at: str, window: str, labels: list[str], watermark: str, by: Column | None = None) -> DataFrame:
    """Counter per time window. ``watermark`` says how late an event may come: state of older windows is dropped."""
    timed = events.withWatermark(at, watermark).withColumn("window", F.window(at, window))
    return counter(timed, ["window", *labels], by)


def windowed_histogram(events: DataFrame, at: str, window: str, value: Column, bounds: tuple, labels: list[str], watermark: str) -> DataFrame:
    timed = events.withWatermark(at, watermark).withColumn("window", F.window(at, window))
    return histogram(timed, value, bounds, ["window", *labels])


def stream_sessions(events: DataFrame, idle: str, watermark: str, key: str = "turn_id") -> DataFrame:
    """One row per turn once it is idle: completed or abandoned, and its time to the first token."""
    first = F.min(F.when(F.col("type") == "delta", F.unix_millis("at")))
    start = F.min(F.when(F.col("type") == "start", F.unix_millis("at")))
    return (
        events.withWatermark("at", watermark)
        .groupBy(F.session_window("at", idle).alias("session"), key)
        .agg(
            F.max((F.col("type") == "done").cast("int")).alias("_done"),
            (first - start).alias("first_token_ms"),
            F.count("*").alias("events"),
        )
        .select(
            key,
            F.col("session.start").alias("started"),
            F.when(F.col("_done") == 1, "completed").otherwise("abandoned").alias("outcome"),
            "first_token_ms",
            "events",
        )
    )


def turn_outcomes_stream(starts: DataFrame, dones: DataFrame, no_answer: str, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """One row per started turn with its outcome: turn_id, mode, begun, outcome.

    ``starts``: turn_id, mode, at. ``dones``: turn_id, answer, grounded, at. An ended turn goes out at once; one without an
    end goes out when no end can come any more, ``longest`` after its start and ``late`` for both streams.
    """
    begun = starts.select("turn_id", "mode", F.col("at").alias("begun")).withWatermark("begun", late)
    ended = dones.select(F.col("turn_id").alias("_turn"), "answer", "grounded", F.col("at").alias("ended")).withWatermark("ended", late)
    joined = begun.join(ended, F.expr(f"turn_id = _turn AND ended >= begun AND ended <= begun + INTERVAL {longest}"), "left_outer")
    outcome = turn_outcome(F.col("mode"), F.col("answer"), F.col("grounded"), F.col("_turn").isNotNull(), no_answer)
    return joined.select("turn_id", "mode", "begun", outcome.alias("outcome"))


def turn_summary_stream(events: DataFrame, window: str = "1 day", late: str = "10 minutes", by: tuple[str, ...] = ("mode",)) -> DataFrame:
    """The summary of all turns per time window, from the events of each turn: two aggregations, one behind the other.

    ``events``: turn_id, at, round, sources, history_turns, persisted, grounded and ``by``. The first aggregation closes a
    turn in the window of its events, the second sums the turns of the window; both let go of a window once it has passed.
    """
    each = (
        events.withWatermark("at", late)
        .groupBy(F.window("at", window).alias("w"), "turn_id", *by)
        .agg(
            F.max("round").alias("rounds"),
            F.max("sources").alias("sources"),
            F.max("history_turns").alias("history_turns"),
            F.bool_or("persisted").alias("persisted"),
            F.bool_or("grounded").alias("grounded"),
        )
    )
    timed = each.withColumn("window", F.window(F.window_time("w"), window))
    return turn_summary(timed, ["window", *by]).withColumn("window_start", F.col("window.start")).drop("window")


#: A counter to be kept: its name, the events that it counts, its labels, and what each event adds.
Series = tuple[str, Column, dict[str, Column], Column]


def counters_stream(events: DataFrame, series: list[Series], window: str = "1 day", late: str = "10 minutes", at: str = "at") -> DataFrame:
    """Any number of counters from one pass and one state: window_start, metric, labels, count.

    A window goes out once no event of it can come any more. Label values are texts; a null label is kept as null.
    """

    def one(name: str, wanted: Column, labels: dict[str, Column], amount: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in labels.items()]).cast("array<struct<label:string,value:string>>")
        return F.when(wanted, F.struct(F.lit(name).alias("metric"), pairs.alias("labels"), amount.cast("long").alias("amount")))

    told = F.filter(F.array(*[one(*s) for s in series]), lambda s: s.isNotNull())
    flat = events.withWatermark(at, late).select(at, F.explode(told).alias("s")).select(at, "s.*")
    summed = flat.groupBy(F.window(at, window).alias("w"), "metric", "labels").agg(F.sum("amount").alias("count"))
    return summed.select(F.col("w.start").alias("window_start"), "metric", F.map_from_entries("labels").alias("labels"), "count")


def http_series() -> list[Series]:
    """Of a log(path, method, status): requests, and refusals by reason."""
    names = F.create_map(*[F.lit(x) for pair in REJECTIONS.items() for x in pair])
    reason = F.try_element_at(names, F.col("status").cast("int"))
    labels = {"route": route_fold(F.col("path")), "method": F.col("method"), "status": F.col("status")}
    return [("requests", F.lit(True), labels, F.lit(1)), ("rejections", reason.isNotNull(), {"reason": reason}, F.lit(1))]


def tool_series() -> list[Series]:
    return [("tool_rounds", F.col("type") == "tool", {"tool": F.col("tool"), "phase": F.col("phase")}, F.lit(1))]


def call_series() -> list[Series]:
    """Of parsed model calls: tokens by kind where any were reported, and finish reasons."""
    reported = F.col("total_tokens") > 0
    tokens = [("tokens", reported, {"model": F.col("model"), "kind": F.lit(k)}, F.col(f"{k}_tokens")) for k in ("prompt", "completion")]
    return [*tokens, ("finish_reasons", F.lit(True), {"model": F.col("model"), "mode": F.col("mode"), "reason": finish_reason(F.col("finish_reason"))}, F.lit(1))]


def dependency_series() -> list[Series]:
    """Of a log(dependency, operation, ok, results): calls by outcome, retrievals also by whether they found anything."""
    labels = {"dependency": F.col("dependency"), "operation": F.col("operation")}
    searched = (F.col("dependency") == "retrieval") & F.col("ok")
    return [
        ("calls", F.lit(True), labels | {"outcome": F.when(F.col("ok"), "ok").otherwise("error")}, F.lit(1)),
        ("calls", searched, labels | {"outcome": F.when(F.col("results") == 0, "empty").otherwise("found")}, F.lit(1)),
    ]


def cart_series() -> list[Series]:
    return [("cart_stages", F.lit(True), {"kind": F.col("kind"), "stage": F.col("stage")}, F.lit(1))]
