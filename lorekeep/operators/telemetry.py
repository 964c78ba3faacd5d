"""Counters, histograms and rates over event tables. All of it aggregates partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.settings import LATENCY_BOUNDS_MS, MAX_TOOL_ROUNDS, TOKEN_BOUNDS

# Routes that get their own label.
ROUTES = (
    "/health",
    "/health/live",
    "/health/ready",
    "/health/info",
    "/metrics",
    "/v1/config",
    "/v1/chat",
    "/v1/chat/stream",
    "/v1/cart/confirm",
)
# Status codes that mean a refusal, and finish reasons as they are reported.
REJECTIONS = {429: "rate_limited", 503: "at_capacity", 401: "unauthenticated", 403: "forbidden"}
FINISH = {"stop": "stop", "length": "length", "tool_calls": "tool_calls", "function_call": "tool_calls", "content_filter": "content_filter"}


def _labels(labels: list[str], constant: dict[str, str] | None) -> list[Column]:
    return [F.col(c) for c in labels] + [F.lit(v).alias(k) for k, v in (constant or {}).items()]


def counter(events: DataFrame, labels: list[str], by: Column | None = None, constant: dict[str, str] | None = None) -> DataFrame:
    """Sum per label set. ``constant`` labels are added to each series."""
    amount = F.lit(1).cast("long") if by is None else by
    return events.groupBy(*_labels(labels, constant)).agg(F.sum(amount).alias("count"))


def bucket_name(bound: float) -> str:
    return f"le_{bound}".replace(".", "_")


def histogram(events: DataFrame, value: Column, bounds: tuple, labels: list[str], constant: dict[str, str] | None = None) -> DataFrame:
    """count, sum and one cumulative column ``le_<bound>`` per bound and label set; ``le_inf`` equals count."""
    buckets = [F.count_if(value <= b).alias(bucket_name(b)) for b in sorted(bounds)]
    return events.groupBy(*_labels(labels, constant)).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"), *buckets, F.count(value).alias("le_inf")
    )


def as_metrics(df: DataFrame, name: str, help_text: str, labels: list[str], bounds: tuple | None = None) -> DataFrame:
    """Counter or histogram rows in the long form that the exposition writer takes."""
    pairs = [part for c in labels for part in (F.lit(c), F.col(c).cast("string"))]
    label_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    is_histogram = bounds is not None
    limits = F.array(*[F.lit(float(b)) for b in sorted(bounds)]) if is_histogram else F.lit(None).cast("array<double>")
    cumulative = F.array(*[F.col(bucket_name(b)) for b in sorted(bounds)]) if is_histogram else F.lit(None).cast("array<long>")
    return df.select(
        F.lit(name).alias("name"),
        F.lit(help_text).alias("help"),
        F.lit("histogram" if is_histogram else "counter").alias("type"),
        label_map.alias("labels"),
        F.col("count").cast("long").alias("count"),
        (F.col("sum") if is_histogram else F.col("count")).cast("double").alias("sum"),
        limits.alias("bounds"),
        cumulative.alias("cumulative"),
    )


def route_fold(path: Column) -> Column:
    """Known routes as they are, everything else ``other``, so that labels stay few."""
    return F.when(path.isin(*ROUTES), path).otherwise("other")


def http_metrics(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, durations, rejections) from log(path, method, status, duration_ms)."""
    folded = log.withColumn("route", route_fold(F.col("path")))
    requests = counter(folded, ["route", "method", "status"])
    durations = histogram(folded, F.col("duration_ms"), LATENCY_BOUNDS_MS, ["route", "method"])
    names = F.create_map(*[F.lit(x) for pair in REJECTIONS.items() for x in pair])
    reasons = folded.withColumn("reason", F.try_element_at(names, F.col("status").cast("int")))
    return requests, durations, counter(reasons.filter(F.col("reason").isNotNull()), ["reason"])


def turn_outcome(mode: Column, answer: Column, grounded: Column, completed: Column, no_answer: str) -> Column:
    """A stream without ``done`` was abandoned, errors included; only a buffered turn can have failed."""
    ended = F.when(mode == "streamed", "abandoned").otherwise("failed")
    said = F.when(answer == no_answer, "no_answer").when(grounded, "grounded").otherwise("ungrounded")
    return F.when(completed, said).otherwise(ended)


def turn_outcomes(turns: DataFrame, no_answer: str) -> tuple[DataFrame, DataFrame]:
    """(turns by mode and outcome, duration histogram by mode)."""
    outcome = turn_outcome(F.col("mode"), F.col("answer"), F.col("grounded"), F.col("completed"), no_answer)
    marked = turns.withColumn("outcome", outcome)
    return counter(marked, ["mode", "outcome"]), histogram(marked, F.col("duration_ms"), LATENCY_BOUNDS_MS, ["mode"])


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def time_to_first_token(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """First delta minus start per streamed turn, in ms; turns without a delta have no row."""
    first = F.min(F.when(F.col("type") == "delta", _ms(F.col("at"))))
    start = F.min(F.when(F.col("type") == "start", _ms(F.col("at"))))
    return events.groupBy(key).agg((first - start).alias("first_token_ms")).filter(F.col("first_token_ms").isNotNull())


def abandoned(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """Turns that never reached ``done``; one aggregation instead of a self anti-join."""
    return (
        events.groupBy(key)
        .agg(F.bool_or(F.col("type") == "done").alias("_done"), F.count("*").alias("events"))
        .filter(~F.col("_done"))
        .drop("_done")
    )


def tool_rounds(events: DataFrame) -> DataFrame:
    return counter(events.filter(F.col("type") == "tool"), ["tool", "phase"])


def usage_count(value: Column) -> Column:
    """A positive finite count, rounded; anything else is 0. Halves round up."""
    number = value.cast("double")
    good = ~F.isnan(number) & (number > 0) & (number < float("inf"))
    return F.coalesce(F.when(good, F.floor(number + 0.5)), F.lit(0)).cast("long")


def parsed_usage(calls: DataFrame, column: str = "usage") -> DataFrame:
    """Adds prompt_tokens, completion_tokens and total_tokens from a usage JSON text."""
    value = F.try_parse_json(column)

    def number(name: str) -> Column:
        found = F.try_variant_get(value, f"$.{name}", "variant")
        numeric = F.schema_of_variant(found).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return usage_count(F.when(numeric, F.try_variant_get(found, "$", "double")))

    prompt, completion, reported = number("prompt_tokens"), number("completion_tokens"), number("total_tokens")
    return calls.withColumns(
        {
            "prompt_tokens": prompt,
            "completion_tokens": completion,
            "total_tokens": F.when(reported > 0, reported).otherwise(prompt + completion),
        }
    )


def token_usage(usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens by model and kind, histogram of total tokens by model); calls that reported nothing are left out."""
    counted = usage.filter(F.col("total_tokens") > 0)
    kinds = F.explode(F.create_map(F.lit("prompt"), F.col("prompt_tokens"), F.lit("completion"), F.col("completion_tokens"))).alias("kind", "tokens")
    by_kind = counter(counted.select("model", kinds), ["model", "kind"], F.col("tokens"))
    return by_kind, histogram(counted, F.col("total_tokens"), TOKEN_BOUNDS, ["model"])


def dependency_calls(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls by dependency, operation, outcome; duration histogram). Retrieval also counts empty / found.

    ``log``: dependency, operation, ok, results, duration_ms.
    """
    outcome = F.when(F.col("ok"), "ok").otherwise("error")
    extra = F.when(
        (F.col("dependency") == "retrieval") & F.col("ok"), F.when(F.col("results") == 0, "empty").otherwise("found")
    )
    outcomes = F.filter(F.array(outcome, extra), lambda o: o.isNotNull())
    calls = counter(log.withColumn("outcome", F.explode(outcomes)), ["dependency", "operation", "outcome"])
    return calls, histogram(log, F.col("duration_ms"), LATENCY_BOUNDS_MS, ["dependency", "operation"])


def cart_stages(events: DataFrame) -> DataFrame:
    return counter(events, ["kind", "stage"])


def label_cardinality(metrics: DataFrame, limit: int = 100) -> DataFrame:
    """Distinct values per metric label and whether there are too many for a label."""
    return (
        metrics.select("name", F.explode("labels").alias("label", "value"))
        .groupBy("name", "label")
        .agg(F.approx_count_distinct("value", 0.01).alias("values"))
        .withColumn("too_many", F.col("values") > limit)
    )


def turn_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rounds used, exhausted share, sources, history, persisted and grounded rate; ``log`` has one row per turn."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return log.groupBy(*(by or [])).agg(
        F.count("*").alias("turns"),
        F.round(F.avg("rounds"), 4).alias("mean_rounds"),
        F.max("rounds").alias("max_rounds"),
        share(F.col("rounds") >= MAX_TOOL_ROUNDS).alias("exhausted_share"),
        F.round(F.avg("sources"), 4).alias("mean_sources"),
        F.round(F.avg("history_turns"), 4).alias("mean_history"),
        share(F.col("persisted")).alias("persisted_share"),
        share(F.col("grounded")).alias("grounded_rate"),
    )


def usage_gap(calls: DataFrame, usage: DataFrame) -> DataFrame:
    """Calls per model that reported no tokens: model calls minus calls with usage."""
    made = counter(calls, ["model"]).withColumnRenamed("count", "calls")
    reported = counter(usage.filter(F.col("total_tokens") > 0), ["model"]).withColumnRenamed("count", "reported")
    return (
        made.join(reported, "model", "left")
        .withColumn("reported", F.coalesce("reported", F.lit(0).cast("long")))
        .withColumn("gap", F.col("calls") - F.col("reported"))
    )


def finish_reason(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FINISH.items() for x in pair])
    return F.coalesce(F.try_element_at(names, value), F.lit("unknown"))


def finish_reasons(calls: DataFrame) -> DataFrame:
    return counter(calls.withColumn("reason", finish_reason(F.col("finish_reason"))), ["model", "mode", "reason"])


def health_rollup(probes: DataFrame) -> DataFrame:
    """(service, at, check, up) -> ok only if every check is up."""
    return probes.groupBy("service", "at").agg(
        F.when(F.bool_and("up"), "ok").otherwise("degraded").alias("status"), F.count("*").alias("checks")
    )


def latency_summary(log: DataFrame, window: str, by: list[str], percentile: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """Requests, p95 latency, tokens spent and grounded rate per time window and label."""
    return (
        log.groupBy(F.window("at", window).alias("_w"), *by)
        .agg(
            F.count("*").alias("requests"),
            F.percentile_approx("duration_ms", percentile, accuracy).alias("p95_ms"),
            F.sum("tokens").alias("tokens"),
            F.round(F.avg(F.col("grounded").cast("double")), 4).alias("grounded_rate"),
        )
        .select(F.col("_w.start").alias("window_start"), *by, "requests", "p95_ms", "tokens", "grounded_rate")
    )
