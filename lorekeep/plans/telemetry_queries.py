"""Queries over the event log: counters, histograms, rates, admission replay and the metrics page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.privacy import redact_flat, redact_keys
from lorekeep.functions.text import mask_secrets
from lorekeep.operators import admission, telemetry
from lorekeep.plans.catalog import query, table
from lorekeep.plans.conversation_queries import SAID, stream_events
from lorekeep.settings import LATENCY_BOUNDS_MS, TOKEN_BOUNDS
from lorekeep.sources import sinks

def kind() -> Column:
    return F.col("event_type")


def events(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("k", k)


K = "CAST(json_extract_string(props, '$.k') AS INT)"


def le_sql(value: str, bounds) -> str:
    parts = [f"count(*) FILTER ({value} <= {b}) AS le_{b}" for b in sorted(bounds)]
    return f"count(*) AS count, round(sum({value}), 2) AS sum, {', '.join(parts)}, count(*) AS le_inf"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", F.round(F.col("sum").cast("double"), 2))


@query("tm1_counter", "SELECT event_type, 'kb' AS app, count(*) AS count FROM events GROUP BY event_type")
def tm1(spark, d):
    return telemetry.counter(events(spark, d), ["event_type"], constant={"app": "kb"})


@query("tm1_counter_by_amount", f"SELECT event_type, user_id, sum({K}) AS count FROM events GROUP BY ALL")
def tm1_amount(spark, d):
    return telemetry.counter(events(spark, d), ["event_type", "user_id"], F.col("k"))


@query("tm2_histogram", f"SELECT event_type, {le_sql('value', (1, 5, 10, 50))} FROM events GROUP BY event_type")
def tm2(spark, d):
    return rounded(telemetry.histogram(events(spark, d), F.col("value"), (50, 1, 5, 10), ["event_type"]))


def http_log(spark, d, *keep: str) -> DataFrame:
    path = (
        F.when(kind() == "view", "/v1/chat").when(kind() == "click", "/v1/chat/stream").when(kind() == "purchase", "/v1/cart/confirm")
        .otherwise(F.concat(F.lit("/x/"), "event_id"))
    )
    status = F.when((kind() == "error") & (F.col("value") < 5), 429).when(kind() == "error", 503).when((kind() == "signup") & (F.col("k") < 50), 401).otherwise(200)
    return events(spark, d).select(
        *keep, path.alias("path"), F.when(kind() == "view", "GET").otherwise("POST").alias("method"), status.alias("status"), (F.col("value") * 100).alias("duration_ms"), "event_id"
    )


LOG = f"""lg AS (SELECT event_id, CASE event_type WHEN 'view' THEN '/v1/chat' WHEN 'click' THEN '/v1/chat/stream' WHEN 'purchase' THEN '/v1/cart/confirm' ELSE 'other' END AS route,
  CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN event_type = 'error' AND value < 5 THEN 429 WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' AND {K} < 50 THEN 401 ELSE 200 END AS status,
  value * 100 AS duration_ms FROM events)"""


@query("tm3_route_fold", f"WITH {LOG} SELECT event_id, route FROM lg")
def tm3(spark, d):
    return http_log(spark, d).select("event_id", telemetry.route_fold(F.col("path")).alias("route"))


@query("tm4_http_requests", f"WITH {LOG} SELECT route, method, status, count(*) AS count FROM lg GROUP BY ALL")
def tm4(spark, d):
    return telemetry.http_metrics(http_log(spark, d))[0]


@query("tm4_http_duration", f"WITH {LOG} SELECT route, method, {le_sql('duration_ms', LATENCY_BOUNDS_MS)} FROM lg GROUP BY ALL")
def tm4_duration(spark, d):
    return rounded(telemetry.http_metrics(http_log(spark, d))[1])


@query(
    "tm4_http_rejections",
    f"WITH {LOG} SELECT CASE status WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'at_capacity' ELSE 'unauthenticated' END AS reason, count(*) AS count FROM lg WHERE status <> 200 GROUP BY 1",
)
def tm4_rejections(spark, d):
    return telemetry.http_metrics(http_log(spark, d))[2]


NO_ANSWER = "I do not know."


def turn_log(spark, d) -> DataFrame:
    size = F.length("text")
    return table(spark, d, "conversations").select(
        F.when(F.col("role") == "user", "buffered").otherwise("streamed").alias("mode"),
        F.when(F.col("turn") == 3, NO_ANSWER).otherwise(F.col("text")).alias("answer"),
        (size > 500).alias("grounded"),
        (size < 1500).alias("completed"),
        (size * 10).cast("double").alias("duration_ms"),
        F.least("turn", F.lit(3)).cast("int").alias("rounds"),
        F.when(size > 500, 2).otherwise(0).alias("sources"),
        F.col("turn").alias("history_turns"),
        (size < 1500).alias("persisted"),
    )


TURNS = """tl AS (SELECT CASE WHEN role = 'user' THEN 'buffered' ELSE 'streamed' END AS mode, turn, length(text) AS size FROM conversations)"""


@query(
    "tm5_turn_outcomes",
    f"""WITH {TURNS} SELECT mode, CASE WHEN size >= 1500 THEN CASE WHEN mode = 'streamed' THEN 'abandoned' ELSE 'failed' END
        WHEN turn = 3 THEN 'no_answer' WHEN size > 500 THEN 'grounded' ELSE 'ungrounded' END AS outcome, count(*) AS count FROM tl GROUP BY ALL""",
)
def tm5(spark, d):
    return telemetry.turn_outcomes(turn_log(spark, d), NO_ANSWER)[0]


@query("tm5_turn_durations", f"WITH {TURNS} SELECT mode, {le_sql('size * 10.0', LATENCY_BOUNDS_MS)} FROM tl GROUP BY mode")
def tm5_durations(spark, d):
    return rounded(telemetry.turn_outcomes(turn_log(spark, d), NO_ANSWER)[1])


@query("tm6_time_to_first_token", f"WITH {SAID} SELECT turn_id, 300 AS first_token_ms FROM a")
def tm6(spark, d):
    return telemetry.time_to_first_token(stream_events(spark, d))


@query("tm7_abandoned", f"WITH {SAID} SELECT turn_id, words + 3 AS events FROM a WHERE length(text) >= 1500")
def tm7(spark, d):
    return telemetry.abandoned(stream_events(spark, d))


@query("tm8_tool_rounds", f"WITH {SAID} SELECT 'searchKnowledge' AS tool, unnest(['started', 'finished']) AS phase, count(*) AS count FROM a")
def tm8(spark, d):
    return telemetry.tool_rounds(stream_events(spark, d))


def calls(spark, d, *keep: str) -> DataFrame:
    """One model call per event; what it reports depends on the kind of event."""
    number = F.col("value").cast("string")
    total = F.when(kind() == "view", F.concat(F.lit(',"total_tokens":'), (F.col("k") + 100).cast("string"))).when(kind() == "click", ',"total_tokens":"7"').otherwise("")
    usage = F.concat(F.lit('{"prompt_tokens":'), F.col("k").cast("string"), F.lit(',"completion_tokens":'), number, total, F.lit("}"))
    return events(spark, d).select(
        *keep, kind().alias("model"), F.when(kind() == "error", F.lit(None)).when(kind() == "signup", '{"prompt_tokens":-5}').otherwise(usage).alias("usage"),
        F.when(F.col("k") < 20, "stop").when(F.col("k") < 40, "function_call").when(F.col("k") < 60, "length").when(F.col("k") < 80, "toString").alias("finish_reason"),
        F.when(F.col("k") > 50, "stream").otherwise("generate").alias("mode"),
    )


USAGE = f"""us AS (SELECT event_type AS model, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE {K} END AS p,
  CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE CAST(floor(value + 0.5) AS BIGINT) END AS c, CASE WHEN event_type = 'view' THEN {K} + 100 ELSE 0 END AS r FROM events),
  ut AS (SELECT *, CASE WHEN r > 0 THEN r ELSE p + c END AS t FROM us)"""


@query(
    "tm9_token_usage",
    f"WITH {USAGE} SELECT model, 'prompt' AS kind, sum(p) AS count FROM ut WHERE t > 0 GROUP BY model UNION ALL SELECT model, 'completion', sum(c) FROM ut WHERE t > 0 GROUP BY model",
)
def tm9(spark, d):
    return telemetry.token_usage(telemetry.parsed_usage(calls(spark, d)))[0]


@query("tm9_tokens_per_call", f"WITH {USAGE} SELECT model, {le_sql('t', TOKEN_BOUNDS)} FROM ut WHERE t > 0 GROUP BY model")
def tm9_per_call(spark, d):
    return rounded(telemetry.token_usage(telemetry.parsed_usage(calls(spark, d)))[1])


def dependency_log(spark, d, *keep: str) -> DataFrame:
    return events(spark, d).select(
        *keep, F.when(kind().isin("view", "error"), "retrieval").otherwise("llm").alias("dependency"),
        F.when(kind().isin("view", "error"), "retrieve").otherwise(kind()).alias("operation"),
        (kind() != "error").alias("ok"), F.when(F.col("k") < 10, 0).otherwise(F.col("k")).alias("results"), (F.col("value") * 50).alias("duration_ms"),
    )


DEPS = f"""dl AS (SELECT CASE WHEN event_type IN ('view', 'error') THEN 'retrieval' ELSE 'llm' END AS dependency,
  CASE WHEN event_type IN ('view', 'error') THEN 'retrieve' ELSE event_type END AS operation, event_type <> 'error' AS ok, {K} AS k, value * 50 AS duration_ms FROM events)"""


@query(
    "tm10_dependency_calls",
    f"""WITH {DEPS} SELECT dependency, operation, CASE WHEN ok THEN 'ok' ELSE 'error' END AS outcome, count(*) AS count FROM dl GROUP BY ALL
        UNION ALL SELECT dependency, operation, CASE WHEN k < 10 THEN 'empty' ELSE 'found' END, count(*) FROM dl WHERE dependency = 'retrieval' AND ok GROUP BY ALL""",
)
def tm10(spark, d):
    return telemetry.dependency_calls(dependency_log(spark, d))[0]


@query("tm10_dependency_duration", f"WITH {DEPS} SELECT dependency, operation, {le_sql('duration_ms', LATENCY_BOUNDS_MS)} FROM dl GROUP BY ALL")
def tm10_duration(spark, d):
    return rounded(telemetry.dependency_calls(dependency_log(spark, d))[1])


@query(
    "tm11_cart_stages",
    "SELECT CASE WHEN value > 20 THEN 'applyCoupon' ELSE 'addToCart' END AS kind, CASE event_type WHEN 'view' THEN 'prepared' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'rejected' ELSE 'gone' END AS stage, count(*) AS count FROM events GROUP BY ALL",
)
def tm11(spark, d):
    return telemetry.cart_stages(cart_log(spark, d))


def cart_log(spark, d, *keep: str) -> DataFrame:
    stage = F.when(kind() == "view", "prepared").when(kind() == "purchase", "applied").when(kind() == "error", "rejected").otherwise("gone")
    return events(spark, d).select(*keep, F.when(F.col("value") > 20, "applyCoupon").otherwise("addToCart").alias("kind"), stage.alias("stage"))


DAY = 86_400_000


def client_requests(spark, d) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "at")


@query(
    "tm12_rate_limit",
    f"""WITH RECURSIVE q AS (SELECT user_id AS client, event_id AS request_id, (epoch_us(ts) // 1000) * 2 AS u, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
        b(client, rn, request_id, debt, state) AS (SELECT DISTINCT client, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM q UNION ALL
          SELECT q.client, q.rn, q.request_id, greatest(0, b.state - q.u), CASE WHEN greatest(0, b.state - q.u) <= {DAY} THEN q.u + greatest(0, b.state - q.u) + {DAY} ELSE b.state END
          FROM b JOIN q ON q.client = b.client AND q.rn = b.rn + 1)
        SELECT client, request_id, debt <= {DAY} AS allowed, (2 * {DAY} - debt - CASE WHEN debt <= {DAY} THEN {DAY} ELSE 0 END) // {DAY} AS remaining,
          CAST(ceil(debt / 2000) AS BIGINT) AS reset_seconds, CAST(greatest(1, ceil((debt - {DAY}) / 2000)) AS BIGINT) AS retry_after_seconds FROM b WHERE rn > 0""",
)
def tm12(spark, d):
    """Two requests a day per client."""
    return admission.token_bucket(client_requests(spark, d), DAY, 2, 6 * admission.HOUR_MS)


def intervals(spark, d) -> DataFrame:
    """A request lasts its value in minutes, in whole milliseconds."""
    started = F.timestamp_millis(F.unix_millis("at"))
    return events(spark, d).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), kind().alias("kind"), started.alias("started"),
        F.timestamp_millis(F.unix_millis("at") + F.round(F.col("value") * 60000).cast("long") + 1).alias("ended"),
    )


EDGES = """e AS (SELECT event_type, (epoch_us(ts) // 1000) AS t, 1 AS c FROM events UNION ALL SELECT event_type, (epoch_us(ts) // 1000) + CAST(round(value * 60000) AS BIGINT) + 1, -1 FROM events)"""


@query("tm13_high_water", f"WITH {EDGES} SELECT max(n) AS high_water FROM (SELECT sum(c) OVER (ORDER BY t, c ROWS UNBOUNDED PRECEDING) AS n FROM e)")
def tm13(spark, d):
    return admission.high_water(intervals(spark, d))


@query(
    "tm13_high_water_by_kind",
    f"WITH {EDGES} SELECT event_type AS kind, max(n) AS high_water FROM (SELECT event_type, sum(c) OVER (PARTITION BY event_type ORDER BY t, c ROWS UNBOUNDED PRECEDING) AS n FROM e) GROUP BY 1",
)
def tm13_by_kind(spark, d):
    return admission.high_water(intervals(spark, d), ["kind"])


@query(
    "tm14_redact_keys",
    f"""SELECT event_id, '{{"user":' || user_id || ',"apiKey":"[redacted]","nested":[{{"session_id":"[redacted]","tokens":' || {K} || '}}]}}' AS redacted FROM events""",
)
def tm14(spark, d):
    raw = F.concat(
        F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "apiKey": {"a": 1}, "nested": [{"session_id": "s", "tokens": '), F.col("k").cast("string"), F.lit("}]}")
    )
    return events(spark, d).select("event_id", redact_keys(raw).alias("redacted"))


@query("tm14_redact_plain", "SELECT doc_id, md5(text) AS redacted FROM documents")
def tm14_plain(spark, d):
    """Log values that are no JSON pass through."""
    return table(spark, d, "documents").select("doc_id", F.md5(redact_keys("text")).alias("redacted"))


@query("tm14_redact_flat", "SELECT event_id, 'kind=' || event_type || '|password=[redacted]' AS redacted FROM events")
def tm14_flat(spark, d):
    masked = redact_flat(F.create_map(F.lit("kind"), kind(), F.lit("password"), F.col("user_id").cast("string")))
    pairs = F.transform(F.array_sort(F.map_entries(masked)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return events(spark, d).select("event_id", F.array_join(pairs, "|").alias("redacted"))


@query(
    "tm15_mask_secrets",
    r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace('key [redacted] and [redacted] ' || text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
        s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b(?:sk|pk|rk)[_-][A-Za-z0-9_-]{8,}', '[redacted]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._-]{8,}', '[redacted]', 'g') AS t FROM m)
        SELECT doc_id, md5(CASE WHEN length(t) > 500 THEN t[1:500] || '…' ELSE t END) AS text FROM s""",
)
def tm15(spark, d):
    text = F.concat(F.lit("key sk_live_1234567890 \n and BEARER abc.def-123456 "), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(mask_secrets(text)).alias("text"))


@query(
    "tm16_label_cardinality",
    "SELECT 'requests' AS name, 'kind' AS label, count(DISTINCT event_type) AS \"values\", false AS too_many FROM events UNION ALL SELECT 'requests', 'hour', count(DISTINCT hour(ts)), count(DISTINCT hour(ts)) > 10 FROM events",
)
def tm16(spark, d):
    rows = events(spark, d).select(F.lit("requests").alias("name"), F.create_map(F.lit("kind"), kind(), F.lit("hour"), F.hour("at").cast("string")).alias("labels"))
    return telemetry.label_cardinality(rows, 10)


@query(
    "tm17_turn_summary",
    f"""WITH {TURNS} SELECT mode, count(*) AS turns, round(avg(least(turn, 3)), 4) AS mean_rounds, max(least(turn, 3)) AS max_rounds, round(avg((turn >= 3)::INT), 4) AS exhausted_share,
        round(avg(CASE WHEN size > 500 THEN 2 ELSE 0 END), 4) AS mean_sources, round(avg(turn), 4) AS mean_history, round(avg((size < 1500)::INT), 4) AS persisted_share,
        round(avg((size > 500)::INT), 4) AS grounded_rate FROM tl GROUP BY mode""",
)
def tm17(spark, d):
    return telemetry.turn_summary(turn_log(spark, d), ["mode"])


@query("tm18_usage_gap", f"WITH {USAGE} SELECT model, count(*) AS calls, count(*) FILTER (t > 0) AS reported, count(*) FILTER (t = 0) AS gap FROM ut GROUP BY model")
def tm18(spark, d):
    made = calls(spark, d)
    return telemetry.usage_gap(made, telemetry.parsed_usage(made))


@query(
    "tm19_finish_reasons",
    f"""SELECT event_type AS model, CASE WHEN {K} > 50 THEN 'stream' ELSE 'generate' END AS mode,
        CASE WHEN {K} < 20 THEN 'stop' WHEN {K} < 40 THEN 'tool_calls' WHEN {K} < 60 THEN 'length' ELSE 'unknown' END AS reason, count(*) AS count FROM events GROUP BY ALL""",
)
def tm19(spark, d):
    return telemetry.finish_reasons(calls(spark, d))


@query(
    "tm20_health_rollup",
    f"""SELECT event_type AS service, date_trunc('hour', ts) AS at, CASE WHEN bool_and({K} < 90) THEN 'ok' ELSE 'degraded' END AS status, count(*) AS checks FROM events GROUP BY ALL""",
)
def tm20(spark, d):
    probes = events(spark, d).select(kind().alias("service"), F.date_trunc("hour", "at").alias("at"), (F.col("k") < 90).alias("up"))
    return telemetry.health_rollup(probes)


@query(
    "tm21_latency_summary",
    f"""SELECT date_trunc('day', ts) AS window_start, event_type AS kind, count(*) AS requests, quantile_disc(value, 0.95) AS p95_ms, sum({K}) AS tokens,
        round(avg((value > 5)::INT), 4) AS grounded_rate FROM events GROUP BY ALL""",
)
def tm21(spark, d):
    log = events(spark, d).select("at", kind().alias("kind"), F.col("value").alias("duration_ms"), F.col("k").alias("tokens"), (F.col("value") > 5).alias("grounded"))
    return telemetry.latency_summary(log, "1 day", ["kind"])


@query(
    "snk3_render_exposition",
    """WITH h AS (SELECT event_type AS t, count(*) AS n, CAST(sum(value) AS DECIMAL(18, 3)) AS s, count(*) FILTER (value <= 1) AS a, count(*) FILTER (value <= 2.5) AS b FROM events GROUP BY 1),
       x AS (SELECT 'kb_wait_ms' AS name, '{app="k\\"b",kind="' || t || '"}' AS label_key, unnest([
          'kb_wait_ms_bucket{app="k\\"b",kind="' || t || '",le="1"} ' || a, 'kb_wait_ms_bucket{app="k\\"b",kind="' || t || '",le="2.5"} ' || b,
          'kb_wait_ms_bucket{app="k\\"b",kind="' || t || '",le="+Inf"} ' || n,
          'kb_wait_ms_sum{app="k\\"b",kind="' || t || '"} ' || regexp_replace(CAST(s AS VARCHAR), '\\.?0+$', ''),
          'kb_wait_ms_count{app="k\\"b",kind="' || t || '"} ' || n]) AS line, generate_subscripts([1,2,3,4,5], 1) AS part FROM h)
       SELECT name, label_key, part, line FROM x
       UNION ALL SELECT 'kb_events_total', '{kind="' || t || '"}', 1, 'kb_events_total{kind="' || t || '"} ' || n FROM h
       UNION ALL SELECT 'kb_events_total', '', -1, '# HELP kb_events_total Events by kind.' UNION ALL SELECT 'kb_events_total', '', 0, '# TYPE kb_events_total counter'
       UNION ALL SELECT 'kb_wait_ms', '', -1, '# HELP kb_wait_ms Time \\\\ spent.' UNION ALL SELECT 'kb_wait_ms', '', 0, '# TYPE kb_wait_ms histogram'""",
)
def snk3(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "kind").withColumn("app", F.lit('k"b'))
    counts = telemetry.as_metrics(telemetry.counter(e, ["kind"]), "kb_events_total", "Events by kind.", ["kind"])
    bounds = (1, 2.5)
    waits = telemetry.histogram(e, F.col("value"), bounds, ["app", "kind"])
    metrics = telemetry.as_metrics(waits, "kb_wait_ms", "Time \\ spent.", ["kind", "app"], bounds)
    return sinks.render_exposition(counts.unionByName(metrics))
