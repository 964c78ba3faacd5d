"""Queries over conversations: history, expiry, redaction, request checks, reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.privacy import redact
from lorekeep.operators import conversations as cv
from lorekeep.plans.catalog import query, table

BASE = "timestamp '2024-01-01 00:00:00'"


def turns(spark, d) -> DataFrame:
    """Turn t of a conversation comes 10 t² minutes after its start, so later pauses grow longer."""
    at = F.expr(f"{BASE} + make_dt_interval(0, conv_id, 10 * turn * turn)")
    return table(spark, d, "conversations").select(
        F.lit("main").alias("site_id"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), at.alias("at")
    )


def raw_turns(spark, d) -> DataFrame:
    t = turns(spark, d)
    good = F.to_json(F.struct("role", "content", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))
    number = F.to_json(F.struct("role", F.col("seq").alias("content"), F.lit("x").alias("at")))
    return t.select(
        "conversation_id",
        "seq",
        F.when(F.col("role") == "system", good).when(F.col("seq") == 1, number).when(F.col("seq") == 5, F.lit("{broken")).otherwise(good).alias("raw"),
    )


@query(
    "cv1_decode_turns",
    "SELECT conv_id AS conversation_id, turn AS seq, role, md5(text) AS content FROM conversations WHERE role <> 'system' AND turn NOT IN (1, 5)",
)
def cv1(spark, d):
    return cv.decode_turns(raw_turns(spark, d))[0].select("conversation_id", "seq", "role", F.md5("content").alias("content"))


@query("cv1_rejected_turns", "SELECT count(*) AS rejected FROM conversations WHERE role = 'system' OR turn IN (1, 5)")
def cv1_rejects(spark, d):
    return cv.decode_turns(raw_turns(spark, d))[1].agg(F.count("*").alias("rejected"))


LAST = """l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)"""


@query(
    "cv2_history",
    f"WITH {LAST} SELECT conv_id AS conversation_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM l WHERE age <= 4",
)
def cv2(spark, d):
    return cv.history(turns(spark, d), 4).select("conversation_id", "seq", F.col("position").cast("long").alias("position"))


@query("cv2_decoded_history", f"WITH {LAST} SELECT conv_id AS conversation_id, turn AS seq FROM l WHERE age <= 4 AND role <> 'system'")
def cv2_decoded(spark, d):
    return cv.decoded_history(turns(spark, d), 4).select("conversation_id", "seq")


@query("cv3_retain", f"WITH {LAST} SELECT conv_id AS conversation_id, turn AS seq, md5(text) AS content FROM l WHERE age <= 3")
def cv3(spark, d):
    return cv.retain(turns(spark, d), 3).select("conversation_id", "seq", F.md5("content").alias("content"))


TIMED = f"""t AS (SELECT conv_id, turn, {BASE} + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(10 * turn * turn AS BIGINT)) AS ts FROM conversations),
  g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) > INTERVAL 60 MINUTE AS gap FROM t),
  i AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY conv_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


@query(
    "cv4_live_history",
    f"WITH {TIMED} SELECT conv_id AS conversation_id, turn AS seq FROM i WHERE island = (SELECT max(island) FROM i j WHERE j.conv_id = i.conv_id)",
)
def cv4(spark, d):
    return cv.live_history(turns(spark, d), 3600).select("conversation_id", "seq")


@query("cv6_redact")
def cv6(spark, d):
    """Every whole document without e-mails, card and phone numbers."""
    cleaned = table(spark, d, "documents").select("doc_id", redact("text").alias("r"))
    return cleaned.select("doc_id", F.md5("r.text").alias("text"), F.array_join("r.removed", "|").alias("removed"))


PLANTED = """p AS (SELECT conv_id, turn, role, regexp_replace(text, '[0-9@+]', '', 'g') AS said, CASE WHEN role = 'user' THEN 'email' WHEN turn % 4 = 1 THEN 'payment card' WHEN turn % 4 = 3 THEN 'phone number' END AS kind FROM conversations)"""


def planted_turns(spark, d) -> DataFrame:
    """Whole turns without digits, at signs and plus signs, each with one thing to remove behind it, or with a number that is none."""
    kept = F.regexp_replace("text", "[0-9@+]", "")
    tail = (
        F.when(F.col("role") == "user", F.lit(" write to jo.doe+x@mail.example.org now"))
        .when(F.col("turn") % 4 == 1, F.lit(" card 4111 1111 1111 1111 ok"))
        .when(F.col("turn") % 4 == 3, F.lit(" call +49 170 1234567 ok"))
        .otherwise(F.lit(" see https://a.example/x@y.org and 4111 1111 1111 1112 ok"))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(kept, tail).alias("content"))


@query(
    "cv6_redact_planted",
    f"""WITH {PLANTED} SELECT conv_id, turn, coalesce(kind, '') AS removed, md5(said || CASE kind WHEN 'email' THEN ' write to [removed] now' WHEN 'payment card' THEN ' card [removed] ok'
        WHEN 'phone number' THEN ' call [removed] ok' ELSE ' see https://a.example/x@y.org and 4111 1111 1111 1112 ok' END) AS text FROM p""",
)
def cv6_planted(spark, d):
    cleaned = planted_turns(spark, d).withColumn("r", redact("content"))
    return cleaned.select("conv_id", "turn", F.array_join("r.removed", "|").alias("removed"), F.md5("r.text").alias("text"))


@query("cv7_redact_planted", f"WITH {PLANTED} SELECT role, kind AS category, count(*) AS turns FROM p WHERE kind IS NOT NULL GROUP BY ALL")
def cv7_planted(spark, d):
    return cv.redaction_counts(cv.redact_turns(planted_turns(spark, d)), ["role"])


@query("cv7_redact_turns")
def cv7(spark, d):
    """Conversations and documents as turns, counted by category."""
    said = turns(spark, d).select("role", "content")
    read = table(spark, d, "documents").select(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    return cv.redaction_counts(cv.redact_turns(said.unionByName(read)), ["role"])


@query(
    "cv8_assemble_messages",
    f"""WITH {LAST}, k AS (SELECT conv_id, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS past FROM l WHERE age <= 3 AND role <> 'system' GROUP BY conv_id)
        SELECT conv_id AS conversation_id, 'system:' || md5('Be kind.') || coalesce(',' || past, '') || ',user:' || md5('And now ' || conv_id || '?') AS messages
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN k USING (conv_id)""",
)
def cv8(spark, d):
    t = turns(spark, d)
    asked = t.select("site_id", "conversation_id").distinct().withColumn("question", F.concat(F.lit("And now "), "conversation_id", F.lit("?")))
    built = cv.assemble_messages(t, asked, F.lit("Be kind."), 3)
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"])))
    return built.select("conversation_id", F.array_join(line, ",").alias("messages"))


def stream_events(spark, d) -> DataFrame:
    """Stream events of every assistant turn: start, a tool call, one delta per word, and done unless it ran too long."""
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    pieces = F.split("text", " ")
    deltas = F.transform(
        pieces,
        lambda w, i: F.struct(
            F.lit("delta").alias("type"), (i + 3).cast("long").alias("seq"), F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)).alias("text"), F.lit(None).cast("string").alias("phase")
        ),
    )

    def event(kind: str, seq, phase: str | None = None):
        return F.struct(F.lit(kind).alias("type"), seq.cast("long").alias("seq"), F.lit("").alias("text"), F.lit(phase).cast("string").alias("phase"))

    head = F.array(event("start", F.lit(0)), event("tool", F.lit(1), "started"), event("tool", F.lit(2), "finished"))
    tail = F.when(F.length("text") < 1500, F.array(event("done", F.size(pieces) + 3))).otherwise(F.slice(head, 1, 0))
    rows = said.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("turn_id"),
        F.expr(f"{BASE} + make_dt_interval(0, conv_id, turn)").alias("begun"),
        F.explode(F.concat(head, deltas, tail)).alias("e"),
    )
    return rows.select(
        "turn_id", "e.type", "e.seq", "e.text", "e.phase", F.lit("searchKnowledge").alias("tool"), F.expr("begun + make_dt_interval(0, 0, 0, e.seq * 0.1)").alias("at")
    )


SAID = "a AS (SELECT conv_id || '-' || turn AS turn_id, text, len(string_split(text, ' ')) AS words FROM conversations WHERE role = 'assistant')"


@query("cv9_persist_gate", f"WITH {SAID} SELECT turn_id FROM a WHERE length(text) < 1500")
def cv9(spark, d):
    events = stream_events(spark, d)
    return cv.persist_gate(events.filter("type = 'start'").select("turn_id"), events)


@query("cv10_reassemble_answers", f"WITH {SAID} SELECT turn_id, md5(text) AS answer FROM a WHERE text <> ''")
def cv10(spark, d):
    return cv.reassemble_answers(stream_events(spark, d)).select("turn_id", F.md5("answer").alias("answer"))


def requests(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    name = F.when(F.col("turn") == 3, F.concat(F.lit("bad id "), "conv_id")).when(F.col("turn") > 0, F.concat(F.lit("c-"), "conv_id"))
    fields = F.map_filter(
        F.create_map(
            F.lit("conversationId"), name,
            F.lit("message"), F.when(F.col("turn") == 2, F.lit(" \n")).otherwise(F.concat(F.lit("  "), "text")),
            F.lit("debug"), F.when(F.col("role") == "system", "1"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return c.select("conv_id", "turn", fields.alias("fields"))


CHECKED = """c AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'conversation id' WHEN turn = 2 THEN 'empty message'
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 800 THEN 'message too long' WHEN role = 'system' THEN 'unknown field' END AS reason FROM conversations)"""


@query("cv11_accepted_requests", f"WITH {CHECKED} SELECT conv_id, turn FROM c WHERE reason IS NULL")
def cv11(spark, d):
    return cv.valid_requests(requests(spark, d), 800)[0].select("conv_id", "turn")


@query("cv11_rejected_requests", f"WITH {CHECKED} SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason")
def cv11_rejects(spark, d):
    return cv.valid_requests(requests(spark, d), 800)[1].groupBy("reason").agg(F.count("*").alias("n"))


def fragments(spark, d) -> DataFrame:
    """Tool calls cut into pieces of five characters; calls of system turns have no name, those of turn 4 no object."""
    c = table(spark, d, "conversations")
    body = F.when(F.col("turn") == 4, F.lit("[1, 2, 3]")).when(F.col("turn") == 5, F.lit("")).otherwise(
        F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "role": "'), "role", F.lit('"}'))
    )
    rows = c.select("conv_id", "turn", "role", F.posexplode_outer(F.regexp_extract_all(body, F.lit("(?s).{1,5}"), F.lit(0))).alias("seq", "piece"))
    first = F.coalesce("seq", F.lit(0)) == 0
    return rows.select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("index"),
        F.coalesce("seq", F.lit(0)).alias("seq"),
        F.when(first & (F.col("turn") != 0), F.concat(F.lit("id-"), F.col("turn").cast("string"))).otherwise("").alias("id"),
        F.when(first & (F.col("role") != "system"), F.lit("search")).alias("name"),
        F.col("piece").alias("arguments"),
    )


CALLS = """k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
  CASE WHEN turn = 4 THEN '[1, 2, 3]' WHEN turn = 5 THEN '{}' ELSE '{"turn": ' || turn || ', "role": "' || role || '"}' END AS arguments FROM conversations)"""


@query(
    "cv12_tool_calls",
    f"""WITH {CALLS} SELECT conv_id AS call_id, turn AS index, CASE WHEN turn = 0 THEN 'call_' || place ELSE 'id-' || turn END AS id, 'search' AS name, arguments
        FROM k WHERE role <> 'system' AND turn <> 4""",
)
def cv12(spark, d):
    return cv.reassemble_tool_calls(fragments(spark, d))[0].select("call_id", "index", "id", "name", "arguments")


@query(
    "cv12_rejected_calls",
    f"WITH {CALLS} SELECT CASE WHEN role = 'system' THEN 'no name' ELSE 'bad arguments' END AS reason, count(*) AS n FROM k WHERE role = 'system' OR turn = 4 GROUP BY 1",
)
def cv12_rejects(spark, d):
    return cv.reassemble_tool_calls(fragments(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))
