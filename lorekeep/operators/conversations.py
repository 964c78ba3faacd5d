"""Conversation history, redaction, request checks and reassembly of streamed parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.privacy import redact
from lorekeep.functions.text import js_trim
from lorekeep.scale import previous_value

KEYS = ["site_id", "conversation_id"]
ROLES = ("user", "assistant")
BLOCK = 1024


def is_turn(role: Column, content: Column, at: Column) -> Column:
    return F.coalesce(role.isin(*ROLES) & content.isNotNull() & at.isNotNull(), F.lit(False))


def decode_turns(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(turns, rejects) from JSON text. Only the types of the fields matter, so the parse keeps them apart."""
    value = F.try_parse_json(column)

    def text(name: str) -> Column:
        found = F.try_variant_get(value, f"$.{name}", "string")
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        return F.when(kind == "STRING", found)

    parsed = raw.withColumns({"role": text("role"), "content": text("content"), "at": text("at")})
    good = is_turn(F.col("role"), F.col("content"), F.col("at"))
    return parsed.filter(good).drop(column), parsed.filter(~good).select(*raw.columns)


def history(turns: DataFrame, limit: int, keys: list[str] = KEYS) -> DataFrame:
    """The newest ``limit`` turns per conversation, numbered oldest first. Limits run before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    oldest = Window.partitionBy(*keys).orderBy("seq")
    return (
        turns.withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= limit)
        .drop("_age")
        .withColumn("position", F.row_number().over(oldest))
    )


def decoded_history(turns: DataFrame, limit: int, keys: list[str] = KEYS) -> DataFrame:
    """History as it is read back: the limit counts stored rows, then unusable ones are dropped."""
    return history(turns, limit, keys).filter(F.col("role").isin(*ROLES))


def retain(turns: DataFrame, max_stored: int, keys: list[str] = KEYS) -> DataFrame:
    """What the store keeps after a write: the newest ``max_stored`` rows."""
    return history(turns, max_stored, keys).drop("position")


def live_history(turns: DataFrame, idle_seconds: int, keys: list[str] = KEYS, now: Column | None = None) -> DataFrame:
    """Turns after the last gap longer than the idle time; with ``now``, an idle conversation is gone altogether.

    Gaps are found per (conversation, hour), so one very long conversation is spread over many tasks.
    """
    seconds = F.unix_micros("at")
    limit = idle_seconds * 1_000_000
    hour = F.floor(seconds / F.lit(3_600_000_000)).cast("long")
    marked = previous_value(turns.withColumn("_us", seconds), keys, hour, ["at", "seq"], "_us", "_before")
    starts = F.when(F.col("_us") - F.col("_before") > limit, F.struct("at", "seq"))
    cut = marked.groupBy(*keys).agg(F.max(starts).alias("_start"), F.max("_us").alias("_last"))
    if now is not None:
        cut = cut.filter(F.unix_micros(now) - F.col("_last") <= limit)
    return (
        turns.join(cut, keys)
        .filter(F.col("_start").isNull() | (F.struct("at", "seq") >= F.col("_start")))
        .drop("_start", "_last")
    )


def redact_turns(turns: DataFrame, column: str = "content") -> DataFrame:
    """Both roles cleaned before storage; adds ``removed``. Unchanged rows keep their text."""
    cleaned = redact(column)
    return turns.withColumn("_clean", cleaned).withColumn(column, F.col("_clean.text")).withColumn("removed", F.col("_clean.removed")).drop("_clean")


def redaction_counts(redacted: DataFrame, by: list[str]) -> DataFrame:
    """Rows per category; the values themselves are never reported."""
    return redacted.select(*by, F.explode("removed").alias("category")).groupBy(*by, "category").agg(F.count("*").alias("turns"))


def assemble_messages(turns: DataFrame, questions: DataFrame, system: Column, max_prompt: int, keys: list[str] = KEYS) -> DataFrame:
    """Prompt messages per conversation: system, the last ``max_prompt`` turns, the question."""
    kept = decoded_history(turns, max_prompt, keys)
    past = kept.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "role", "content"))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("_past")
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    empty = F.slice(F.array(message("user", F.lit(""))), 1, 0)
    return questions.join(past, keys, "left").select(
        *keys,
        F.concat(
            F.array(message("system", system)),
            F.coalesce("_past", empty),
            F.array(message("user", F.col("question"))),
        ).alias("messages"),
    )


def persist_gate(turns: DataFrame, events: DataFrame, key: str = "turn_id") -> DataFrame:
    """Only turns whose stream reached ``done`` are stored."""
    return turns.join(events.filter(F.col("type") == "done").select(key), key, "left_semi")


def joined_in_order(rows: DataFrame, keys: list[str], order: str, text: str, out: str) -> DataFrame:
    """Concatenate ``text`` by ``order`` per key in two steps, so a long stream is joined block by block."""
    block = F.floor(F.col(order) / BLOCK)
    part = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    blocks = (
        rows.select(*keys, order, text, block.alias("_block"))
        .groupBy(*keys, "_block")
        .agg(F.array_join(F.transform(part, lambda p: p["t"]), "").alias("_text"))
    )
    whole = F.array_sort(F.collect_list(F.struct("_block", "_text")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(whole, lambda p: p["_text"]), "").alias(out))


def reassemble_answers(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """Answer text per turn: all non-empty deltas in order, across rounds."""
    deltas = events.filter((F.col("type") == "delta") & (F.col("text") != ""))
    return joined_in_order(deltas, [key], "seq", "text", "answer")


REQUEST_REASONS = ("conversation id", "empty message", "message too long", "unknown field")


def marked_requests(raw: DataFrame, max_message: int, known: tuple[str, ...] = ("conversationId", "message")) -> DataFrame:
    """Rows with ``fields`` (map of field to text), with conversation_id, message and the ``reason`` of a rejection, else null."""
    conversation = F.try_element_at("fields", F.lit("conversationId"))
    message = js_trim(F.try_element_at("fields", F.lit("message")))
    extra = F.size(F.array_except(F.map_keys("fields"), F.array(*[F.lit(k) for k in known]))) > 0
    reason = (
        F.when(conversation.isNotNull() & ~conversation.rlike(r"^[A-Za-z0-9_-]{1,64}\z"), REQUEST_REASONS[0])
        .when(message.isNull() | (message == ""), REQUEST_REASONS[1])
        .when(F.length(message) > max_message, REQUEST_REASONS[2])
        .when(extra, REQUEST_REASONS[3])
    )
    return raw.withColumns({"conversation_id": conversation, "message": message, "reason": reason})


def valid_requests(raw: DataFrame, max_message: int, known: tuple[str, ...] = ("conversationId", "message")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    marked = marked_requests(raw, max_message, known)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def reassemble_tool_calls(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, rejects) from fragments (call_id, index, seq, id, name, arguments).

    The newest non-empty id and name count; argument texts are joined in order. A call without a name, or whose
    arguments are not a JSON object, is rejected; empty arguments are an empty object.
    """
    keys = ["call_id", "index"]
    rows = fragments.withColumn("index", F.coalesce("index", F.lit(0)))
    newest = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq")))
    heads = rows.groupBy(*keys).agg(newest("id").alias("id"), newest("name").alias("name"))
    texts = joined_in_order(rows.filter(F.col("arguments").isNotNull()), keys, "seq", "arguments", "arguments")
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("index")) - 1
    whole = heads.join(texts, keys, "left").withColumns(
        {
            "id": F.coalesce("id", F.concat(F.lit("call_"), place)),
            "arguments": F.when(F.coalesce("arguments", F.lit("")) == "", "{}").otherwise(F.col("arguments")),
        }
    )
    kind = F.schema_of_variant(F.try_parse_json("arguments"))
    reason = F.when(F.coalesce("name", F.lit("")) == "", "no name").when(
        ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)), "bad arguments"
    )
    marked = whole.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
