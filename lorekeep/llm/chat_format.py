"""Chat formatting whose output a deterministic parser turns back into the same turns.

Grammar of a formatted conversation, where neither ROLE nor TEXT holds a control string::

    conversation := turn*
    turn         := "<s>[INST]" ROLE "[/INST]" TEXT "</s>"

A control string inside a role or text is marked by a backslash behind its first character; one that has backslashes
there already gets one more, so unmarking is exact. Each turn is first rendered as it is and reparsed; where the parser
does not give the same role and text back, the turn is escaped and reparsed. A conversation whose whole output does not
parse back to its turns raises an error, so what is returned has made the round trip.

Only DataFrame functions are used: one shuffle by conversation, which carries the running offset and the assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
MARKABLE = r"([<\[])(\\*)(/?s>|/?INST\])"
MARKED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, MARKABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, "$1$2$3")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD_END), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Formatted text -> array of (role, text). A piece that breaks the grammar becomes a null element."""
    pieces = F.split(formatted, CLOSE)

    def turn(piece: Column) -> Column:
        role, body = F.regexp_extract(piece, TURN, 1), F.regexp_extract(piece, TURN, 2)
        sound = piece.rlike(TURN) & ~role.rlike(CONTROL) & ~body.rlike(CONTROL)
        return F.when(sound, F.struct(unescape(role).alias("role"), unescape(body).alias("text")))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def format_chats(turns: DataFrame, id_col: str = "conv_id", learn_role: str = "assistant") -> DataFrame:
    """Rows (conversation, turn, role, text) -> one formatted text per conversation.

    Returns the id, ``formatted``, ``turns`` (role, text as parsed back from it) and ``loss_spans``: offset and length in
    code points of each body of ``learn_role``, in order. Null roles and texts are empty texts; turns are ordered by
    (turn, role, text), null turns first; repeated rows are repeated turns; rows with a null id form one conversation of
    their own; other columns are left out; an empty table gives no rows.
    """
    rows = turns.select(
        F.col(id_col).alias("_id"),
        F.col("turn").alias("_turn"),
        F.coalesce("role", F.lit("")).alias("_role"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    source = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    plain = render(F.col("_role"), F.col("_text"))
    ready = rows.withColumn("_same", F.coalesce(parse(plain) == source, F.lit(False)))
    role_out = F.when(F.col("_same"), F.col("_role")).otherwise(escape("_role"))
    body_out = F.when(F.col("_same"), F.col("_text")).otherwise(escape("_text"))
    order = Window.partitionBy("_id").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ready.select("_id", "_turn", "_role", "_text", role_out.alias("_role_out"), body_out.alias("_body"))
        .withColumn("_whole", render(F.col("_role_out"), F.col("_body")))
        .withColumn("_end", F.sum(F.length("_whole")).over(order))
    )
    items = placed.groupBy("_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "_end",
                    "_whole",
                    (F.col("_end") - F.length("_body") - len(CLOSE)).alias("_at"),
                    F.length("_body").cast("long").alias("_length"),
                    "_role",
                    "_text",
                )
            )
        ).alias("_items")
    )
    spans = F.transform(
        F.filter("_items", lambda x: x["_role"] == learn_role),
        lambda x: F.struct(x["_at"].alias("offset"), x["_length"].alias("length")),
    )
    wanted = F.transform("_items", lambda x: F.struct(x["_role"].alias("role"), x["_text"].alias("text")))
    done = items.select(
        "_id",
        F.array_join(F.transform("_items", lambda x: x["_whole"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        wanted.alias("_wanted"),
    ).withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.col("turns") == F.col("_wanted"), F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    )
    return done.select(F.col("_id").alias(id_col), "formatted", checked.alias("turns"), "loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["offset"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
