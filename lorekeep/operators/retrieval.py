"""Matches -> ranked, masked, budgeted context. Groups are one question's matches, at most top-k rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import has_price, js_trim, mask_price, render_template
from lorekeep.operators.vectors import knn
from lorekeep.settings import RetrievalSettings

NO_RESULT = "No relevant content was found for this question."


def to_chunks(matches: DataFrame, vectors: DataFrame) -> DataFrame:
    """Matches (query_id, id, score, rank) with the payload columns of their points."""
    payload = vectors.select("id", "text", "title", "url", "heading_path", "content_type", "source_id", "document_id")
    return matches.join(payload, "id").select(
        "query_id",
        "id",
        "score",
        "rank",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("title", F.lit("")).alias("title"),
        "url",
        F.when(F.col("heading_path") != "", F.col("heading_path")).alias("heading_path"),
        "content_type",
    )


def mask_prices(chunks: DataFrame) -> DataFrame:
    """Prices masked in text, title and path; ``removed`` lists the categories found."""
    found = has_price(F.col("text")) | has_price(F.col("title")) | has_price(F.col("heading_path"))
    return chunks.withColumn("removed", F.when(found, F.array(F.lit("price"))).otherwise(F.array().cast("array<string>"))).withColumns(
        {c: mask_price(F.col(c)) for c in ("text", "title", "heading_path")}
    )


def source_key(url: Column, title: Column, chunk_id: Column) -> Column:
    return F.coalesce(url, title, chunk_id.cast("string"))


def rank_chunks(chunks: DataFrame, max_per_source: int = 2) -> DataFrame:
    """Greedy choice per question, best score first; adds ``position`` of the kept rows.

    A repeated text is dropped without costing its source a place, and a text dropped for its source's cap may still
    come in from another source. Two windows cannot say that, so one question's rows (top-k, a handful) are folded.
    """
    columns = [c for c in chunks.columns if c != "query_id"]
    row = F.struct(
        (-F.col("score")).alias("_order"),
        F.col("id").alias("_tie"),
        js_trim(F.col("text")).alias("_text"),
        source_key(F.col("url"), F.col("title"), F.col("id")).alias("_source"),
        F.struct(*columns).alias("_chunk"),
    )
    grouped = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def step(kept: Column, item: Column) -> Column:
        repeated = F.exists(kept, lambda k: k["_text"] == item["_text"])
        used = F.size(F.filter(kept, lambda k: k["_source"] == item["_source"]))
        return F.when(repeated | (used >= max_per_source), kept).otherwise(F.array_append(kept, item))

    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), step)
    return grouped.select("query_id", F.posexplode(kept).alias("_at", "_kept")).select(
        "query_id", "_kept._chunk.*", (F.col("_at") + 1).alias("position")
    )


def format_excerpt(position: Column, title: Column, heading_path: Column, url: Column, text: Column) -> Column:
    label = F.concat_ws(" > ", F.when(title != "", title), F.when(heading_path != "", heading_path))
    where = F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.lit("\nSource: "), url))
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), label, where, F.lit("\n"), text)


def within_budget(ranked: DataFrame, max_characters: int) -> DataFrame:
    """Ranked rows whose excerpts fit; the first always does. Lengths are positive, so a running sum stops in time."""
    excerpt = format_excerpt(*[F.col(c) for c in ("position", "title", "heading_path", "url", "text")])
    running = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("excerpt", excerpt)
        .withColumn("_total", F.sum(F.length("excerpt")).over(running))
        .filter((F.col("_total") <= max_characters) | (F.col("position") == 1))
        .drop("_total")
    )


def build_context(ranked: DataFrame, max_characters: int) -> DataFrame:
    """One row per question: context text and number of excerpts used."""
    parts = F.array_sort(F.collect_list(F.struct("position", "excerpt")))
    return (
        within_budget(ranked, max_characters)
        .groupBy("query_id")
        .agg(F.array_join(F.transform(parts, lambda p: p["excerpt"]), "\n\n").alias("context"), F.count("*").alias("used"))
    )


def to_sources(used: DataFrame, max_citations: int = 3, turn: str = "query_id", order: tuple[str, ...] = ("position",)) -> DataFrame:
    """Citations of a turn: first occurrence per address (else title) in call order, at most ``max_citations``."""
    keyed = used.withColumn("_key", F.coalesce("url", "title")).filter(F.col("_key") != "")
    first = keyed.groupBy(turn, "_key").agg(F.min_by(F.struct("title", "url"), F.struct(*order)).alias("_source"), F.min(F.struct(*order)).alias("_at"))
    window = Window.partitionBy(turn).orderBy("_at")
    return (
        first.withColumn("citation", F.row_number().over(window))
        .filter(F.col("citation") <= max_citations)
        .select(turn, "citation", "_source.title", "_source.url")
    )


def retrieve(queries: DataFrame, vectors: DataFrame, site_id: str, settings: RetrievalSettings = RetrievalSettings()) -> DataFrame:
    matches = knn(queries, vectors, site_id, settings.top_k, settings.min_score)
    return mask_prices(to_chunks(matches, vectors.filter(F.col("site_id") == site_id)))


def search_knowledge(queries: DataFrame, vectors: DataFrame, site_id: str, settings: RetrievalSettings = RetrievalSettings()) -> DataFrame:
    """One row per question: context (or the message for no result) and how many chunks it holds."""
    ranked = rank_chunks(retrieve(queries, vectors, site_id, settings), settings.max_per_source)
    context = build_context(ranked, settings.max_context_characters)
    return queries.select("query_id").join(context, "query_id", "left").select(
        "query_id",
        F.coalesce("context", F.lit(NO_RESULT)).alias("context"),
        F.coalesce("used", F.lit(0).cast("long")).alias("used"),
    )


def answer_outcome(turns: DataFrame, no_answer_template: str, identity: dict[str, str]) -> DataFrame:
    """turns(turn_id, content, chunks, sources) -> answer, grounded, sources. Blank answers get the rendered message."""
    message = render_template(F.lit(no_answer_template), {k: F.lit(v) for k, v in identity.items()})
    spoken = js_trim(F.coalesce("content", F.lit("")))
    grounded = F.col("chunks") > 0
    return turns.select(
        "turn_id",
        F.when(spoken == "", message).otherwise(spoken).alias("answer"),
        grounded.alias("grounded"),
        F.when(grounded, F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"),
    )
