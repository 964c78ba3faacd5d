"""Documents -> heading-aware chunks."""

from __future__ import annotations

import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.html import trim
from lorekeep.functions.text import SPACE
from lorekeep.scale import text_batches
from lorekeep.settings import ChunkSettings

HEADING = re.compile(rf"(#{{1,6}})[{SPACE}]+([^\n\r  ]*)")
# A sentence ends at . ! or ?, perhaps with one closing quote or bracket, before white space.
SENTENCE_END = re.compile(rf"(?:(?<=[.!?])|(?<=[.!?][)\"'”’]))[{SPACE}]+")


def text_blocks(text: str) -> Iterator[tuple[int, str]]:
    """(level, text) per heading (level 1 to 6) or paragraph (level 0)."""
    paragraph: list[str] = []
    for line in [*text.split("\n"), ""]:
        heading = HEADING.fullmatch(line)
        if heading is None and trim(line):
            paragraph.append(line)
            continue
        joined = trim("\n".join(paragraph))
        paragraph = []
        if joined:
            yield 0, joined
        if heading is not None:
            yield len(heading[1]), trim(heading[2])


def split_oversized(text: str, limit: int) -> list[str]:
    """Whole sentences packed up to ``limit``; a longer sentence is cut hard."""
    if len(text) <= limit:
        return [text]
    packed = [""]
    for sentence in SENTENCE_END.split(text):
        joined = f"{packed[-1]} {sentence}" if packed[-1] else sentence
        if packed[-1] and len(joined) > limit:
            packed.append(sentence)
        else:
            packed[-1] = joined
    return [p[at : at + limit] for p in packed if p for at in range(0, len(p), limit)]


def tail_overlap(text: str, size: int) -> str:
    """The end of a chunk that opens the next one, from its first sentence boundary on."""
    if size <= 0 or len(text) <= size:
        return ""
    tail = text[-size:]
    boundary = SENTENCE_END.search(tail)
    return re.sub(f"^[{SPACE}]+", "", tail[boundary.start() :] if boundary else tail)


def chunk_text(text: str, settings: ChunkSettings) -> list[tuple[str, list[str]]]:
    """(body, heading path) per chunk.

    The size check counts what is already there plus the new piece, not the blank line between them, and is not
    repeated after a cut, so a body can be longer than the maximum by the overlap it carried in.
    """
    limit = settings.max_chunk_characters
    done: list[tuple[str, list[str]]] = []
    trail: list[tuple[int, str]] = []
    parts: list[str] = []
    path: list[str] = []
    fresh = True

    def close():
        nonlocal parts, fresh
        body = trim("\n\n".join(parts))
        parts = []
        if body:
            done.append((body, path))
            carried = tail_overlap(body, settings.overlap_characters)
            parts = [carried] if carried else []
        fresh = True

    for level, block in text_blocks(text):
        if level:
            if level <= settings.split_on_heading_level:
                close()
            trail = [entry for entry in trail if entry[0] < level] + [(level, block)]
            pieces = ["#" * level + " " + block]
        else:
            pieces = split_oversized(block, limit)
        for piece in pieces:
            if sum(map(len, parts)) + 2 * max(len(parts) - 1, 0) + len(piece) > limit:
                close()
            if fresh:
                path, fresh = [name for _, name in trail], False
            parts.append(piece)
    close()
    if len(done) > 1 and len(done[-1][0]) < settings.min_chunk_characters:
        merged = done[-2][0] + "\n\n" + done[-1][0]
        if len(merged) <= limit:
            done[-2:] = [(merged, done[-2][1])]
    return done


def chunk_prefix(title: Column, heading_path: Column) -> Column:
    """Title and heading path on a line of their own, without empty or repeated parts; '' when nothing is left."""
    parts = F.array_distinct(F.filter(F.concat(F.array(title), heading_path), lambda p: p != ""))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " > "), F.lit("\n\n"))).otherwise("")


PIECES = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
    ]
)


def chunk_text_column(settings: ChunkSettings) -> Column:
    """The text that is embedded and hashed, from a chunk's title, heading path and body."""
    prefix = chunk_prefix(F.coalesce("title", F.lit("")), F.col("heading_path")) if settings.include_heading_path else F.lit("")
    return F.concat(prefix, F.col("body"))


def chunk_documents(docs: DataFrame, settings: ChunkSettings = ChunkSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """documents(id, title, text) -> document_id, id, index, text, body, heading_path, content_hash and ``keep``.

    Chunks come out of the scan's own partitions; ids, prefixes and hashes are added in the JVM. No shuffle.
    """
    carried = ["id", "title", *[c for c in keep if c not in ("id", "title", "text")]]
    schema = T.StructType([docs.schema[c] for c in carried] + PIECES.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, "text"):
            pieces = [chunk_text(text or "", settings) for text in rows.column("text").to_pylist()]
            origin = pa.array([row for row, found in enumerate(pieces) for _ in found], pa.int64())
            index, body, path = zip(*[(i, *piece) for found in pieces for i, piece in enumerate(found)]) if len(origin) else ((), (), ())
            made = [pa.array(index, pa.int32()), pa.array(body, pa.string()), pa.array(path, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(origin) for c in carried), *made], names=schema.names)

    cut = docs.select(*carried, "text").mapInArrow(run, schema)
    return (
        cut.withColumnRenamed("id", "document_id")
        .withColumn("id", F.concat(F.col("document_id").cast("string"), F.lit("#"), F.col("index")))
        .withColumn("text", chunk_text_column(settings))
        .withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    )


def corpus_audit(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Size and shape of a chunk table, in one pass plus the distinct count of bodies."""
    topics = F.regexp_count("body", F.lit(r"(?m)^#{1,6}\s+\S"))
    keyed = chunks.select(
        *(by or []),
        F.length("body").alias("size"),
        (F.size("heading_path") > 0).cast("double").alias("has_path"),
        (topics > 1).cast("double").alias("several"),
        F.sha2("body", 256).alias("body_hash"),
    )
    # rows first shrink to one per distinct body, so a body shared by a third of the corpus is one row afterwards
    grouped = keyed.groupBy(*(by or []), "body_hash").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("has_path").alias("has_path"), F.sum("several").alias("several")
    )
    total = F.sum("n")
    return grouped.groupBy(*(by or [])).agg(
        total.alias("chunks"),
        F.round(F.sum("size") / total, 2).alias("mean_length"),
        F.round(F.sum("has_path") / total, 4).alias("heading_path_share"),
        F.round(F.sum("several") / total, 4).alias("multi_topic_share"),
        F.count("*").alias("distinct_bodies"),
        F.round(1 - F.count("*") / total, 4).alias("repeated_share"),
    )


def boilerplate_sections(chunks: DataFrame, min_documents: int) -> DataFrame:
    """Closing path segments shared by many documents: section, chunks, documents, distinct bodies."""
    section = F.element_at("heading_path", -1)
    keyed = chunks.filter(F.size("heading_path") > 0).select(
        section.alias("section"), "document_id", F.sha2("body", 256).alias("body_hash")
    )
    return (
        keyed.groupBy("section")
        .agg(
            F.count("*").alias("chunks"),
            F.count_distinct("document_id").alias("documents"),
            F.count_distinct("body_hash").alias("distinct_bodies"),
        )
        .filter(F.col("documents") >= min_documents)
    )
