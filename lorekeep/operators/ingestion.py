"""Incremental ingestion: what changed, what is gone, and whether it is safe to prune."""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.scale import text_batches
from lorekeep.settings import EMBED_BATCH, PRUNE_MIN_COVERAGE


def diff_chunks(new: DataFrame, stored: DataFrame, force: bool = False, near: Column | None = None) -> DataFrame:
    """``new`` rows with ``changed``: the stored hash is absent or different. ``force`` marks all.

    Give ``near``, an expression over columns that both tables have and that is equal for rows of one id, to bring rows
    together by it: the result then lies by it, after one shuffle.
    """
    if force:
        return (new if near is None else new.repartition(near)).withColumn("changed", F.lit(True))
    known = stored.select("site_id", "id", F.col("content_hash").alias("_stored_hash"))
    if near is not None:
        thin = stored.select("site_id", "id", F.col("content_hash").alias("_stored_hash"), near.alias("_near"), F.lit(False).alias("_new"))
        met = new.withColumns({"_near": near, "_new": F.lit(True)}).unionByName(thin, allowMissingColumns=True).repartition("_near")
        same_id = Window.partitionBy("_near", "site_id", "id")
        # as in a join, a null id or site is no other's equal
        before = F.when(F.col("site_id").isNotNull() & F.col("id").isNotNull(), F.max("_stored_hash").over(same_id))
        found = met.withColumn("changed", ~F.col("content_hash").eqNullSafe(before)).filter("_new")
        return found.select(*new.columns, "changed")
    return (
        new.join(known, ["site_id", "id"], "left")
        .withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("_stored_hash")))
        .drop("_stored_hash")
    )


def orphan_chunks(new: DataFrame, stored: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Stored chunks of the documents seen in this run that the run no longer produced.

    Pass ``documents(site_id, document_id)`` so that a document that now yields no chunk is seen too.
    """
    seen = (new if documents is None else documents).select("site_id", "document_id").distinct()
    return stored.join(seen, ["site_id", "document_id"], "left_semi").join(
        new.select("site_id", "id"), ["site_id", "id"], "left_anti"
    )


def ingest_counts(diffed: DataFrame, orphans: DataFrame, by: list[str]) -> DataFrame:
    """total / embedded / skipped / deleted per document or source, in one aggregation over both tables."""
    produced = diffed.select(*by, F.lit(1).alias("total"), F.col("changed").cast("int").alias("embedded"), F.lit(0).alias("deleted"))
    removed = orphans.select(*by, F.lit(0).alias("total"), F.lit(0).alias("embedded"), F.lit(1).alias("deleted"))
    return (
        produced.unionByName(removed)
        .groupBy(*by)
        .agg(
            F.sum("total").alias("chunks_total"),
            F.sum("embedded").alias("chunks_embedded"),
            F.sum(F.col("total") - F.col("embedded")).alias("chunks_skipped"),
            F.sum("deleted").alias("chunks_deleted"),
        )
    )


def hashed_vectors(texts: DataFrame, dims: int = 256, column: str = "text") -> DataFrame:
    """The built-in embedding: hashed word counts at unit length, all in the JVM. Adds ``embedding``."""
    words = F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(texts.withColumn("_words", words))
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def embed_chunks(
    changed: DataFrame,
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    dims: int = 256,
    batch: int = EMBED_BATCH,
    column: str = "text",
    strict: bool = True,
) -> DataFrame:
    """Adds ``embedding``. ``embed`` takes up to ``batch`` texts and returns one vector each, in order.

    An empty text, a wrong number of vectors or a wrong length fails the task, as a half-embedded table is worse than
    none. The diff has run by then, so only changed chunks reach Python. Rows that no chunker has cleaned may hold no
    text: without ``strict`` a null one has a null vector, and a blank one is the model's to embed.
    """
    if not 1 <= batch <= 128:
        raise ValueError("batch must be between 1 and 128")
    if embed is None:
        return hashed_vectors(changed, dims, column)
    schema = T.StructType([*changed.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, column):
            texts = rows.column(column).to_pylist()
            if strict and any(t is None or not t.strip() for t in texts):
                raise ValueError("cannot embed an empty text")
            given = [t for t in texts if t is not None]
            vectors: list[list[float]] = []
            for start in range(0, len(given), batch):
                part = given[start : start + batch]
                found = embed(part)
                if len(found) != len(part):
                    raise ValueError(f"asked for {len(part)} vectors, got {len(found)}")
                if any(len(v) != dims for v in found):
                    raise ValueError(f"expected {dims} dimensions")
                vectors.extend(found)
            if len(given) < len(texts):
                each = iter(vectors)
                vectors = [None if t is None else next(each) for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return changed.mapInArrow(run, schema)


def embed_query(questions: DataFrame, prefix: str = "", embed=None, dims: int = 256, column: str = "question", strict: bool = True) -> DataFrame:
    """Questions with ``embedding``; some models want a prefix on the query side."""
    asked = questions.withColumn("_asked", F.concat(F.lit(prefix), F.col(column)))
    return embed_chunks(asked, embed, dims, column="_asked", strict=strict).drop("_asked")


def to_points(chunks: DataFrame, ingested_at: Column) -> DataFrame:
    """Vector-table rows from embedded chunks that carry their document's columns. The stored text is the body."""
    return chunks.select(
        "site_id",
        "id",
        "embedding",
        "document_id",
        "source_id",
        "content_type",
        "content_hash",
        F.col("index").alias("chunk_index"),
        "title",
        F.array_join("heading_path", " > ").alias("heading_path"),
        F.col("body").alias("text"),
        ingested_at.alias("ingested_at"),
        "url",
    )


def prune_plan(stored: DataFrame, seen: DataFrame, failures: DataFrame, min_coverage: float = PRUNE_MIN_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(one decision per source, the chunks to delete).

    ``stored``: site_id, source_id, document_id, id. ``seen``: site_id, source_id, document_id. ``failures``:
    site_id, source_id, failures. A source with failures, or one that covered too little of what is stored, is left
    alone. The decision stays a join, so nothing is collected however many sources there are.
    """
    keys = ["site_id", "source_id"]
    documents = stored.groupBy(*keys, "document_id").agg(F.count("*").alias("chunks"))
    marked = documents.join(seen.select(*keys, "document_id").distinct().withColumn("_seen", F.lit(True)), [*keys, "document_id"], "left")
    covered = marked.groupBy(*keys).agg(
        F.count("*").alias("stored_documents"),
        F.count("_seen").alias("seen_documents"),
        F.sum(F.when(F.col("_seen").isNull(), F.col("chunks")).otherwise(0)).alias("unseen_chunks"),
    )
    coverage = F.col("seen_documents") / F.col("stored_documents")
    failed = F.coalesce("failures", F.lit(0)) > 0
    known = covered.join(failures, keys, "full_outer")
    stored_count = F.coalesce("stored_documents", F.lit(0).cast("long"))
    reason = F.when(failed, "failures").when((stored_count > 0) & (coverage < min_coverage), "low coverage")
    decision = known.select(
        *keys,
        stored_count.alias("stored_documents"),
        F.coalesce("seen_documents", F.lit(0).cast("long")).alias("seen_documents"),
        F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
        reason.alias("skipped_reason"),
        reason.isNull().alias("pruned"),
        F.when(reason.isNull(), stored_count - F.coalesce("seen_documents", F.lit(0))).otherwise(0).alias("documents_removed"),
        F.when(reason.isNull(), F.coalesce("unseen_chunks", F.lit(0))).otherwise(0).alias("chunks_removed"),
    )
    removed = (
        stored.join(decision.filter("pruned").select(*keys), keys, "left_semi")
        .join(seen.select(*keys, "document_id").distinct(), [*keys, "document_id"], "left_anti")
        .select(*keys, "document_id", "id")
    )
    return decision, removed


def quarantine(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, failed with reason): a bad document is counted and the run goes on. No document fails for its length."""
    reason = F.when(F.col("id").isNull(), "no id").when(F.coalesce("text", F.lit("")) == "", "no text")
    marked = documents.withColumn("failure", reason)
    return marked.filter(F.col("failure").isNull()).drop("failure"), marked.filter(F.col("failure").isNotNull())


def document_failures(failed: DataFrame, source_stats: DataFrame | None = None) -> DataFrame:
    """failures per source: documents that failed here plus pages that failed in the crawl."""
    keys = ["site_id", "source_id"]
    counts = failed.groupBy(*keys).agg(F.count("*").alias("failures"))
    if source_stats is not None:
        counts = counts.unionByName(source_stats.select(*keys, F.col("failed").cast("long").alias("failures")))
    return counts.groupBy(*keys).agg(F.sum("failures").alias("failures"))


def run_report(documents: DataFrame, counts: DataFrame, decision: DataFrame) -> DataFrame:
    """Per-source rows and the grand total (source_id NULL); the deleted total includes pruned chunks.

    ``documents``: source_id, documents. ``counts``: source_id and chunk counts. ``decision``: from ``prune_plan``.
    """
    prune = decision.groupBy("source_id").agg(F.sum("chunks_removed").alias("chunks_pruned"), F.sum("failures").alias("failures"))
    rows = documents.join(counts, "source_id", "full_outer").join(prune, "source_id", "full_outer")
    measures = ["documents", "chunks_total", "chunks_embedded", "chunks_skipped", "chunks_deleted", "chunks_pruned", "failures"]
    total = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in measures]
    return (
        rows.rollup("source_id")
        .agg(*total, F.grouping("source_id").alias("is_total"))
        .withColumn(
            "chunks_deleted",
            F.when(F.col("is_total") == 1, F.col("chunks_deleted") + F.col("chunks_pruned")).otherwise(F.col("chunks_deleted")),
        )
    )
