"""Documents -> chunks -> changed points -> one more version of the vector table, orphans and pruned chunks removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.chunking import chunk_documents, chunk_text_column
from lorekeep.operators.ingestion import diff_chunks, document_failures, embed_chunks, ingest_counts, orphan_chunks, prune_plan, quarantine, run_report, to_points
from lorekeep.scale import stored
from lorekeep.settings import ChunkSettings
from lorekeep.sources.versions import bucket_of, compact_levels, has_versions, layout, newest_rows, read_current, write_version

CARRIED = ("site_id", "source_id", "content_type", "url")
KNOWN = ["source_id", "document_id", "content_hash"]
EMPTY = "site_id string, id string, source_id string, document_id string, content_hash string"


def newest_documents(documents: DataFrame, version: str | None) -> DataFrame:
    """One row per (site, document), the newest by ``version`` where there is one. Rows without an id stay, to be counted."""
    if version is None:
        return documents
    named = newest_rows(documents.filter("id IS NOT NULL"), ["site_id", "id"], version).select(*documents.columns)
    return named.union(documents.filter("id IS NULL"))


def changes(documents: DataFrame, known: DataFrame, seen: DataFrame, settings: ChunkSettings, near: Column, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks with ``changed``, orphans) of a batch. A document of ``seen`` that now has no text loses all its chunks.

    Chunks are cut once, shuffled once, by ``near``, the table's bucket, and written so. Only changed ones keep their body; the
    text is made again from it for those that are embedded.
    """
    diffed = diff_chunks(chunk_documents(documents, settings, CARRIED).drop("text"), known, force, near)
    lean = diffed.withColumns({c: F.when(F.col("changed"), F.col(c)) for c in ("body", "heading_path", "content_hash")})
    lean = stored(lean, "changes", "zstd")
    return lean, orphan_chunks(lean, known, seen)


def embedded(diffed: DataFrame, settings: ChunkSettings, embed, dims: int) -> DataFrame:
    changed = diffed.filter("changed").drop("changed").withColumn("text", chunk_text_column(settings))
    return to_points(embed_chunks(changed, embed, dims), F.current_timestamp())


def ingest_batch(documents: DataFrame, table: str, version: int, settings: ChunkSettings, dims: int, embed=None, newest: str | None = None) -> None:
    """Write one batch as version ``version``; a replay sees the versions before it and writes the same again.

    Only the buckets of the batch's documents are read. Earlier versions are merged by size first.

    Documents without an id are left out, as nothing could be stored under them; ``run_ingestion`` counts them. Each changed
    chunk is embedded once. The batch is read twice: its ids, to see whether versions of a document must be compared, and
    whole.
    """
    spark = documents.sparkSession
    named = documents.filter("id IS NOT NULL")
    batch = stored(named.groupBy("site_id", F.col("id").alias("document_id")).agg(F.count("*").alias("times")), "batch")
    usable = named if newest is None or batch.filter("times > 1").isEmpty() else newest_documents(named, newest)
    by, buckets = layout(spark, table)
    near = bucket_of(by, buckets)
    if has_versions(spark, table):
        compact_levels(spark, table, before=version)
        known = stored(read_current(spark, table, KNOWN, before=version, documents=batch), "known")
        diffed, orphans = changes(usable, known, batch, settings, near)
    else:  # nothing to compare with: cut, shuffled and written in one go
        diffed, orphans = diff_chunks(chunk_documents(usable, settings, CARRIED).drop("text"), spark.createDataFrame([], EMPTY), True, near), None
    write_version(embedded(diffed, settings, embed, dims), table, version, orphans, placed=True)


def run_ingestion(documents: DataFrame, table: str, version: int, settings: ChunkSettings = ChunkSettings(), dims: int = 256, embed=None,
                  crawl_failures: DataFrame | None = None, newest: str | None = None, prune: bool = True, force: bool = False) -> DataFrame:
    """A full run over all sources: quarantine, diff, embed once, upsert, delete orphans, guarded prune, report.

    ``crawl_failures``: site_id, source_id, failed. Without ``prune`` nothing unseen is removed. An empty text is not a
    failure of the run's documents: such a document is seen and loses its chunks. Returns the report of ``run_report``.
    """
    spark = documents.sparkSession
    latest = stored(newest_documents(documents, newest), "latest", "zstd")
    usable = latest.filter("id IS NOT NULL")
    failures = document_failures(quarantine(latest)[1].filter("failure = 'no id'").select("site_id", "source_id"), crawl_failures)
    known = stored(read_current(spark, table, KNOWN, before=version), "known") if has_versions(spark, table) else spark.createDataFrame([], EMPTY)
    seen = usable.select("site_id", "source_id", F.col("id").alias("document_id"))
    by, buckets = layout(spark, table)
    diffed, orphans = changes(usable, known, seen, settings, bucket_of(by, buckets), force)
    orphans = stored(orphans, "orphans")
    decision, removed = prune_plan(known, seen, failures)
    decision, removed = stored(decision, "decision"), stored(removed, "removed")
    if not prune:
        decision = decision.withColumns({"pruned": F.lit(False), "documents_removed": F.lit(0).cast("long"), "chunks_removed": F.lit(0).cast("long")})
        removed = removed.limit(0)
    gone = ["site_id", "id", "document_id"]
    write_version(embedded(diffed, settings, embed, dims), table, version, orphans.select(*gone).union(removed.select(*gone)), placed=True)
    counted = usable.groupBy("source_id").agg(F.count_distinct("site_id", "id").alias("documents"))
    return run_report(counted, ingest_counts(diffed, orphans, ["source_id"]), decision)
