"""Documents arriving as a stream, ingested batch by batch with the same diff as a full run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lorekeep.plans.ingest import ingest_batch
from lorekeep.settings import ChunkSettings


def ingest_stream(documents: DataFrame, table: str, checkpoint: str, settings: ChunkSettings = ChunkSettings(), dims: int = 256, embed=None, newest: str | None = None, first_version: int = 0):
    """Start the query: every micro-batch is chunked, compared with what is stored of its documents, embedded and upserted.

    Batch n is version ``first_version`` + n of the table, so one that is replayed after a failure replaces itself. Give
    ``newest``, a column that grows with the version of a document, where a batch can hold several versions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, table, first_version + batch_id, settings, dims, embed, newest)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
