"""One pass over a stream that sends rows to several places and counts what it sees on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.privacy import CATEGORIES
from lorekeep.operators.conversations import REQUEST_REASONS, marked_requests, redact_turns


def route(stream: DataFrame, mark: Callable[[DataFrame], DataFrame], metrics: dict[str, Column], out: str, checkpoint: str):
    """Start the query: each batch is marked (adds ``route``) and written once, by route; its metrics are observed in that pass.

    ``out/rows`` holds the rows in folders by batch and route, ``out/counts`` one row of metrics per batch. A batch that is
    replayed after a failure replaces both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch {batch_id}")
        counted = [F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in metrics.items()]
        mark(batch).observe(seen, *counted).write.mode("overwrite").partitionBy("route").parquet(f"{out}/rows/batch_id={batch_id}")
        found = [(name, int(seen.get[name])) for name in metrics]
        batch.sparkSession.createDataFrame(found, "metric string, count long").coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows sent to one route so far."""
    return spark.read.parquet(f"{out}/rows").filter(F.col("route") == name).drop("route", "batch_id")


def observed(spark: SparkSession, out: str) -> DataFrame:
    """metric, count over all batches; metrics that never counted anything are left out."""
    return spark.read.parquet(f"{out}/counts").groupBy("metric").agg(F.sum("count").alias("count")).filter("count > 0")


def requests_stream(raw: DataFrame, max_message: int, out: str, checkpoint: str):
    """Requests (map ``fields``) to the routes ``accepted`` and ``rejected``; counted by reason."""

    def mark(batch: DataFrame) -> DataFrame:
        return marked_requests(batch, max_message).withColumn("route", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))

    metrics = {"accepted": F.count_if(F.col("reason").isNull())} | {r: F.count_if(F.col("reason") == r) for r in REQUEST_REASONS}
    return route(raw, mark, metrics, out, checkpoint)


def redacted_stream(turns: DataFrame, out: str, checkpoint: str, column: str = "content"):
    """Turns with personal data taken out, to the routes ``changed`` and ``same``; counted by category."""

    def mark(batch: DataFrame) -> DataFrame:
        return redact_turns(batch, column).withColumn("route", F.when(F.size("removed") > 0, "changed").otherwise("same"))

    return route(turns, mark, {c: F.count_if(F.array_contains("removed", c)) for c in CATEGORIES}, out, checkpoint)
