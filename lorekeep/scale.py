"""Helpers that keep per-key work spread out when one key holds a large share of the rows.

``row_number`` with a limit needs no helper: Spark limits each group before the shuffle. What does need one is a
running value over a whole group. Here a group is cut into buckets of its order column (hours, number ranges), each
bucket is scanned on its own, and the small table of bucket totals carries values from one bucket to the next.
"""

from __future__ import annotations

from itertools import groupby
from typing import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from lorekeep.session import scratch

BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of text that a Python worker turns into objects at a time.
TEXT_BYTES = 2 * 1024 * 1024


def small_runs(texts: pa.Array, limit: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows that hold at most ``limit`` bytes of text, or are one row.

    Spark cuts batches by rows alone, so without this a worker's memory follows the length of the texts.
    """
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    low = 0
    while low < len(ends):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield low, high - low
        low = high


def text_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``small_runs`` of their text ``column``."""
    for batch in batches:
        for start, length in small_runs(batch.column(column), limit):
            yield batch.slice(start, length)


def _order(order) -> list[Column]:
    items = order if isinstance(order, (list, tuple)) else [order]
    return [F.col(o) if isinstance(o, str) else o for o in items]


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order, value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per key. ``bucket`` must grow with ``order``."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    match = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        tagged.withColumn("_local", F.sum("_value").over(inside))
        .join(offsets, match, "left")
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_value", "_local", "_offset", "_b", *[f"_k_{k}" for k in keys])
    )


def position(df: DataFrame, keys: list[str], bucket: Column, order, out: str) -> DataFrame:
    """Exact row number per key (from 1), without bringing a whole key into one task."""
    return running_sum(df, keys, bucket, order, F.lit(1).cast("long"), out)


def previous_value(df: DataFrame, keys: list[str], bucket: Column, order, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key. The first row of a bucket takes the last value of the bucket before it."""
    order = _order(order)
    tagged = df.withColumn("_bucket", bucket)
    last = tagged.groupBy(*keys, "_bucket").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    carried = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    match = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        tagged.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_lag", F.lag(value).over(inside))
        .join(carried, match, "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_bucket", "_first", "_lag", "_carried", "_b", *[f"_k_{k}" for k in keys])
    )


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a value that depends on the layout is fixed."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged_sum(df: DataFrame, keys: list[str], order: list, value: Column, out: str, keep: list[str] | None = None) -> DataFrame:
    """Running sum (long) of ``value`` per key along ``order``, over ranges of about equal row counts.

    Rows are cut into ranges by (keys, order), so a key with any share of the rows spreads over as many ranges as that
    share. Each range is summed on its own in sorted order; only a key that goes on from one range into the next needs
    the totals before it, and there is at most one such key a range, so that table is tiny. Rows with equal keys and
    order follow in the order of ``order`` only; give a total order where ties matter. ``keep`` names the columns of the
    result besides ``out`` (default: all).
    """
    keep = list(df.columns if keep is None else keep)
    by = [F.col(k) for k in keys] + _order(order)
    placed = df.withColumn("_value", value.cast("long")).repartitionByRange(*by).sortWithinPartitions(*by)
    inner = [*keep, *[k for k in keys if k not in keep]]
    slim = placed.select(*inner, "_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = np.asarray(batch.column("_value").fill_null(0))
            starts = np.zeros(n, bool)
            for k in keys:
                codes = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
                starts[1:] |= codes[1:] != codes[:-1]
            head = tuple(batch.column(k)[0].as_py() for k in keys)
            starts[0] = last is not None and head != last
            run_of = np.cumsum(starts)
            sums = np.cumsum(value)
            at = np.flatnonzero(starts)
            before = np.concatenate([[-total], sums[at] - value[at]])  # the first run goes on from the batch before
            running = sums - before[run_of]
            flags = (run_of == 0) & first
            first = bool(flags[-1])
            last, total = tuple(batch.column(k)[n - 1].as_py() for k in keys), int(running[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(running, pa.int64()), pa.array(np.full(n, part), pa.int32()), pa.array(flags)], names=[*inner, "_value", out, "_part", "_head"]
            )

    schema = StructType(list(slim.schema.fields)).add(out, LongType()).add("_part", IntegerType()).add("_head", BooleanType())
    summed = stored(slim.mapInArrow(run, schema), "ranges")
    match = lambda names: [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    heads = summed.filter("_head").select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).distinct()  # one a range at most
    crossing = summed.join(F.broadcast(heads), match([f"_h{i}" for i in range(len(keys))]), "left_semi") if keys else summed
    totals = crossing.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    on = match([f"_k{i}" for i in range(len(keys))])
    joined = summed.join(F.broadcast(offsets), [*on, F.col("_part") == F.col("_p")], "left")
    return joined.select(*[c for c in keep], (F.col(out) + F.coalesce("_offset", F.lit(0))).alias(out))


def fits_broadcast(row_count: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    return row_count * row_bytes <= limit


def scan_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    step: Callable[[tuple, Iterable[tuple]], Iterable[tuple]],
    schema,
    batch: int = 10_000,
) -> DataFrame:
    """Run ``step(key, rows)`` over each group in order, many groups per Python call.

    Rows are shuffled by key and sorted in the JVM, then pass through Python as one stream of tuples, so a group is
    never held as a whole and small groups carry no per-group cost. ``step`` yields output rows.
    """
    sorted_rows = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    width = len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False, name=None))
        held: list[tuple] = []
        for key, group in groupby(rows, lambda row: row[:width]):
            for out in step(key, (row[width:] for row in group)):
                held.append(out)
                if len(held) >= batch:
                    yield pd.DataFrame(held, columns=fields)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=fields)

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = struct.names
    return sorted_rows.mapInPandas(run, struct)
