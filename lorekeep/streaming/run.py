"""Running a stream to the end of what has arrived, and reading back what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.session import scratch


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; its schema comes from the files there now.

    The table may be one file or a folder. A stream takes a plain path for a folder only, so it is given as a pattern
    that matches nothing else.
    """
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append", keyed: bool = False) -> DataFrame:
    """Process everything available and return the output. ``keyed``: the query holds state with timers, in RocksDB.

    Append output is written by the file sink. In the other modes each batch goes to a folder of its own with its
    number as ``batch_id``, so that later versions of a row can be told from earlier ones.
    """
    spark = stream.sparkSession
    folder = scratch(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

        writer = stream.writeStream.foreachBatch(write)
    before = spark.conf.get(STORE)
    if keyed:
        spark.conf.set(STORE, ROCKSDB)
    try:  # a query keeps the store that it was started with
        running = writer.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    running.awaitTermination()
    numbered = [] if mode == "append" else [T.StructField("batch_id", T.IntegerType())]
    return spark.read.schema(T.StructType(stream.schema.fields + numbered)).parquet(f"{folder}/out")


#: Rows of a file that ``in_batches`` deals out, about; a batch is as many files as its rows ask for.
FILE_ROWS = 100_000
#: Files of a batch for each core at most: an empty batch takes a write for each of its files.
FILES_PER_CORE = 2


def in_batches(rows: DataFrame, order: Column, batches: int, end: DataFrame | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """A table as a stream of ``batches`` micro-batches, dealt by ``order`` (a number from 0), with ``end`` as the last.

    ``end`` holds rows from long after, such as a clock sends, so that the watermark passes everything before. The table is
    computed once, in a folder a batch. Every batch is cut into equally many files, so that many tasks write and read it; a
    batch too small for that gets empty ones.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows.withColumn("_batch", order.cast("double")).filter(F.col("_batch").isin(*map(float, range(batches)))).write.partitionBy("_batch").parquet(f"{folder}-dealt")
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_batch", T.DoubleType())])).parquet(f"{folder}-dealt")
    sizes = dict(dealt.groupBy("_batch").count().collect())  # at most ``batches`` rows
    files = max(1, min(-(-max(sizes.values(), default=0) // file_rows), FILES_PER_CORE * spark.sparkContext.defaultParallelism))
    held = lambda: len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    for n in range(batches):
        part = dealt.filter(F.col("_batch") == n).drop("_batch")
        if files == 1:
            part = part.coalesce(1)
        else:
            small = sizes.get(float(n), 0) <= file_rows
            # by a hash of the row's place: dealing in turn would sort whole rows first
            part = (part.coalesce(1) if small else part).withColumn("_place", F.monotonically_increasing_id()).repartition(files, "_place").drop("_place")
        part.write.mode("append").parquet(folder)
        if files > 1 and (n < batches - 1 or end is not None):
            for _ in range(files * (n + 1) - held()):
                spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    if end is not None:
        end.select(*rows.columns).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Update output: for each key the rows of the newest batch that wrote it."""
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("_newest")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col("batch_id") == F.col("_newest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi").drop("batch_id")


def latest(rows: DataFrame) -> DataFrame:
    """Complete output: the rows of the last batch are the whole result."""
    last = rows.agg({"batch_id": "max"}).first()[0]
    return rows.filter(rows["batch_id"] == last).drop("batch_id")
