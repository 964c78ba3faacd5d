"""Vector tables: versions cut into buckets, a directory of what lies where, and levels that are merged by size.

A version holds the changed rows and the tombstones of one write, in folders by a hash of the document, so a batch of a few
documents reads the buckets of those alone. The directory has one entry per written segment; a segment counts once its entry
is there, so a write that failed half-way is not seen. Where many segments of one size have gathered, they are merged into
one that covers their versions: readers see a number of segments that grows with the logarithm of the table.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lorekeep.scale import stored

KEYS = ("site_id", "id")
#: Buckets of a new table, and segments of one size that are merged into the next.
BUCKETS, FAN_IN = 64, 8
DIRECTORY = "first long, last long, bucket int, rows long, buckets int, by string, columns string"


def newest_rows(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: that of the highest version. Sums are partial before the shuffle, so a key with many rows is cheap."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(version, F.xxhash64(*others)))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


@dataclass(frozen=True)
class Segment:
    """The versions ``first`` to ``last``, merged. ``by``: the column whose hash, with the site, gives the bucket."""

    first: int
    last: int
    rows: int
    buckets: int
    by: str
    columns: str

    def folder(self, path: str) -> str:
        return f"{path}/segments/first={self.first}/last={self.last}"

    def entry(self, path: str) -> str:
        return f"{path}/directory/segment={self.first}-{self.last}"


def written_segments(spark: SparkSession, path: str) -> list[Segment]:
    """Every segment in the directory, also those that a merged one covers; none where there is no table yet."""
    try:
        entries = spark.read.schema(DIRECTORY).parquet(f"{path}/directory")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    one = entries.groupBy("first", "last", "buckets", "by", "columns").agg(F.sum("rows").alias("rows"))
    return [Segment(r["first"], r["last"], r["rows"], r["buckets"], r["by"], r["columns"]) for r in one.collect()]


def live(segments: list[Segment], before: int | None = None) -> list[Segment]:
    """The segments that together make the table (``before`` a version), the oldest first; covered ones are left out."""
    out: list[Segment] = []
    for segment in sorted((s for s in segments if before is None or s.last < before), key=lambda s: (s.first, -s.last)):
        if not out or segment.first > out[-1].last:
            out.append(segment)
    return out


def bucket_of(by: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64("site_id", by), F.lit(buckets)).cast("int")


def _repeated(rows: DataFrame) -> bool:
    """Whether a key may come twice. Only hashes travel; two keys of one hash count as a key that does."""
    hashes = rows.select(F.xxhash64(*KEYS).alias("_key"))
    return not hashes.groupBy("_key").count().filter("count > 1").isEmpty()


def _write(rows: DataFrame, path: str, first: int, last: int, buckets: int, by: str, settled: bool = False, once: bool = False) -> None:
    """Write a segment that holds each key once. ``settled``: the rows have their ``bucket`` and lie by it. ``once``: no key comes twice.

    Otherwise rows are shuffled once, to their buckets; keys are compared in what was written, and only where one may come
    twice is the segment written again: one upsert a key, and one row of an upsert and tombstones.
    """
    spark, columns = rows.sparkSession, StructType([f for f in rows.schema.fields if f.name != "bucket"])
    folder = Segment(first, last, 0, buckets, by, "").folder(path)
    # a bucket's rows come together, yet a large one is still written by several tasks
    placed = rows if settled else rows.withColumn("bucket", bucket_of(by, buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
    there = spark.read.schema(StructType([*columns.fields]).add("bucket", IntegerType())).parquet(folder)
    if not once and _repeated(there):
        upserts = there.filter(~F.col("deleted")).dropDuplicates(list(KEYS))
        one = newest_rows(upserts.union(there.filter("deleted")).withColumn("_same", F.lit(0)), list(KEYS), "_same").select(*columns.names)
        return _write(stored(one, "once"), path, first, last, buckets, by, once=True)
    held = there.groupBy("bucket").agg(F.count("*").alias("rows"))
    entry = held.union(spark.range(1).select(F.lit(-1), F.lit(0).cast("long"))).select(
        F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"), "bucket", "rows", F.lit(buckets).alias("buckets"), F.lit(by).alias("by"), F.lit(columns.json()).alias("columns")
    )
    entry.coalesce(1).write.mode("overwrite").parquet(Segment(first, last, 0, buckets, by, "").entry(path))


def layout(spark: SparkSession, path: str) -> tuple[str, int]:
    """Bucketing column and buckets of a table; of one that is yet to be written, the defaults."""
    there = written_segments(spark, path)
    return (there[0].by, there[0].buckets) if there else ("document_id", BUCKETS)


def write_version(points: DataFrame, path: str, version: int, deleted: DataFrame | None = None, buckets: int = BUCKETS, placed: bool = False) -> None:
    """Add one version: upserts, and tombstones for the keys in ``deleted``.

    Nothing stored is rewritten, whatever the size of the tenant. A version that is written again, as after a failure,
    replaces itself. Of several rows of one id within ``points`` one stays. Rows are bucketed by ``document_id`` (by ``id``
    in a table without one), so an id must stay with its document; a table keeps the ``buckets`` it began with. ``placed``:
    the points lie by the bucket of the table's ``layout`` and are written where they are.
    """
    spark = points.sparkSession
    there = written_segments(spark, path)
    by = there[0].by if there else "document_id" if "document_id" in points.columns else "id"
    buckets = there[0].buckets if there else buckets
    number = bucket_of(by, buckets)
    rows = points.withColumn("deleted", F.lit(False))
    if deleted is not None:
        keys = list(dict.fromkeys([*KEYS, by]))
        if by not in deleted.columns:
            deleted = deleted.select(*KEYS).join(read_current(spark, path, [by], before=version), list(KEYS))
        dead = deleted.select(*keys).distinct().withColumn("deleted", F.lit(True))
        rows = rows.unionByName(dead.repartition(number) if placed else dead, allowMissingColumns=True)
    _write(rows.withColumn("bucket", number) if placed else rows, path, version, version, buckets, by, settled=placed)


def has_versions(spark: SparkSession, path: str) -> bool:
    return bool(written_segments(spark, path))


def _read(spark: SparkSession, path: str, segments: list[Segment], known: list[Segment] | None = None) -> DataFrame:
    fields = {}
    for segment in known or segments:
        for field in StructType.fromJson(json.loads(segment.columns)).fields:
            fields.setdefault(field.name, field)
    schema = StructType(list(fields.values())).add("first", LongType()).add("last", LongType()).add("bucket", IntegerType())
    folders = [s.folder(path) for s in segments if s.rows]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/segments").parquet(*folders)


def _newest(spark: SparkSession, path: str, segments: list[Segment], known: list[Segment], columns: list[str] | None = None, only=None) -> DataFrame:
    """The newest row of each key, tombstones too, with ``bucket`` and ``deleted``; ``only`` narrows the rows down first.

    The last segment's rows are all newest, so they stay where they are; of them the older rows meet the keys alone, in
    their bucket. Nothing is shuffled for a table of one segment.
    """
    segments = [s for s in segments if s.rows]
    older, last = (_read(spark, path, part, known) for part in (segments[:-1], segments[-1:]))
    if columns is not None:
        names = list(dict.fromkeys([*KEYS, *columns, "deleted", "last", "bucket"]))
        older, last = older.select(*names), last.select(*names)
    if only is not None:
        older, last = only(older), only(last)
    last, older = last.drop("first"), older.drop("first")
    if len(segments) < 2:
        return last.drop("last")
    keys = ["bucket", *KEYS]
    over = last.select(*keys, "last").withColumn("_over", F.lit(True))
    met = older.withColumn("_over", F.lit(False)).unionByName(over, allowMissingColumns=True).repartition("bucket")
    return newest_rows(met, keys, "last").filter(~F.col("_over")).select(*older.columns).unionByName(last).drop("last")


def read_current(spark: SparkSession, path: str, columns: list[str] | None = None, before: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The table as of now, or as it was ``before`` a version: the newest row of each id, without deleted ones.

    Name the ``columns`` that are needed; vectors and texts are not read otherwise. With ``documents`` (site_id and the
    bucketing column) only their buckets are read, and only their rows are compared with one another.
    """
    there = written_segments(spark, path)
    segments, only = live(there, before), None
    if documents is not None and segments:
        keys = ["site_id", segments[0].by]
        wanted = documents.select(*keys).distinct()
        numbers = [r[0] for r in wanted.select(bucket_of(keys[1], segments[0].buckets)).distinct().collect()]  # as many as buckets
        only = lambda rows: rows.filter(F.col("bucket").isin(numbers)).join(wanted, keys, "left_semi")
    needed = columns if columns is None or only is None else [*columns, segments[0].by]
    rows = _newest(spark, path, segments, there, needed, only).filter(~F.col("deleted")).drop("deleted", "bucket")
    return rows.select(*dict.fromkeys([*KEYS, *(rows.columns if columns is None else columns)]))


def due(segments: list[Segment], fan_in: int) -> tuple[int, int] | None:
    """The newest run of ``fan_in`` or more neighbours none of which is of a larger size than its last."""
    size = [int(math.log(max(1, s.rows), fan_in)) for s in segments]
    for end in range(len(segments), 0, -1):
        start = end
        while start and size[start - 1] <= size[end - 1]:
            start -= 1
        if end - start >= fan_in:
            return start, end
    return None


def compact_levels(spark: SparkSession, path: str, before: int | None = None, fan_in: int = FAN_IN) -> int:
    """Merge runs of segments of one size, older than ``before``, until none is due; returns the number of merges.

    A row is rewritten once per size it grows through. The merged segment takes over when its entry is written; what it
    covers stays for readers under way until ``remove_covered``. Tombstones go once nothing older is left under them.
    """
    merges = 0
    while (run := due(segments := live(written_segments(spark, path), before), fan_in)) is not None:
        start, end = run
        rows = _newest(spark, path, segments[start:end], segments[start:end])
        kept = rows.filter(~F.col("deleted")) if start == 0 else rows
        _write(kept, path, segments[start].first, segments[end - 1].last, segments[0].buckets, segments[0].by, settled=True, once=True)
        merges += 1
    return merges


def remove_covered(spark: SparkSession, path: str) -> int:
    """Delete segments that a merged one covers, their entries first. Call it when no reader of before the merge is left."""
    there = written_segments(spark, path)
    gone = [s for s in there if s not in live(there)]
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for segment in gone:
        for place in (segment.entry(path), segment.folder(path)):
            where = jvm.org.apache.hadoop.fs.Path(place)
            where.getFileSystem(conf).delete(where, True)
    return len(gone)


def upsert_vectors(points: DataFrame, path: str, version: int) -> None:
    """Upsert by (site, id) as one more version of the table."""
    write_version(points, path, version)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the resolved table to a new place as its version 0; readers then move over."""
    there = written_segments(spark, path)
    begun = (written_segments(spark, target) or there)[0]
    if (begun.buckets, begun.by) != (there[0].buckets, there[0].by):
        return write_version(read_current(spark, path), target, 0)
    rows = _newest(spark, path, live(there), there).filter(~F.col("deleted"))
    _write(rows, target, 0, 0, begun.buckets, begun.by, settled=True, once=True)
