"""Documents that hold a passage of a benchmark, found by SimHash over windows of the items' sizes.

1. Only a window that shares enough shingles with an item can be similar to it. Documents' shingles are looked up among
   those of the items; where a document holds fewer of an item's than any similar window would need, it is clean.
2. Around what is left, every window of the item's size that holds enough of them is fingerprinted: bit i of a SimHash is
   the majority of bit i over the window's shingles, each as often as it occurs.
3. Fingerprints are cut into one block more than the radius. Two that differ in at most ``RADIUS`` bits agree in a block,
   so an equality join on (size, block, value) meets all such pairs.
4. Each pair within the radius is verified: the sum of the smaller counts of each shingle over the sum of the larger.

DataFrame functions only. A window of the same size with a similarity of 0.75 shares 6/7 of its shingles; each bit then
differs with a chance of 0.17, so the radius of 24 of 64 bits misses one pair in 100,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import fresh, stored

SHINGLE = 5
NEAR, WHOLE = 75, 100
BITS, RADIUS = 64, 24
BROADCAST_BYTES = 64 * 1024 * 1024
#: Three counters of 21 bits share a sum.
LANE, LANES = 21, 3


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    """Hash of every five consecutive words; empty if there are fewer."""
    return F.when(F.size(hashes) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(hashes) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(hashes, i, SHINGLE)))).otherwise(
        F.array().cast("array<bigint>")
    )


def item_shingles(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, size in shingles, hash, times) of the items; those of fewer than five words have none. Ids with several
    texts are items of their own; repeated rows count once."""
    hashed = benchmark.select(F.col(id_col).alias("item"), word_hashes(F.col(text_col)).alias("_w")).distinct()
    held = hashed.select("item", shingles(F.col("_w")).alias("_s")).select("item", F.xxhash64("_s").alias("version"), F.size("_s").alias("size"), F.explode_outer("_s").alias("h"))
    return held.filter("h IS NOT NULL").groupBy("item", "version", "size", "h").agg(F.count("*").alias("times"))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a table whose counted rows keep within the bound; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def needed(size: Column) -> Column:
    """Shingles that anything similar to an item of ``size`` shingles shares with it."""
    return F.ceil(size * NEAR / WHOLE).cast("int")


def suspicious(documents: DataFrame, items: DataFrame, item_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, item, version, size, places): where a document holds an item's shingles, if often enough."""
    hashed = documents.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), word_hashes(F.col(text_col)).alias("_w"))
    # the outer form keeps Spark from computing the array a second time in a filter of its own
    placed = hashed.select("doc", "text_hash", F.posexplode_outer(shingles(F.col("_w"))).alias("place", "h"))
    keys = items.select("item", "version", "size", "h")
    met = placed.join(maybe_broadcast(keys, item_rows, 64), "h").groupBy("doc", "text_hash", "item", "version", "size")
    return met.agg(F.collect_set("place").alias("places")).filter(F.size("places") >= needed(F.col("size")))


def window_starts(places: Column, size: Column) -> Column:
    """Starts of the windows that hold enough of the places."""
    every = F.sequence(F.greatest(F.array_min(places) - size + 1, F.lit(0)), F.array_max(places))
    near = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - size + 1, F.lit(0)), p))))
    starts = F.when(F.array_max(places) - F.array_min(places) <= 4 * size, every).otherwise(near)
    return F.filter(starts, lambda s: F.size(F.filter(places, lambda p: (p >= s) & (p < s + size))) >= needed(size))


def windows(documents: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, size, start, h: shingles of the window) around what was found, each window once."""
    found = stored(found, "decontamination-found")
    starts = found.select("doc", "text_hash", "size", F.explode_outer(window_starts(F.col("places"), F.col("size"))).alias("start")).filter("start IS NOT NULL").distinct()
    starts = stored(starts.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("size", "start")).alias("wanted")), "decontamination-starts")
    few = maybe_broadcast(starts.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"}), starts.select(F.coalesce(F.sum(F.size("wanted") + 8), F.lit(0))).first()[0], 16)
    texts = documents.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_t"))
    hit = texts.join(few, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).dropDuplicates(["doc", "text_hash"])
    hashed = hit.select("doc", "text_hash", "wanted", word_hashes(F.col("_t")).alias("_w")).select("doc", "text_hash", "wanted", shingles(F.col("_w")).alias("_s"))
    cut = hashed.select("doc", "text_hash", "_s", F.explode_outer("wanted").alias("at"))
    return cut.select("doc", "text_hash", F.col("at.size").alias("size"), F.col("at.start").alias("start"), F.slice("_s", F.col("at.start") + 1, F.col("at.size")).alias("shingles"))


def fingerprints(rows: DataFrame, keys: list[str], h: str = "h", times: Column | None = None) -> DataFrame:
    """One row per key: its SimHash (``print``) and number of shingles (``total``)."""
    times = F.lit(1).cast("long") if times is None else times.cast("long")
    sums = []
    for first in range(0, BITS, LANES):
        lanes = None
        for lane in range(min(LANES, BITS - first)):
            bit = F.shiftleft(F.shiftrightunsigned(h, first + lane).bitwiseAND(F.lit(1)), lane * LANE)
            lanes = bit if lanes is None else lanes.bitwiseOR(bit)
        sums.append(F.sum(lanes * times).alias(f"_{first}"))
    counted = rows.groupBy(*keys).agg(F.sum(times).alias("total"), *sums)
    value = F.lit(0).cast("long")
    for i in range(BITS):
        ones = F.shiftrightunsigned(F.col(f"_{i // LANES * LANES}"), i % LANES * LANE).bitwiseAND(F.lit((1 << LANE) - 1))
        value = value.bitwiseOR(F.when(ones * 2 > F.col("total"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "total", value.alias("print"))


def blocks(value: Column) -> Column:
    """(block, value of the block) of a fingerprint: ``RADIUS`` + 1 blocks of nearly equal width."""
    edges = [b * BITS // (RADIUS + 1) for b in range(RADIUS + 2)]
    cut = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("part")) for b, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return F.array(*cut)


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, similarity, start, text_hash): each document and each item that one of its windows repeats.

    ``similarity`` is that of the best window (of the first, if several), ``start`` its first word. Null and empty texts, and
    items of fewer than five words, match nothing; a document shorter than an item is compared as a whole. Repeated rows
    give one result; null ids are kept; other columns are left out; empty tables give no rows.
    """
    items = stored(item_shingles(benchmark, item_col, item_text), "decontamination-items")
    item_rows = items.count()
    found = suspicious(documents, items, item_rows, id_col, text_col)
    cut = stored(windows(documents, found, id_col, text_col), "decontamination-windows")
    spread = cut.select("doc", "text_hash", "size", "start", F.explode_outer("shingles").alias("h"))
    prints = fingerprints(spread, ["doc", "text_hash", "size", "start"])
    marks = fingerprints(items, ["item", "version", "size"], times=F.col("times"))
    left = prints.select("doc", "text_hash", "size", "start", "total", "print", F.explode_outer(blocks(F.col("print"))).alias("b")).select("*", "b.block", "b.part")
    right = marks.select("item", "version", "size", F.col("total").alias("item_total"), F.col("print").alias("item_print"), F.explode_outer(blocks(F.col("print"))).alias("b")).select(
        "item", "version", "size", "item_total", "item_print", "b.block", "b.part"
    )
    near = left.join(maybe_broadcast(right, item_rows, 64), ["size", "block", "part"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = stored(near.select("doc", "text_hash", "size", "start", "total", "item", "version", "item_total").distinct(), "decontamination-pairs")
    spread_pairs = pairs.join(
        cut.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("size").alias("_size"), F.col("start").alias("_start"), "shingles"),
        F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("size") == F.col("_size")) & (F.col("start") == F.col("_start")),
    )
    keys = ["doc", "text_hash", "start", "total", "item", "version", "item_total"]
    counts = spread_pairs.select(*keys, F.explode_outer("shingles").alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("held"))
    theirs = items.select(F.col("item").alias("_item"), F.col("version").alias("_version"), F.col("h").alias("_h"), "times")
    both = counts.join(maybe_broadcast(theirs, item_rows, 48), F.col("item").eqNullSafe(F.col("_item")) & (F.col("version") == F.col("_version")) & (F.col("h") == F.col("_h")))
    shared = both.groupBy(*keys).agg(F.sum(F.least("held", "times")).alias("shared"))
    whole = F.col("total") + F.col("item_total") - F.col("shared")
    similar = shared.filter(F.col("shared") * WHOLE >= whole * NEAR).withColumn("similarity", F.col("shared") / whole)
    best = similar.groupBy("doc", "text_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start"), "text_hash")


def remove_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents that repeat no benchmark item; rows as ``find_leaks`` says."""
    leak_id, leak_hash = fresh(documents, "_leak_id", "_leak_hash")
    leaks = stored(find_leaks(documents, benchmark, id_col, text_col).select(F.col(id_col).alias(leak_id), F.col("text_hash").alias(leak_hash)).distinct(), "leaks")
    few = maybe_broadcast(leaks, leaks.count(), 32)
    return documents.join(few, F.col(id_col).eqNullSafe(F.col(leak_id)) & (F.xxhash64(text_col) == F.col(leak_hash)), "left_anti")
