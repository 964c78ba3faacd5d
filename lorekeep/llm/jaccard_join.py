"""Exact Jaccard join of documents on word shingles, by T-occurrence search over inverted lists.

A document is the set of hashes of its five-word shingles; documents with equal sets are one class. Two sets of sizes x
and y are linked if their overlap reaches T = ceil(3 (x + y) / 7), that is a similarity of 0.75.

1. A set that has a partner shares at least three quarters of itself with it, so of its smallest 40 percent of hashes a
   known number lie among those of the partner. Hashes are dealt in packed blocks to buckets, which report how many of
   each document's are held by others; documents below the number have no partner and are done. A hash travels once
   per block of documents, however many of them hold it. The same is then asked of all hashes of what is left.
2. The others, the suspects, are listed under the rare quarter of their shingles (frequent ones last): partners meet in a
   list. Each suspect goes to the block of the smallest class it meets most often; a block is searched on its own.
3. Lists that still hold several components show which pairs are open. Such a list belongs to the block of its smallest
   class; all suspects of a block are searched against all others of it, so no pair is left out; large blocks are pairs
   of chunks in many tasks.

The search within a block is DivideSkip: of the query's lists the longest are set aside, the short ones are merged and
counted, and what comes close enough to T is looked up in the long ones by binary search. Only links between
different components are kept, so a group of copies gives as many links as it has members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import WordHashes, runs_of, stored, words
from lorekeep.llm.components import connected

SHINGLE = 5
#: Similarity as a fraction, 75 of 100.
NEAR, WHOLE = 75, 100
#: Hashes in a bucket and in a block of documents of the first step.
BUCKET_HASHES, BLOCK_HASHES = 1_500_000, 1_000_000
#: Shingles of the documents in one block of the search.
CHUNK_SHINGLES = 1_000_000
#: Frequent shingles whose counts are broadcast, 9 bytes each.
FREQUENT = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
#: Lists of more sets are looked up by binary search instead of being merged: a look-up costs as much as so many entries.
LONG_LIST = 2048


def least_overlap(n: int) -> int:
    """Overlap that any partner of a set of n has at least."""
    return -(-NEAR * n // WHOLE)


def spare(n: int) -> int:
    """How far the first step looks beyond the shortest prefix that must meet a partner's."""
    return -(-15 * n // 100)


def reaches(overlap, x, y):
    """Whether sets of x and y elements with this overlap are linked."""
    return WHOLE * overlap >= NEAR * (x + y - overlap)


def shingle_set(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    return _distinct(runs_of(known.of(words(text)), SHINGLE))


def class_of(shingles: np.ndarray) -> int:
    """64-bit hash of a set; equal sets, and with a chance of 2^-64 a pair others, have equal classes."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


class Block:
    """Documents of one map task whose hashes are sent to the buckets together."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int]] = []  # id, whether there is one, size, class, number among the senders
        self.hashes: list[np.ndarray] = []
        self.seen: set[int] = set()
        self.held = 0

    def add(self, doc: int | None, s: np.ndarray, part: int, cls: int) -> None:
        """A copy within the block, or a set without elements, sends nothing."""
        number = -1
        if len(s) and cls not in self.seen:
            self.seen.add(cls)
            number = len(self.hashes)
            self.hashes.append(s[:part])
            self.held += part
        self.rows.append((doc or 0, doc is not None, len(s), cls, number))

    def full(self) -> bool:
        return self.held >= BLOCK_HASHES or len(self.rows) >= 60_000

    def send(self, key: int, buckets: int) -> pa.RecordBatch:
        """A row per bucket that gets any hashes, and one with the documents that some bucket passes on."""
        count = len(self.hashes)
        at = np.repeat(np.arange(count), [len(p) for p in self.hashes])
        h = np.concatenate([np.empty(0, np.uint64), *self.hashes])
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.append(True, h[1:] != h[:-1])[: len(h)]
        alone = first & np.append(first[1:], True)[: len(h)]
        local = np.bincount(at[~alone], minlength=count)
        # a hash of several documents here is sent once, as nobody's: it is shared already
        sent, owner = h[first], np.where(alone[first], at[first], count).astype(np.uint16)
        edges = np.searchsorted(sent, np.array([i * (1 << 64) // buckets for i in range(buckets)], dtype=np.uint64))
        filled = np.flatnonzero(np.diff(np.append(edges, len(sent))))
        parts = [slice(edges[i], edges[i + 1] if i + 1 < buckets else len(sent)) for i in filled]
        doc, has, n, cls, number = np.array(self.rows, dtype=np.int64).reshape(-1, 5).T
        told = np.stack([doc, has, n, cls, number, np.where(number >= 0, np.append(local, 0)[number], 0)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(filled, key % buckets).astype(np.int32)),
                pa.array(np.full(len(parts) + 1, key)),
                pa.array([*(sent[p].tobytes() for p in parts), told.tobytes()], pa.binary()),
                pa.array([*(owner[p].tobytes() for p in parts), None], pa.binary()),
            ],
            names=["bucket", "block", "hashes", "owners"],
        )


def count_shared(dealt: DataFrame) -> DataFrame:
    """Blocks in buckets -> (doc, cls, n, shared): how many of the hashes that a document sent others sent too.

    A bucket answers each block with one packed row, if it has anything to tell. Rows that sent nothing (copies within a
    block, empty sets) have a null ``shared``.
    """

    def count(key: tuple, table: pa.Table) -> pa.Table:
        answers: list[tuple[int, bytes | None, bytes | None]] = []
        parts = []
        for block, h, owner in zip(*(table.column(c).to_pylist() for c in ("block", "hashes", "owners"))):
            if owner is None:
                answers.append((block, h, None))
            else:
                parts.append((block, np.frombuffer(h, np.uint64), np.frombuffer(owner, np.uint16)))
        if parts:
            every = np.concatenate([h for _, h, _ in parts])
            every.sort()
            twice = _distinct(every[1:][every[1:] == every[:-1]])
            del every
            for block, h, owner in parts:
                n = np.bincount(owner[_among(h, twice)])
                at = np.flatnonzero(n)
                if len(at):
                    answers.append((block, None, np.stack([at, n[at]]).astype(np.int32).tobytes()))
        block, told, counts = zip(*answers) if answers else ((), (), ())
        return pa.table({"block": pa.array(block, pa.int64()), "told": pa.array(told, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        told = next(t for t in table.column("told").to_pylist() if t is not None)
        doc, has, n, cls, number, local = np.frombuffer(told, np.int64).reshape(6, -1)
        # the last place counts what the block sent as nobody's
        shared = np.zeros(number.max() + 2, np.int64)
        for packed in table.column("counts").to_pylist():
            if packed is not None:
                at, more = np.frombuffer(packed, np.int32).reshape(2, -1)
                shared[at] += more
        return pa.table(
            {
                "doc": pa.array(doc, mask=has != 1),
                "cls": pa.array(cls, mask=n == 0),
                "n": pa.array(n),
                "shared": pa.array(local + shared[number], mask=number < 0),
            }
        )

    counted = dealt.groupBy("bucket").applyInArrow(count, "block long, told binary, counts binary")
    return counted.groupBy("block").applyInArrow(total, "doc long, cls long, n long, shared long")


def document_sets(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, cls, n, shared) for each row; ``shared`` counts within the longer prefixes. cls is null for an empty set."""
    characters = documents.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    buckets = max(1, -(-characters // 15 // BUCKET_HASHES))  # a word takes about six characters, the prefix is 0.4

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, number = WordHashes(), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                s = shingle_set(text.as_py() or b"", known)
                block.add(doc, s, len(s) - least_overlap(len(s)) + spare(len(s)), class_of(s))
                if block.full():
                    yield block.send(number, buckets)
                    block, number = Block(), number + 1
        if block.rows:
            yield block.send(number, buckets)

    return count_shared(documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(deal, "bucket int, block long, hashes binary, owners binary"))


def refine(sets: DataFrame) -> DataFrame:
    """The packed sets three quarters of whose hashes occur in others of them."""
    buckets = max(1, -(-sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET_HASHES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for cls, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(packed, np.uint64)
                block.add(cls, s, len(s), cls)
                if block.full():
                    yield block.send(number, buckets)
                    block, number = Block(), number + 1
        if block.rows:
            yield block.send(number, buckets)

    counted = count_shared(sets.select("cls", "shingles").mapInArrow(deal, "bucket int, block long, hashes binary, owners binary"))
    left = stored(counted.filter(F.col("shared") >= F.ceil(F.col("n") * NEAR / WHOLE)).select(F.col("cls").alias("_cls")), "refined")
    return stored(sets.join(left, F.col("cls") == F.col("_cls"), "left_semi"), "suspects")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def suspect_sets(documents: DataFrame, suspects: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, rep, n, shingles: packed sorted hashes) of the suspects (cls, rep), one row each."""
    few = suspects.count() * 24 <= BROADCAST_BYTES
    wanted = suspects.select(F.col("rep").alias("_rep"), F.col("cls").alias("_cls"))
    found = documents.select(F.col(id_col).cast("long").alias("_doc"), text_col).join(F.broadcast(wanted) if few else wanted, F.col("_doc") == F.col("_rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", known) for t in batch.column(2).cast(pa.binary())]
            right = [i for i, (s, c) in enumerate(zip(sets, batch.column(1).to_pylist())) if class_of(s) == c]
            at = pa.array(right, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), batch.column(0).take(at), pa.array([len(sets[i]) for i in right], pa.int64()), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                names=["cls", "rep", "n", "shingles"],
            )

    packed = found.select("_rep", "_cls", text_col).mapInArrow(run, "cls long, rep long, n long, shingles binary")
    return stored(packed.groupBy("cls").agg(F.min("rep").alias("rep"), F.min("n").alias("n"), F.first("shingles").alias("shingles")), "suspects")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, level of their count) of the most frequent shingles of the suspects, at most ``FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(s, np.uint64) for s in batch.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    counts = stored(sets.select("shingles").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c >= 8"), "frequent")
    bins = counts.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("bin")).count().collect()
    total, least = 0, 1 << 30
    for row in sorted(bins, key=lambda r: -r["bin"]):
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["bin"]
    top = counts.withColumn("bin", F.floor(F.log2("c") * 4).cast("int")).filter(F.col("bin") >= least).select("h", "bin").toArrow()
    if not top.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    h, level = np.asarray(top.column(0).combine_chunks()).view(np.uint64), np.asarray(top.column(1).combine_chunks())
    order = np.argsort(h)
    return h[order], level[order]


def list_under(sets: DataFrame, frequent) -> DataFrame:
    """(h, cls): each suspect under the shingles of its prefix, frequent ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = frequent.value
        for batch in batches:
            hs, at = [], []
            for i, packed in enumerate(batch.column(1).to_pylist()):
                s = np.frombuffer(packed, np.uint64)
                n = len(s)
                rank = np.zeros(n, np.int32)
                hit = _among(s, common)
                rank[hit] = level[np.searchsorted(common, s[hit])]
                hs.append(s[np.lexsort((s, rank))[: n - least_overlap(n) + 1]])
                at.append(np.full(len(hs[-1]), i))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(at)))], names=["h", "cls"])

    return sets.select("cls", "shingles").mapInArrow(run, "h long, cls long")


class InvertedLists:
    """Inverted lists over the sets of one block. Lists of a single set are left out: they hold no partner."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        h = np.concatenate([np.empty(0, np.uint64), *sets])
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(h, kind="stable")
        self.docs = doc[order]
        first = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
        self.starts = np.flatnonzero(first)
        self.lengths = np.diff(np.append(self.starts, len(h)))
        # the list of each element of each set, in the sets' own order
        self.list_of = np.empty(len(h), np.int64)
        self.list_of[order] = np.cumsum(first) - 1
        self.bounds = np.append(0, np.cumsum(self.sizes))

    def partners(self, q: int) -> np.ndarray:
        """Numbers of the sets that reach the needed overlap with set ``q``, its own included."""
        n = int(self.sizes[q])
        least = least_overlap(n)
        lists = self.list_of[self.bounds[q] : self.bounds[q + 1]]
        lists = lists[self.lengths[lists] > 1]
        if len(lists) < least:
            return np.array([q])
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        aside = min(least - 1, int((self.lengths[lists] > LONG_LIST).sum()))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        # merge the short lists: gather them and count each set
        lengths = self.lengths[short]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[short] - (ends - lengths), lengths)
        merged = np.bincount(self.docs[at], minlength=len(self.sizes))
        found = np.flatnonzero((merged >= least - aside) & (WHOLE * self.sizes >= NEAR * n) & (NEAR * self.sizes <= WHOLE * n))
        counts = merged[found]
        for left, x in zip(range(len(long), 0, -1), long):
            if not len(found):
                break
            row = self.docs[self.starts[x] : self.starts[x] + self.lengths[x]]
            place = np.minimum(np.searchsorted(row, found), len(row) - 1)
            counts = counts + (row[place] == found)
            alive = counts + left - 1 >= np.ceil(NEAR * (n + self.sizes[found]) / (NEAR + WHOLE))
            found, counts = found[alive], counts[alive]
        # elements that only the query holds count for itself
        return np.union1d(found[reaches(counts, n, self.sizes[found])], [q])


def search_block(names: list[int], groups: list[int], index: list[np.ndarray], queries: list[int]) -> list[tuple[int, int]]:
    """Links between different groups found by searching the sets numbered ``queries`` in all of ``index``."""
    parent = {g: g for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    lists, links, apart = InvertedLists(index), [], len(parent)
    for q in queries:
        if apart == 1:
            break
        for c in lists.partners(q).tolist():
            a, b = root(groups[q]), root(groups[c])
            if a != b:
                parent[a] = b
                apart -= 1
                links.append((names[q], names[c]))
    return links


def search_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (block, left, right, own, cls, component) -> links (a, b) by rep.

    A block holds the chunks ``left`` and ``right``; ``own`` is a member's chunk. Members of the left chunk are the queries.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left = key[1].as_py()
        names, groups, own = (table.column(c).to_pylist() for c in ("rep", "component", "own"))
        index = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        links = search_block(names, groups, index, sorted((i for i, o in enumerate(own) if o == left), key=lambda i: (names[i] != min(names), len(index[i]), names[i])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    rows = members.join(sets.select("cls", "rep", "shingles"), "cls")
    return rows.groupBy("block", "left", "right").applyInArrow(run, "a long, b long")


def star_blocks(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Each suspect in the block of the smallest class that it meets in most lists; the smallest is in all its chunks."""
    hubs = stored(lists.groupBy("h").agg(F.min("cls").alias("hub"), F.max("cls").alias("most")).filter("hub < most").select("h", "hub"), "hubs")
    met = lists.join(hubs, "h").filter("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("times"))
    chosen = stored(met.groupBy("cls").agg(F.max_by("hub", F.struct("times", "hub")).alias("block")), "stars")
    weights = stored(chosen.join(sets.select("cls", "n"), "cls").groupBy("block").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks")), "stars-weights")
    dealt = chosen.join(weights, "block").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).select("block", "own", "cls")
    centres = weights.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("own"), F.col("block").alias("cls"))
    return dealt.union(centres).select("block", F.col("own").alias("left"), F.col("own").alias("right"), "own", "cls", F.col("cls").alias("component"))


def open_blocks(lists: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The suspects of lists that hold several components, in blocks by the smallest class of a list, as pairs of chunks.

    Two suspects that share such a list are in the block of its smallest class, so every open pair is in a block.
    """
    marked = stored(lists.join(labels, "cls").select("h", "cls", "component"), "marked")
    several = marked.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("cls").alias("block")).filter("low < high")
    members = stored(marked.join(stored(several.select("h", "block"), "open"), "h").select("block", "cls", "component").distinct(), "open-members")
    weights = stored(members.join(sets.select("cls", "n"), "cls").groupBy("block").agg(F.ceil(2 * F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks")), "open-weights")
    own = F.when(F.col("chunks") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("cls"), F.col("chunks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("chunks") <= 2, F.lit(0)).otherwise(F.col("chunks") - 1)))
    dealt = members.join(weights, "block").withColumn("own", own).withColumn("other", other)
    return dealt.select("block", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "cls", "component")


def join_near(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, its own included) for every document.

    Texts are taken whole, A-Z in lower case. Documents without words have no shingles, no links and their own id. The id
    must be a whole number. Rows with a null id belong to the class of their set: they get its component, or null if no
    row with an id has that set. Rows with one id are one node of the links, each with its own n_shingles. Repeated rows
    give repeated results; other columns are left out; an empty table gives no rows.
    """
    sets = stored(document_sets(documents, id_col, text_col), "sets")
    classes = stored(sets.filter("cls IS NOT NULL AND doc IS NOT NULL").groupBy("cls").agg(F.min("doc").alias("rep"), F.max("n").alias("n")), "classes")
    # a partner shares at least the spare part of the shortest set that can be one
    open_classes = sets.filter(F.col("shared") >= F.ceil(F.ceil(F.col("n") * NEAR / WHOLE) * 15 / 100)).select("cls").distinct()
    wanted = stored(classes.join(open_classes, "cls").select("cls", "rep"), "wanted")
    packed = refine(suspect_sets(documents, wanted, id_col, text_col))
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_shingles(packed))
    lists = stored(list_under(packed, frequent), "lists")
    first = stored(search_blocks(star_blocks(lists, packed), packed), "first-links")
    labels = packed.select("cls", "rep").join(connected(first), F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
    second = stored(search_blocks(open_blocks(lists, packed, labels), packed), "second-links")
    found = stored(connected(first.union(second)), "components")
    joined = stored(classes.select("cls", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("cls").alias("_cls"), F.coalesce("component", "rep").alias("component_id")), "class-components")
    return sets.join(joined, F.col("cls") == F.col("_cls"), "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component_id")
    )
