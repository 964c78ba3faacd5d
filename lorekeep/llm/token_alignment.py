"""Alignment of two tokenizers over a corpus: which ids cover the same bytes, and in how many documents.

Texts are tokenized once; the ids are written to the shared folder. Both token sequences of a text spell the same bytes. Cutting the text where either has a token end gives segments, and
each segment is one link of the token of A and the token of B that cover it. A first pass over the documents gathers the
distinct linked pairs. A minimal perfect hash numbers them, so counts are dense vectors without keys: tasks count into
vectors of their own, the vectors are summed in a tree, and a second pass aligns the documents again and looks each pair
up by its number, checked against the key kept there.

The hash and the counts go to the workers in rounds of bounded bytes, cut by the id of A so that the highest count of an
id is found within its round. Rounds are bounded by the two vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import fresh, stored
from lorekeep.llm.perfect_hash import PerfectHash, build_shard

#: Tokens that are aligned at once; a longer text is taken alone.
SLICE = 1 << 18
#: Linked pairs that a worker gathers before it hands them on.
HELD = 1 << 20
PAIRS_PER_SHARD = 1 << 15
#: Bytes of hash, keys and counts sent to the workers at once, and what a pair takes of them.
ROUND_BYTES, PAIR_BYTES = 96 << 20, 16
#: Tasks that count, and vectors summed by one task of the tree.
BRANCHES, FAN_IN, CHUNK = 64, 8, 1 << 16


@dataclass(frozen=True)
class Vocabularies:
    """Files that every worker can read: a byte-level BPE (with the pattern that splits its texts) and a sentence piece model."""

    byte_level: str
    pattern: str
    pieces: str


class Tokenizers:
    """A: byte-level BPE of a space and the text. B: sentence pieces of the text, which begin with a space of their own."""

    def __init__(self, names: Vocabularies):
        import sentencepiece
        import tiktoken

        with open(names.byte_level, encoding="utf-8") as file:
            read = json.load(file)
        special = {t["content"] for t in read["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        spelt = {bytes(letters[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("byte-level", pat_str=names.pattern, mergeable_ranks=spelt, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=names.pieces)
        self.a_bytes = [b""] * (max(spelt.values()) + 1)
        for token, i in spelt.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        #: Ids take 16 bits where both vocabularies fit.
        self.id_type = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        self.a_text = written(len(self.a_bytes))
        self.b_text = written(len(self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both as ``id_type``, or none where a tokenizer does not spell the text."""
        if not text:
            return b"", b""
        a, b, spelt = self.a.encode_ordinary(" " + text), self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelt or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            return b"", b""
        return np.array(a, self.id_type).tobytes(), np.array(b, self.id_type).tobytes()


def written(n: int) -> np.ndarray:
    """Each id in decimal, with each of the three marks that can follow it: ``,`` ``|`` ``;``."""
    out = np.empty((3, n), object)
    for k, mark in enumerate((b",", b"|", b";")):
        out[k] = [str(i).encode() + mark for i in range(n)]
    return out


_loaded: dict[Vocabularies, Tokenizers] = {}


def tokenizers(names: Vocabularies) -> Tokenizers:
    if names not in _loaded:
        _loaded[names] = Tokenizers(names)
    return _loaded[names]


class Aligned:
    """The alignment of several texts. Byte offsets run on from one text to the next."""

    def __init__(self, tools: Tokenizers, a: list[bytes], b: list[bytes]):
        self.tools = tools
        size, kind = tools.id_type.itemsize, tools.id_type
        self.n_a = np.array([len(x) // size for x in a], np.int64)
        self.n_b = np.array([len(x) // size for x in b], np.int64)
        self.a = np.frombuffer(b"".join(a), kind).astype(np.int64)
        self.b = np.frombuffer(b"".join(b), kind).astype(np.int64)
        self.a_end, self.b_end = np.cumsum(tools.a_size[self.a]), np.cumsum(tools.b_size[self.b])
        cuts = np.concatenate([self.a_end, self.b_end])
        cuts.sort(kind="stable")
        first = np.ones(len(cuts), bool)
        first[1:] = cuts[1:] != cuts[:-1]
        cuts = cuts[first]
        #: Of each link, the place of its tokens in ``a`` and ``b``.
        self.link_a, self.link_b = np.searchsorted(self.a_end, cuts), np.searchsorted(self.b_end, cuts)
        self.both = (self.a_end[self.link_a] == cuts) & (self.b_end[self.link_b] == cuts)
        a_until = np.concatenate([[0], np.cumsum(self.n_a)])
        #: Where the links of each text begin; a text's first token of A begins its first link.
        self.until = np.searchsorted(self.link_a, a_until)
        groups = np.concatenate([[0], np.cumsum(self.both)])
        self.n_groups = groups[self.until[1:]] - groups[self.until[:-1]]
        self.n_links = np.diff(self.until)

    def pairs(self) -> np.ndarray:
        """Of each link, id of A times the number of ids of B plus id of B."""
        return self.a[self.link_a] * len(self.tools.b_bytes) + self.b[self.link_b]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over the links of each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.until[1:]] - total[self.until[:-1]]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups; empty without tokens."""
        ends = np.flatnonzero(self.both)
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[self.link_a[ends]], b_last[self.link_b[ends]] = True, True
        a_group = np.cumsum(a_last) - a_last
        b_group = np.cumsum(b_last) - b_last
        b_before = np.concatenate([[0], np.flatnonzero(b_last) + 1])  # tokens of B before each group
        a_through = np.flatnonzero(a_last) + 1  # tokens of A up to the end of each group
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + b_before[a_group]] = self.tools.a_text[a_last.astype(int), self.a]
        if len(self.b):
            out[np.arange(len(self.b)) + a_through[b_group]] = self.tools.b_text[b_last * 2, self.b]
        until = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        said = out.tolist()
        return [hashlib.sha256(b"".join(said[lo:hi])[:-1]).hexdigest() if hi > lo else "" for lo, hi in zip(until[:-1], until[1:])]


def tokens(documents: DataFrame, names: Vocabularies, id_col: str, text_col: str) -> DataFrame:
    """(id, row, a, b) of every row, written to the shared folder; ``row`` tells repeated and null ids apart."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(names)
        for batch in batches:
            low, held, a, b = 0, 0, [], []
            for i, text in enumerate(batch.column(2)):
                both = tools.encode(text.as_py())
                a.append(both[0])
                b.append(both[1])
                held += len(both[0])
                if held > SLICE * tools.id_type.itemsize or i == batch.num_rows - 1:
                    part = batch.slice(low, i + 1 - low)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=[id_col, row, "a_ids", "b_ids"])
                    low, held, a, b = i + 1, 0, [], []

    (row,) = fresh(documents.select(id_col), "row")
    numbered = documents.select(id_col, F.monotonically_increasing_id().alias(row), text_col)
    return stored(numbered.mapInArrow(run, f"`{id_col}` {id_type}, `{row}` long, a_ids binary, b_ids binary"), "tokens")


def aligned(tools: Tokenizers, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Aligned]]:
    """The alignment of rows whose last two columns are the ids, in runs of at most ``SLICE`` tokens or of one row."""
    columns = batch.columns[-2:]
    sizes = np.asarray(pc.binary_length(columns[0])) // tools.id_type.itemsize
    low, held = 0, 0
    for i, size in enumerate([*sizes.tolist(), SLICE + 1]):
        if i > low and (held + size > SLICE or i == batch.num_rows):
            yield low, i, Aligned(tools, *(c.slice(low, i - low).to_pylist() for c in columns))
            low, held = i, 0
        held += size


def linked_pairs(tokenized: DataFrame, names: Vocabularies, held: int = HELD) -> DataFrame:
    """(pair, docs): partial counts of the documents that hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, parts, weights = tokenizers(names), [], []
        space = len(tools.a_bytes) * len(tools.b_bytes)

        def merged(last: bool) -> Iterator[pa.RecordBatch]:
            pairs, where = np.unique(np.concatenate(parts), return_inverse=True)
            docs = np.bincount(where, weights=np.concatenate(weights)).astype(np.int64)
            parts[:], weights[:] = [pairs], [docs]
            if last or len(pairs) > held:
                parts.clear(), weights.clear()
                for a in range(0, len(pairs), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + (1 << 17)]), pa.array(docs[a : a + (1 << 17)])], names=["pair", "docs"])

        for batch in batches:
            for low, high, found in aligned(tools, batch):
                document = np.repeat(np.arange(high - low), found.n_links)
                once = np.unique(document * space + found.pairs()) % space
                pairs, docs = np.unique(once, return_counts=True)
                parts.append(pairs)
                weights.append(docs)
                if sum(map(len, parts)) > 2 * held:
                    yield from merged(False)
        if parts:
            yield from merged(True)

    return tokenized.select("a_ids", "b_ids").mapInArrow(run, "pair long, docs long")


def tree_sum(vectors: DataFrame, branches: int, fan_in: int = FAN_IN) -> DataFrame:
    """Sum (chunk, branch, vector) over branches, ``fan_in`` at a time, until there is one vector per chunk."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for vector in table.column("vector"):
            one = np.frombuffer(vector.as_buffer(), np.int64)
            total = one.copy() if total is None else total + one
        return table.slice(0, 1).set_column(2, "vector", pa.array([total.tobytes()], pa.binary()))

    while branches > 1:
        branches = -(-branches // fan_in)
        grouped = vectors.withColumn("branch", F.expr(f"branch div {fan_in}").cast("int")).groupBy("chunk", "branch")
        vectors = grouped.applyInArrow(add, "chunk int, branch int, vector binary")
    return vectors


def dense_counts(pairs: DataFrame, shared, width: int, branches: int = BRANCHES, fan_in: int = FAN_IN) -> np.ndarray:
    """Number of documents of each pair of a round, by its index in the perfect hash ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: PerfectHash = shared.value
        vector = np.zeros(len(lookup), np.int64)
        for batch in batches:
            pair, docs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            at = lookup.index(pair, pair // width % lookup.shards)
            np.add.at(vector, at[at >= 0], docs[at >= 0])
        branch = TaskContext.get().partitionId()
        for chunk, low in enumerate(range(0, len(vector), CHUNK)):
            part = vector[low : low + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([branch], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "branch", "vector"])

    few = pairs.coalesce(branches)
    sums = tree_sum(few.mapInArrow(run, "chunk int, branch int, vector binary"), branches, fan_in).toArrow()
    out = np.zeros(len(shared.value), np.int64)
    for chunk, vector in zip(sums.column("chunk").to_pylist(), sums.column("vector").to_pylist()):
        out[chunk * CHUNK : chunk * CHUNK + len(vector) // 8] = np.frombuffer(vector, np.int64)
    return out


@dataclass
class Counts:
    """A round's pairs: their perfect hash, the documents of each, and the highest count of each id of A."""

    lookup: PerfectHash
    docs: np.ndarray
    best: np.ndarray


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def look_up(tokenized: DataFrame, names: Vocabularies, counts, complete: bool) -> DataFrame:
    """Align again and sum the counts of this round's links. In a ``complete`` round a pair without a count is an error."""
    id_cols = tokenized.columns[:2]
    schema = ", ".join(f"`{c}` {tokenized.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, round_ = tokenizers(names), counts.value
        for batch in batches:
            for low, high, found in aligned(tools, batch):
                pair = found.pairs()
                a = pair // len(tools.b_bytes)
                at = round_.lookup.index(pair, a % round_.lookup.shards)
                if complete and (at < 0).any():
                    raise RuntimeError("a linked pair of the second pass is none of the first: the documents have changed between them")
                docs = np.where(at >= 0, round_.docs[at], 0) if len(round_.docs) else np.zeros(len(at), np.int64)
                best = (at >= 0) & (docs == round_.best[a])
                sums = [found.n_a, found.n_b, found.n_groups, found.n_links, found.sums(best.astype(np.int64)), found.sums(docs)]
                ids = [batch.column(i).slice(low, high - low) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(s, pa.int64()) for s in sums], pa.array(found.digests(), pa.string())], names=[*id_cols, *[f.split()[0] for f in RESULT.split(", ")]])

    return tokenized.mapInArrow(run, f"{schema}, {RESULT}")


def align(documents: DataFrame, names: Vocabularies, id_col: str = "doc_id", text_col: str = "text", round_bytes: int = ROUND_BYTES, per_shard: int = PAIRS_PER_SHARD) -> DataFrame:
    """Align both tokenizers on every document and count its links over the corpus.

    Returns per row: the id, n_a, n_b (tokens), n_groups (cuts where tokens of both end), n_links, n_best (links whose pair is
    in as many documents as any pair of its id of A), count_sum (over links, the documents that hold the pair), and
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``). Texts that are null, empty or spelt otherwise by a tokenizer have zeros and an
    empty digest. Repeated rows are documents of their own, null ids are kept, other columns are left out; an empty table
    gives no rows. One pass over the ids gathers the pairs, one more for each ``round_bytes`` of distinct pairs looks them up.
    """
    spark = documents.sparkSession
    width = len(tokenizers(names).b_bytes)
    tokenized = tokens(documents, names, id_col, text_col)
    pairs = stored(linked_pairs(tokenized, names), "linked-pairs")
    distinct = stored(pairs.select("pair").distinct(), "pairs")
    n = distinct.count()
    shards = max(1, -(-n // per_shard))
    rounds = max(1, min(shards, -(-n * PAIR_BYTES // round_bytes)))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        sizes, bits, keys = build_shard(np.asarray(table.column("pair")))
        return pa.table({"shard": key[0].cast(pa.int32()).as_py() * np.ones(1, np.int32), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([keys], pa.binary())})

    sharded = distinct.withColumn("shard", F.expr(f"cast(pair div {width} % {shards} AS int)"))
    hashes = stored(sharded.groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, keys binary"), "hashes")
    parts = []
    for r in range(rounds):
        built = [(b.shard, b.sizes, bytes(b.bits), bytes(b.keys)) for b in hashes.filter(F.col("shard") % rounds == r).collect()]
        lookup = PerfectHash.of(shards, built)
        shared = spark.sparkContext.broadcast(lookup)
        docs = dense_counts(pairs, shared, width)
        best = np.zeros(len(tokenizers(names).a_bytes), np.int64)
        np.maximum.at(best, lookup.keys // width, docs)
        shared.unpersist()
        parts.append(look_up(tokenized, names, spark.sparkContext.broadcast(Counts(lookup, docs, best)), rounds == 1))
    id_cols = tokenized.columns[:2]
    if rounds == 1:
        return parts[0].drop(id_cols[1])
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    same = [F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    total = union.groupBy(*id_cols).agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return total.drop(id_cols[1])
