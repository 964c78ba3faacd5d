"""Language-model scores from n-gram counts held in a log-frequency Bloom filter.

Counts are quantised on a logarithmic scale; a count of level j is stored as the j items (n-gram, 1) .. (n-gram, j).
Reading probes (n-gram, 1), (n-gram, 2), .. until one is missing, so errors only ever raise a count, and seldom far.

The model is a bigram model with absolute discounting by one, which needs no singletons::

    P(w | h) = (c(hw) - 1)+ / c(h) + (1 - K(h) / c(h)) P1(w)        K(h) = sum over w of (c(hw) - 1)+
    P1(w)    = (c(w) + 1) / (N + V + 1)

The filter holds c(w), K(h) and c(hw) - 1 where they are positive. Its size follows the corpus. It is made in shards of
fixed size, one group each, kept in the shared folder, and broadcast; where it is larger than ``FILTER_BYTES`` it goes out in
parts. The texts are read once all the same: a task asks one part after the other about ``PART_TEXT`` bytes of text and holds
one at a time, with the same result.

The unigram baseline takes exact counts: those of the ``HOT_WORDS`` most frequent words are broadcast, the others joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import MIX, WordHashes, by_bytes, mixed, stored, words

#: Ratio of one level's least count to the next.
BASE = 1.5
#: Bits per stored item and hash functions: a missing item is taken for present in 1 of 200 probes.
ITEM_BITS, HASHES = 12, 5
SHARD_BITS = 1 << 23
FILTER_BYTES = 128 * 1024 * 1024
#: Bytes of text about which a task asks all parts of a larger filter, each loaded again.
PART_TEXT = 12 * 1024 * 1024
#: Words whose exact counts are broadcast, 16 bytes each.
HOT_WORDS = 1_000_000
#: Tokens that a map task counts before it sends the sums on.
FLUSH = 1_000_000
#: A bigram's key: the upper bits of its context's hash, by which K(h) is summed, then bits of the pair's hash.
PAIR_BITS = np.uint64(28)
#: Hashes of the end of a text and of the place before its first word; no word hashes a line feed.
END, START = np.uint64(0x0B5E55ED5EED0001), np.uint64(0x0B5E55ED5EED0002)
#: Kinds of filter entries.
UNIGRAM, KEPT, BIGRAM = np.uint64(0x1D), np.uint64(0x2D), np.uint64(0x3D)


def _thresholds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * BASE)))
    return np.array(out, dtype=np.int64)


THRESHOLDS = _thresholds()
#: The count that a level stands for: the middle of its range, 0 for level 0.
VALUES = np.concatenate([[0.0], (THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def entry(kind: np.uint64, h: np.ndarray) -> np.ndarray:
    return mixed(h ^ (kind * MIX))


def context_key(context: np.ndarray) -> np.ndarray:
    return context >> PAIR_BITS


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context_key(context) << PAIR_BITS | mixed(context * MIX + word) >> np.uint64(64) - PAIR_BITS


def sequences(texts: Iterable[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, tokens per text) of the texts one after the other, each with its end."""
    contexts, tokens, sizes = [], [], []
    for text in texts:
        h = known.of(words(text))
        contexts += [[START], h]
        tokens += [h, [END]]
        sizes.append(len(h) + 1)
    if not sizes:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(contexts).astype(np.uint64), np.concatenate(tokens).astype(np.uint64), np.array(sizes)


def _bits(x: np.ndarray, level: int, i: int, shard_bits: int) -> np.ndarray:
    """Place of hash function ``i`` of (entry, level) in a shard of a power of two of bits."""
    return mixed(x + np.array([level * HASHES + i], dtype=np.uint64) * MIX) & np.uint64(shard_bits - 1)


def fill_shard(entries: np.ndarray, levels: np.ndarray, shard_bits: int) -> bytes:
    shard = np.zeros(shard_bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        x = entries[levels >= level]
        for i in range(HASHES):
            shard[_bits(x, level, i, shard_bits).astype(np.int64)] = True
    return np.packbits(shard, bitorder="little").tobytes()


@dataclass
class FilterPart:
    """Shards ``first`` .. of a filter of ``shards`` shards."""

    shards: int
    first: int
    data: np.ndarray  # shards here x bytes

    @property
    def whole(self) -> bool:
        return len(self.data) == self.shards

    def levels(self, entries: np.ndarray) -> np.ndarray:
        """Level of each entry; 0 for those of other shards."""
        out = np.zeros(len(entries), dtype=np.uint8)
        shard = (entries >> np.uint64(32)) % np.uint64(self.shards)
        alive = np.flatnonzero((shard >= self.first) & (shard < self.first + len(self.data)))
        flat, width = self.data.reshape(-1), np.uint64(self.data.shape[1])
        base = (shard - np.uint64(self.first)) * width
        asked, base = entries[alive], base[alive]
        for level in range(1, len(VALUES)):
            if not len(alive):
                break
            for i in range(HASHES):
                bit = _bits(asked, level, i, 8 * self.data.shape[1])
                byte = flat[(base + (bit >> np.uint64(3))).view(np.int64)]
                hit = (byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    alive, asked, base = alive[hit], asked[hit], base[hit]
            out[alive] = level
        return out


@dataclass
class LanguageModel:
    """tokens: N; types: V; unigrams: table (h, c); filter: table (shard, bits), ``shards`` rows."""

    tokens: int
    types: int
    unigrams: DataFrame
    filter: DataFrame
    shards: int
    shard_bits: int

    def shards_at_once(self, filter_bytes: int) -> int:
        return max(1, filter_bytes * 8 // self.shard_bits)

    def parts(self, filter_bytes: int = FILTER_BYTES) -> Iterator[FilterPart]:
        each = self.shards_at_once(filter_bytes)
        for first in range(0, self.shards, each):
            rows = self.filter.filter(F.col("shard").between(first, first + each - 1)).toArrow()
            data = np.zeros((min(each, self.shards - first), self.shard_bits // 8), dtype=np.uint8)
            for shard, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                data[shard - first] = np.frombuffer(bits, np.uint8)
            yield FilterPart(self.shards, first, data)


def count_ngrams(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind: 1 word, 2 bigram; h; c), summed per task before it is sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            contexts, tokens = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for kind, keys in ((1, tokens), (2, pair(contexts, tokens))):
                h, c = np.unique(keys, return_counts=True)
                for i in range(0, len(h), 100_000):
                    cut = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[cut]), kind, np.int8)), pa.array(h[cut].view(np.int64)), pa.array(c[cut].astype(np.int32))], names=["kind", "h", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.append(sequences([text.as_py() or b""], known)[:2])
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return documents.select(text_col).mapInArrow(run, "kind tinyint, h long, c int")


def train(documents: DataFrame, text_col: str = "text", shard_bits: int = SHARD_BITS) -> LanguageModel:
    """Count the words and bigrams of all whole texts (null: empty) and build the filter. Other columns are not read."""
    counted = count_ngrams(documents, text_col).groupBy("kind", "h").agg(F.sum("c").alias("c"))
    counts = stored(counted.filter("kind = 1 OR c > 1"), "lm-counts")
    unigrams = counts.filter("kind = 1").select("h", "c")
    whole = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))), F.lit(0)).alias("texts")).first()
    bigrams = counts.filter("kind = 2").select("h", (F.col("c") - 1).alias("c"))
    kept = bigrams.groupBy(F.shiftrightunsigned("h", int(PAIR_BITS)).alias("h")).agg(F.sum("c").alias("c"))
    starts = documents.sparkSession.range(1).select(F.lit(int(START.view(np.int64))).alias("h"), F.lit(whole["texts"]).cast("long").alias("c")).filter("c > 0")
    kinds = [(int(UNIGRAM), unigrams.union(starts)), (int(KEPT), kept), (int(BIGRAM), bigrams)]
    items = None
    for kind, rows in kinds:
        tagged = rows.select(F.lit(kind).alias("kind"), "h", "c")
        items = tagged if items is None else items.union(tagged)
    items = stored(items, "lm-items")
    events = items.agg(F.coalesce(F.sum(1 + F.floor(F.log("c") / log(BASE))), F.lit(0))).first()[0]
    shards = max(1, -(-int(events) * ITEM_BITS // shard_bits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, h, c = (np.asarray(batch.column(i)) for i in range(3))
            x = mixed(h.view(np.uint64) ^ (kind.astype(np.uint64) * MIX))
            shard = ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(x.view(np.int64)), pa.array(level_of(c).astype(np.int8))], names=["shard", "x", "level"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        bits = fill_shard(np.asarray(table.column("x")).view(np.uint64), np.asarray(table.column("level")), shard_bits)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    # a group is one shard: its items are bounded by its bits, whatever their counts are
    shard_rows = items.mapInArrow(place, "shard int, x long, level tinyint").groupBy("shard").applyInArrow(build, "shard int, bits binary")
    return LanguageModel(whole["n"], whole["v"], unigrams, stored(shard_rows, "lm-filter"), shards, shard_bits)


def find_levels(part: FilterPart, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Levels of c(w), c(h), K(h) and c(hw) - 1 for each position, 4 x positions.

    Each word is probed once. With the whole filter at hand, a bigram is probed only where its context can keep any.
    """
    n = len(tokens)
    distinct, back = np.unique(np.concatenate([tokens, contexts]), return_inverse=True)
    single = part.levels(entry(UNIGRAM, distinct))[back]
    kept = part.levels(entry(KEPT, context_key(distinct)))[back[n:]]
    ask = np.flatnonzero((kept > 0) & (single[n:] > 1)) if part.whole else np.arange(n)
    both = np.zeros(n, dtype=np.uint8)
    if len(ask):
        pairs, again = np.unique(pair(contexts[ask], tokens[ask]), return_inverse=True)
        both[ask] = part.levels(entry(BIGRAM, pairs))[again]
    return np.stack([single[:n], single[n:], kept, both])


def find_in_parts(parts: Iterable[FilterPart], contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The levels of ``find_levels`` from a filter in several parts, gone through once."""
    n = len(tokens)
    distinct, back = np.unique(np.concatenate([tokens, contexts]), return_inverse=True)
    pairs, again = np.unique(pair(contexts, tokens), return_inverse=True)
    asked = np.concatenate([entry(UNIGRAM, distinct), entry(KEPT, context_key(distinct)), entry(BIGRAM, pairs)])
    found = np.zeros(len(asked), dtype=np.uint8)
    for part in parts:
        np.maximum(found, part.levels(asked), out=found)
    single, kept, both = np.split(found, [len(distinct), 2 * len(distinct)])
    return np.stack([single[back[:n]], single[back[n:]], kept[back[n:]], both[again]])


def loaded(sent: Broadcast) -> FilterPart:
    """A broadcast part, loaded again each time, so that a worker holds one. (With encryption it is there already.)"""
    path = getattr(sent, "_path", None)
    return sent.value if path is None else sent.load_from_path(path)


def log_probability(levels: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """log10 P(w | h) of each position."""
    word, context, kept, both = VALUES[levels]
    single = (word + 1) / (tokens + types + 1)
    kept = np.minimum(kept, np.maximum(context - 1, 0))
    both = np.minimum(both, kept)
    room = np.maximum(context, 1)
    return np.log10(np.minimum(both / room + (1 - kept / room) * single, 1.0))


def hot_count(unigrams: DataFrame, hot_words: int) -> int:
    """A count that at most ``hot_words`` words reach, from a histogram of fixed size."""
    bins = unigrams.groupBy(F.floor(F.log2("c") * 20).cast("int").alias("bin")).agg(F.min("c").alias("least"), F.count("*").alias("n"))
    total, least = 0, (1 << 62)
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        total += row["n"]
        if total > hot_words:
            break
        least = row["least"]
    return least


def score_documents(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, hot_words: int = HOT_WORDS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    ``base_score``: sum of log10((c + 1) / (N + V + 1)) with exact counts; ``score``: the model's log10 probability. A null
    or empty text is its end alone. Repeated rows give repeated results; null ids are kept; other columns are left
    out; an empty table gives no rows; a model of no text knows no words (N = V = 0).
    """
    context = documents.sparkSession.sparkContext
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_key"), F.col(text_col).alias("_text"))
    hot = model.unigrams.filter(F.col("c") >= hot_count(model.unigrams, hot_words)).toArrow()
    keys = np.asarray(hot.column("h").combine_chunks() if hot.num_rows else pa.array([], pa.int64())).view(np.uint64)
    order = np.argsort(keys)
    hot_sent = context.broadcast((keys[order], np.asarray(hot.column("c").combine_chunks() if hot.num_rows else pa.array([], pa.int64()))[order]))
    n, v = model.tokens, model.types
    sent = [context.broadcast(part) for part in model.parts(filter_bytes)]
    counted = rows.mapInArrow(_score(sent, hot_sent, n, v), f"_id {kind}, _key long, word long, times long, n_tokens long, n_known long, base double, score double, copies long")
    rare = model.unigrams.select(F.col("h").alias("_h"), F.col("c").alias("_c"))
    joined = counted.join(rare, F.col("word") == F.col("_h"), "left")
    base = F.col("base") + F.when(F.col("copies") == 0, F.col("times") * F.log10((F.coalesce("_c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).otherwise(0.0)
    known = F.col("n_known") + F.when((F.col("copies") == 0) & F.col("_c").isNotNull(), F.col("times")).otherwise(0)
    sums = joined.groupBy("_id", "_key").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "score", "copies")], F.sum(known).alias("n_known"), F.sum(base).alias("base")
    )
    one = sums.select(
        F.col("_id").alias(id_col),
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    )
    return one.drop("_copy")


def _tally(doc: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, times) of each distinct pair."""
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])])) if len(doc) else np.empty(0, np.int64)
    return doc[first], tokens[first], np.diff(np.append(first, len(doc)))


#: Texts that are scored together, if the filter is in one part.
TOGETHER = 500


def _score(sent: list[Broadcast], hot_sent: Broadcast, n: int, v: int):
    def together(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(sent) > 1:
            return by_bytes([whole], 2, PART_TEXT)
        return (whole.slice(begin, TOGETHER) for begin in range(0, whole.num_rows, TOGETHER))

    def levels_of(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        if len(sent) > 1:
            return find_in_parts(map(loaded, sent), contexts, tokens)
        return find_levels(sent[0].value, contexts, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        keys, counts = hot_sent.value
        logs = np.log10((counts + 1) / float(n + v + 1))
        for whole in batches:
            begin = 0
            for batch in together(whole):
                contexts, tokens, sizes = sequences([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], known)
                levels = levels_of(contexts, tokens)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                score = np.bincount(doc, log_probability(levels, n, v), len(sizes))
                unique, back = np.unique(tokens, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
                found = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
                held = found[back]
                base = np.bincount(doc[held], logs[at[back[held]]], len(sizes))
                n_known = np.bincount(doc[held], minlength=len(sizes))
                rare_docs, rare_words, times = _tally(doc[~held], tokens[~held])
                docs, zeros = np.arange(len(sizes)), np.zeros(len(times))
                ids = pa.array(np.concatenate([docs, rare_docs]))
                # a document's own row goes to a partition of its own choice; no word has its key
                own = mixed(np.uint64(begin) + docs.astype(np.uint64) + np.asarray(batch.column(1)).view(np.uint64))
                begin += batch.num_rows
                columns = [
                    np.concatenate([own, rare_words]).view(np.int64),
                    np.concatenate([np.zeros(len(sizes), np.int64), times]),
                    np.concatenate([sizes, zeros.astype(np.int64)]),
                    np.concatenate([n_known, zeros.astype(np.int64)]),
                    np.concatenate([base, zeros]),
                    np.concatenate([score, zeros]),
                    np.concatenate([np.ones(len(sizes), np.int64), zeros.astype(np.int64)]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(ids), batch.column(1).take(ids), *(pa.array(c) for c in columns)], names=["_id", "_key", "word", "times", "n_tokens", "n_known", "base", "score", "copies"]
                )

    return run
