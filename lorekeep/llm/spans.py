"""Removal of passages that occur earlier in the corpus, found by hashing sliding runs of consecutive clauses.

Every run of at least ``RUN`` consecutive clauses and ``LEAST_WORDS`` words is hashed; the smallest document id that holds a run is its first place. A
clause goes if any run over it is repeated and this is not the run's first place. The hashes of a document are made in
a map and written once; sorted over ranges of equal size they tell which places are not the first of their run, and those
places are brought to the texts. The positions of a document are no more than its clauses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import MIX, WordHashes, by_bytes, fresh, let_go, mixed, stored

RUN = 3
#: Runs of fewer words are too common to tell anything; a run goes on until it has so many, unless the text ends.
LEAST_WORDS = 10
#: Sentences are cut into clauses of at most so many words, behind each word whose hash is the smallest of ``CLAUSE``
#: consecutive ones of its sentence. Whether a word is one depends on the words less than ``CLAUSE`` away, so a shared
#: passage has the same clauses up to ``CLAUSE`` - 1 words from its ends, wherever it starts: one of 6 * ``CLAUSE`` - 2
#: words holds three whole ones.
CLAUSE = 8
#: Bytes of text that a task works on together; a longer text is taken alone.
TOGETHER = 4 << 20
#: Rows with null ids are numbered from here.
NULL_IDS = (1 << 63) - 1 - (1 << 53)
#: Places to cut are broadcast up to so many bytes; beyond that the texts are joined with them.
BROADCAST_BYTES = 64 * 1024 * 1024
BOUNDARY = re.compile(rb"[.!?]+\s+|\n\s*|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)\s*")
SPACE = np.zeros(256, dtype=bool)
SPACE[[*range(9, 14), 32]] = True
_known = WordHashes()


def clause_ends(h: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Whether a clause ends behind each word, from the words' hashes and the numbers of their sentences."""
    n = len(h)
    ends = np.ones(n, dtype=bool)
    ends[:-1] = sentence[1:] != sentence[:-1]
    if n < CLAUSE:
        return ends
    windows = n - CLAUSE + 1
    least = h[:windows]
    for i in range(1, CLAUSE):
        least = np.minimum(least, h[i : i + windows])
    # no word has the zero of windows that reach into another sentence
    least = np.where(sentence[CLAUSE - 1 :] == sentence[:windows], least, np.uint64(0))
    most = np.zeros(n, dtype=np.uint64)
    for i in range(CLAUSE):
        np.maximum(most[i : i + windows], least, out=most[i : i + windows])
    return ends | (most == h)


def sentences(text: bytes) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(start, end) of each clause, its hash, its number of words. Clauses cover the text without gaps.

    Hashes are of the words with A-Z in lower case and single spaces. Text without words joins the clause before it, or
    at the start of a text the one behind it.
    """
    if not text:
        return [], np.empty(0, np.uint64), np.empty(0, np.int64)
    stops = np.array([m.end() for m in BOUNDARY.finditer(text)], dtype=np.int64)
    inside = np.zeros(len(text) + 2, dtype=bool)
    inside[1:-1] = ~SPACE[np.frombuffer(text, np.uint8)]
    begins = inside[1:-1] & ~inside[:-2]
    cut = stops[stops < len(text)]
    begins[cut] |= inside[1:-1][cut]
    at = np.flatnonzero(begins)
    if not len(at):
        return [(0, len(text))], mixed(np.zeros(1, np.uint64)), np.zeros(1, np.int64)
    low = text.lower()
    tokens = low.split()
    if len(tokens) != len(at):  # a stop that no space follows ends a word too
        places = at.tolist()
        tokens = [low[s:e].rstrip() for s, e in zip(places, [*places[1:], len(low)])]
    h = _known.of(tokens) | np.uint64(1)
    last = np.flatnonzero(clause_ends(h, np.searchsorted(stops, at, "right")))
    first = np.concatenate([[0], last[:-1] + 1])
    where = [0, *at[first[1:]].tolist(), len(text)]
    counts = last + 1 - first
    return list(zip(where[:-1], where[1:])), folded(h, first, last + 1), counts


def folded(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash of each run of hashes: a polynomial, from a difference of prefix sums brought back to the run's start."""
    n = len(h)
    power, prefix = np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    power[1:] = np.cumprod(np.full(n, MIX))
    prefix[1:] = np.cumsum(mixed(h) * power[:n])
    return mixed((prefix[end] - prefix[start]) * inverse_powers(n)[start] + (end - start).astype(np.uint64))


def runs(hashes: np.ndarray, counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, start, end) of each run.

    From each clause the shortest run of at least ``run`` clauses and ``LEAST_WORDS`` words, then the shortest such
    run that ends the text; a text with less is one run.
    """
    n = len(hashes)
    if not n or not counts.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(n)
    end = np.maximum(start + run, np.searchsorted(total, total[:-1] + LEAST_WORDS))
    start, end = start[end <= n], end[end <= n]
    tail = max(0, min(n - run, int(np.searchsorted(total, total[-1] - LEAST_WORDS, "right")) - 1))
    if not len(start) or end[-1] < n or start[-1] != tail:
        start, end = np.append(start, tail), np.append(end, n)
    h = folded(hashes, start, end)
    check = (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)).astype(np.int32)
    return h, check, start, end


INVERSE = np.uint64(pow(int(MIX), -1, 1 << 64))


def inverse_powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), INVERSE))])


def first_in_text(h: np.ndarray) -> np.ndarray:
    """Whether each hash is the first of its value."""
    out = np.zeros(len(h), dtype=bool)
    out[np.unique(h, return_index=True)[1]] = True
    return out


RUNS = "h long, c int, number int, _id long, _text_hash long"


def later_places(spans: DataFrame) -> DataFrame:
    """The rows of ``spans`` whose run has a smaller ``_id`` somewhere.

    Runs are sorted over ranges of equal row counts, by id within a run, so a run that a third of all documents hold is
    many ranges. A range knows the first place of every run that begins in it; for the one run that may have begun before,
    the ranges' last runs tell, one row each.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, ids = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            if last is None:
                last = (h[0], c[0], ids[0])
            new = np.empty(len(h), dtype=bool)
            new[0] = (h[0], c[0]) != last[:2]
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            first = np.where(at >= 0, ids[at], last[2])
            edge = head & (at < 0)
            head = bool(edge[-1])
            last = (h[-1], c[-1], first[-1])
            keep = np.flatnonzero((ids > first) | edge)
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first[keep]), pa.array(edge[keep].astype(np.int32))], names=MARKED)
        if last is not None:
            one = [last[0], last[1], 0, last[2], 0, last[2], 2]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], t) for x, t in zip(one, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=MARKED)

    placed = spans.repartitionByRange("h", "c", "_id").sortWithinPartitions("h", "c", "_id")
    marked = stored(placed.mapInArrow(mark, RUNS + ", first long, edge int"), "marked")
    begun = marked.filter("edge = 2").groupBy("h", "c").agg(F.min("first").alias("before"))  # a row a range at most
    heads = marked.filter("edge = 1").join(F.broadcast(begun), ["h", "c"]).filter("_id > before").select("number", "_id", "_text_hash")
    return marked.filter("edge = 0").select("number", "_id", "_text_hash").unionByName(heads)


MARKED = ["h", "c", "number", "_id", "_text_hash", "first", "edge"]


def remove_repeats(documents: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` with repeated passages cut out of the text, plus n_sentences and n_removed.

    The id must be a whole number. The first place of a passage is the smallest id, and in a text its first position;
    rows with null ids come last, each a document of its own in the order of the input files (an id less than 2^53 below
    the largest whole number comes among them); rows with one id are one document as to order, so what they share stays.
    Repeated rows with an id get the same result. Null texts stay null, empty ones empty (no clause); a text all of whose
    clauses go becomes empty. n_sentences and n_removed count clauses. Input columns n_sentences and n_removed are replaced. An empty table gives no rows.
    """
    columns = [c for c in documents.columns if c not in ("n_sentences", "n_removed")]
    own_id, own_hash, own_numbers = fresh(documents, "_id", "_text_hash", "_numbers")
    key = F.col(id_col).cast("long")
    # written once, so that every later scan sees the same numbers
    unnamed = stored(documents.filter(key.isNull()).select(*columns, (F.monotonically_increasing_id() + NULL_IDS).alias(own_id)), "null-ids")
    named = documents.filter(key.isNotNull()).select(*columns, key.alias(own_id))
    rows = named.union(unnamed).select(*columns, own_id, F.xxhash64(text_col).alias(own_hash))

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, TOGETHER):
            hs, cs, ps, at = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                _, hashes, counts = sentences(text.as_py() or b"")
                h, c, _, _ = runs(hashes, counts, run)
                new = first_in_text(h)
                hs.append(h[new])
                cs.append(c[new])
                ps.append(np.flatnonzero(new))
                at.append(np.full(int(new.sum()), i))
            if not hs:
                continue
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ps).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)],
                names=["h", "c", "number", "_id", "_text_hash"],
            )
        _known.clear()
        let_go()

    spans = stored(rows.select(own_id, own_hash, text_col).mapInArrow(hash_runs, RUNS), "runs")
    later = later_places(spans)
    numbers = stored(later.groupBy(F.col("_id").alias(own_id), F.col("_text_hash").alias(own_hash)).agg(F.collect_set("number").alias(own_numbers)), "numbers")
    if numbers.agg(F.coalesce(F.sum(F.size(own_numbers) * 4 + 40), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        numbers = F.broadcast(numbers)
    joined = rows.join(numbers, [own_id, own_hash], "left").select(*columns, own_numbers)
    text_at = columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_at, TOGETHER):
            texts, totals, removed = [], [], []
            for text, found in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(len(columns)).to_pylist()):
                spans_, hashes, counts = sentences(text or b"")
                h, _, start, end = runs(hashes, counts, run)
                totals.append(len(spans_))
                out = ~first_in_text(h)
                out[found or []] = True
                if not out.any():
                    texts.append(text)
                    removed.append(0)
                    continue
                size = len(spans_) + 1
                over = np.cumsum(np.bincount(start[out], minlength=size) - np.bincount(end[out], minlength=size))[:-1] > 0
                texts.append(b"".join(text[s:e] for (s, e), x in zip(spans_, over.tolist()) if not x))
                removed.append(int(over.sum()))
            arrays = [batch.column(i) for i in range(len(columns))]
            if any(removed):
                arrays[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, "n_sentences", "n_removed"])
        _known.clear()
        let_go()

    schema = documents.select(*columns).schema.add("n_sentences", "long").add("n_removed", "long")
    return joined.mapInArrow(cut, schema)
