"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point, so all workers have the same one. An
n-gram is the product (binding) of its letters' vectors, each rotated by its distance from the n-gram's end, so the order
counts. A text is the sum (bundle) of the vectors of all its n-grams; a language's prototype is the sum of its training
texts' bundles, each brought to one length. A text gets the language whose prototype has the highest cosine.

All letters of all texts are read; runs of anything else are one space. Bundles are sums of whole numbers, so results do not
depend on the order in which tasks finish.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import fresh, stored

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
#: Parts of a unit that a training text's direction is kept in.
UNIT = 1 << 20
#: Symbols of a text bundled at once, so that sums of 32-bit floats stay exact.
SLICE = 1 << 20
#: N-gram vectors that a worker remembers, and rows of them multiplied at once.
REMEMBERED, ROWS = 12_000, 4096
#: Languages a task gathers before it hands them on, and prototypes sent to the workers at once (32 MB).
LANGUAGES, BLOCK = 2048, 4096
BRANCHES = 256
SPACE = 32


@lru_cache(maxsize=4096)
def letter_vector(letter: int) -> np.ndarray:
    bits = np.frombuffer(hashlib.shake_256(letter.to_bytes(4, "little")).digest(DIMENSIONS // 8), np.uint8)
    return np.unpackbits(bits).astype(np.int8) * 2 - 1


def gram_vector(letters: tuple[int, ...]) -> np.ndarray:
    """The letters' vectors, rotated by their place before the last, multiplied."""
    out = np.ones(DIMENSIONS, np.int8)
    for back, letter in enumerate(reversed(letters)):
        out = out * np.roll(letter_vector(letter), back)
    return out


@lru_cache(maxsize=1)
def letters_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of the letters in lower case, every run of others as one space, a space at both ends; empty without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = letters_table()[points]
    if not letter.any():
        return points[:0]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, points, SPACE)[keep]


class Bundler:
    """Bundles of texts; remembers the vectors of n-grams."""

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((REMEMBERED, DIMENSIONS), np.float32)

    def places(self, codes: list[int]) -> list[int]:
        rows = self.rows
        if len(rows) + len(codes) > REMEMBERED and any(c not in rows for c in codes):
            rows.clear()
        for code in codes:
            if code not in rows:
                self.vectors[len(rows)] = gram_vector(tuple(code >> (21 * i) & 0x1FFFFF for i in range(GRAM - 1, -1, -1)))
                rows[code] = len(rows)
        return [rows[c] for c in codes]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of a text's n-gram vectors, or nothing where it has no letter."""
        read = symbols(text or "")
        if not len(read):
            return None
        total = np.zeros(DIMENSIONS, np.int64)
        for low in range(0, len(read) - GRAM + 1, SLICE):
            part = read[low : low + SLICE + GRAM - 1].astype(np.int64)
            code = np.zeros(len(part) - GRAM + 1, np.int64)
            for i in range(GRAM):
                code = (code << 21) | part[i : len(part) - GRAM + 1 + i]
            codes, counts = np.unique(code, return_counts=True)
            for a in range(0, len(codes), ROWS):
                at = self.places(codes[a : a + ROWS].tolist())
                total += (counts[a : a + ROWS].astype(np.float32) @ self.vectors[at]).astype(np.int64)
        return total


_bundler: list[Bundler] = []


def bundler() -> Bundler:
    if not _bundler:
        _bundler.append(Bundler())
    return _bundler[0]


def learn(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, vector: binary of 64-bit integers): the prototype of every non-null language, from all rows.

    Each text counts alike, however long; texts without a letter count for nothing. Written to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held, branch = bundler(), {}, TaskContext.get().partitionId() % BRANCHES

        def told() -> pa.RecordBatch:
            vectors = [v.tobytes() for v in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([branch] * len(held), pa.int32()), pa.array(vectors, pa.binary())], names=["lang", "branch", "vector"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tool.bundle(text.as_py())
                size = 0.0 if found is None else float(np.sqrt((found.astype(np.float64) ** 2).sum()))
                if not size:
                    continue
                if lang not in held and len(held) >= LANGUAGES:
                    yield told()
                    held.clear()
                unit = np.rint(found * (UNIT / size)).astype(np.int64)
                held[lang] = held[lang] + unit if lang in held else unit
        if held:
            yield told()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(DIMENSIONS, np.int64)
        for vector in table.column("vector"):
            total += np.frombuffer(vector.as_buffer(), np.int64)
        return table.slice(0, 1).set_column(2, "vector", pa.array([total.tobytes()], pa.binary()))

    schema = "lang string, branch int, vector binary"
    told = documents.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    some = told.groupBy("lang", "branch").applyInArrow(add, schema).withColumn("branch", F.lit(0))
    return stored(some.groupBy("lang").applyInArrow(add, schema).select("lang", "vector"), "prototypes")


def compare(documents: DataFrame, block, id_cols: list[str], text_col: str) -> DataFrame:
    """The best language of one block of prototypes for each row: the id columns, lang_pred, score; und without a letter."""
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, (names, prototypes) = bundler(), block.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(len(id_cols)):
                found = tool.bundle(text.as_py())
                lang, score = UNKNOWN, 0.0
                if found is not None and names:
                    size = np.sqrt((found.astype(np.float64) ** 2).sum())
                    cosine = (prototypes * found).sum(axis=1) / size if size else np.zeros(len(names))
                    best = int(np.argmax(cosine))
                    lang, score = names[best], min(1.0, max(0.0, float(cosine[best])))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(id_cols)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*id_cols, "lang_pred", "score"]
            )

    return documents.select(*id_cols, text_col).mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(documents: DataFrame, prototypes: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = BLOCK) -> DataFrame:
    """The language of every row: the id, lang_pred, score (the cosine, at least 0).

    Ties go to the language whose name sorts first. A text that is null or has no letter is ``und`` with score 0, as is
    every text where nothing was learnt. Repeated rows and null ids are kept, other columns left out; an empty table gives
    no rows. Prototypes go to the workers ``at_once`` at a time, one scan of the documents each.
    """
    spark = documents.sparkSession
    blocks = max(1, -(-prototypes.count() // at_once))
    dealt = prototypes.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)))
    rows, id_cols = documents, [id_col]
    if blocks > 1:
        (row,) = fresh(documents.select(id_col, text_col), "_row")
        rows, id_cols = stored(documents.select(id_col, text_col).withColumn(row, F.monotonically_increasing_id()), "numbered"), [id_col, row]
    parts = []
    for b in range(blocks):
        held = sorted((r.lang, bytes(r.vector)) for r in dealt.filter(F.col("block") == b).collect())
        if not held and blocks > 1:
            continue
        vectors = np.array([np.frombuffer(v, np.int64) for _, v in held], np.float64).reshape(len(held), DIMENSIONS)
        sizes = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        shared = spark.sparkContext.broadcast(([n for n, _ in held], vectors / np.where(sizes > 0, sizes, 1)))
        parts.append(compare(rows, shared, id_cols, text_col))
    if blocks == 1:
        return parts[0]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    best = union.groupBy(*id_cols).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("lang_pred").alias("l"))).alias("best"))
    return best.select(id_col, F.col("best.l").alias("lang_pred"), (-F.col("best.s")).alias("score"))
