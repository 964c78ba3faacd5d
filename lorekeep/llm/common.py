"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lorekeep.session import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that ends a word: the space and U+0009 to U+000D. ``bytes.split()`` splits at exactly these.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case (``bytes.lower`` leaves all other letters alone)."""
    return text.lower().split()


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and gives the planner sizes."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go() -> None:
    """Give the memory that a worker no longer uses back to the machine, at the end of a task: workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts in ``column`` have at most ``limit`` bytes, or of one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64).tolist()
        low, held = 0, 0
        for i, size in enumerate(sizes):
            if i > low and held + size > limit:
                yield batch.slice(low, i - low)
                low, held = i, 0
            held += size
        if low < len(sizes):
            yield batch.slice(low)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null becomes empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied between texts when it holds ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a multiply-xorshift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; one for the whole if there are fewer, none if empty."""
    if len(h) == 0:
        return h
    if len(h) < size:
        out = np.full(1, len(h), dtype=np.uint64)
        for x in h:
            out = mixed(out * MIX + x)
        return out
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out *= MIX
        out += h[i : len(h) - size + 1 + i]
    return mixed(out)
