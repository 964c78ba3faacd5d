"""Exact top-k by integer inner product: every query is scored against every row, one dimension at a time.

Candidates are cut into tiles; a tile keeps, for each dimension, the postings (row, weight) of its non-zero weights.
For each dimension the weight of every query is multiplied into the dense score array of the tile; then each query
keeps its k best of the tile by partial selection, of the partition by merging, and of the table by one aggregation.

Queries go out in blocks of bounded bytes: the query table is cut by a hash of its id, each block is broadcast and
scored against all rows, and the blocks' results are put together. No score leaves the task that made it unless it is
among that partition's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 32 * 1024 * 1024
TILE = 4096
QUERIES_AT_ONCE = 256


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, w: array<bigint>): floor(scale * x) of each component; rows with nulls, NaN or infinities are left out.

    Weights are 64-bit integers: components beyond 2^63 / scale are out of range and clipped.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.col(vector_col).isNotNull() & F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    return df.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("w"))


def _matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by length: length -> (row numbers, rows x length)."""
    lengths = np.asarray(column.value_lengths())
    values, starts = np.asarray(column.values), np.asarray(column.offsets)[:-1]
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = (at, values[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), np.int64))
    return out


def accumulate(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Scores (queries x rows of the tile), one dimension's postings after the other."""
    scores = np.zeros((len(queries), len(tile)), dtype=np.int64)
    for d in range(tile.shape[1]):
        weight, postings = queries[:, d], np.ascontiguousarray(tile[:, d])
        asks, rows = np.flatnonzero(weight), np.flatnonzero(postings)
        if len(rows) * 2 > len(tile) and len(asks) * 2 > len(queries):
            scores += weight[:, None] * postings[None, :]
        elif len(rows) and len(asks):
            scores[np.ix_(asks, rows)] += weight[asks][:, None] * postings[rows][None, :]
    return scores


def best_of(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the rows that can be among its k best: (query number, id, score). Ties at the edge all stay."""
    allowed = ids[None, :] != own[:, None]
    low = np.iinfo(np.int64).min
    held = np.where(allowed, scores, low)
    if held.shape[1] > k:
        edge = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        q, c = np.nonzero(allowed & (held >= edge[:, None]))
    else:
        q, c = np.nonzero(allowed)
    return q, ids[c], held[q, c]


def _keep(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return q[keep], ids[keep], scores[keep]


def _search_block(vectors: DataFrame, block, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = block.value
        held = {n: (np.empty(0, np.int64),) * 3 for n in asks}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for n, (at, rows) in _matrix(batch.column(1)).items():
                if n not in asks:
                    continue
                ask_ids, weights = asks[n]
                for a in range(0, len(at), TILE):
                    tile, tile_ids = rows[a : a + TILE], ids[at[a : a + TILE]]
                    parts = [held[n]]
                    for b in range(0, len(ask_ids), QUERIES_AT_ONCE):
                        q, found, s = best_of(tile_ids, accumulate(weights[b : b + QUERIES_AT_ONCE], tile), ask_ids[b : b + QUERIES_AT_ONCE], k)
                        parts.append((q + b, found, s))
                    held[n] = _keep(*(np.concatenate(x) for x in zip(*parts)), k)
        for n, (q, found, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(asks[n][0][q]), pa.array(found), pa.array(s)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k rows of ``vectors`` with the highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; a query's own id is no candidate; fewer than k rows give fewer. Vectors that are null or
    hold a null or non-finite component take no part; vectors of another length than the query's are no candidates;
    empty vectors score 0. Rows with a null id are left out. Every row is a candidate, repeated rows too; query rows
    with one id are one query, whose hits are merged. Other columns are left out. Empty tables give no rows.
    """
    asks, rows = whole_vectors(queries, id_col, vector_col, scale).distinct(), whole_vectors(vectors, id_col, vector_col, scale)
    size = asks.agg(F.coalesce(F.sum(F.size("w") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for b in range(blocks):
        table = asks.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not table.num_rows:
            continue
        column = table.column("w").combine_chunks()
        ids = np.asarray(table.column("id"))
        packed = {n: (ids[at], w) for n, (at, w) in _matrix(column).items()}
        parts.append(_search_block(rows, vectors.sparkSession.sparkContext.broadcast(packed), k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return merge_best(found, k)


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """k best per query. Each partition sends at most k rows per query, so a group holds k rows per partition."""
    best = T.ArrayType(T.StructType([T.StructField("neg", T.LongType()), T.StructField("vec_id", T.LongType())]))
    ranked = (
        found.groupBy("query_id")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))), 1, k).cast(best).alias("best"))
    )
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score")
    )
