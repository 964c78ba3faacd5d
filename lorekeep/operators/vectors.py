"""The vector table: validation, exact search, listing and deletion. ``site_id`` scopes every operation."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.scale import BROADCAST_BYTES, fits_broadcast

RESERVED_KEY = "_pointId"
CELL_ROWS = 20_000


def vector_errors(dims: int) -> Column:
    """Why a point cannot be stored, or NULL."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        F.when(F.coalesce(F.col("site_id"), F.lit("")) == "", "no site")
        .when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.size("embedding"), F.lit(-1)) != dims, "wrong dimension")
        .when(bad, "not finite")
    )


def validate_vectors(points: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with ``reason``). A payload column named like the reserved key is refused outright."""
    if RESERVED_KEY in points.columns:
        raise ValueError(f"payload key {RESERVED_KEY} is reserved")
    checked = points.withColumn("reason", vector_errors(dims))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def payload_filter(df: DataFrame, equals: dict | None) -> DataFrame:
    """AND of equalities; values that are empty or not text are ignored."""
    for key, value in (equals or {}).items():
        if isinstance(value, str) and value != "":
            df = df.filter(F.col(key) == value)
    return df


class TopMatches:
    """Best ``k`` matches per query over the batches of one task: score down, then id up."""

    def __init__(self, queries: np.ndarray, k: int, floor: float, width: int = 512):
        self.queries, self.k, self.floor, self.width = _unit(queries), k, floor, width
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), None, dtype=object)

    def add(self, ids: pd.Series, vectors: np.ndarray) -> None:
        unit, names = _unit(vectors), ids.to_numpy(dtype=object)
        for start in range(0, len(self.queries), self.width):
            rows = slice(start, start + self.width)
            for low in range(0, len(names), self.width):
                scores = np.round(self.queries[rows] @ unit[low : low + self.width].T, 12)
                scores[scores < self.floor] = -np.inf
                self._keep_best(rows, scores, names[low : low + self.width])

    def _keep_best(self, rows: slice, scores: np.ndarray, names: np.ndarray) -> None:
        k = self.k
        everything = np.hstack([self.scores[rows], scores])
        pick = np.argpartition(-everything, k - 1, axis=1)[:, :k]
        held = self.ids[rows]
        last = np.take_along_axis(everything, pick, axis=1).min(axis=1, keepdims=True)
        # a tie that straddles the k-th place is settled by id
        for row in np.flatnonzero(((everything >= last) & (everything > -np.inf)).sum(axis=1) > k):
            able = np.flatnonzero(everything[row] >= last[row])
            named = [(-everything[row, c], _null_first(held[row, c] if c < k else names[c - k]), c) for c in able]
            pick[row] = [c for _, _, c in sorted(named)[:k]]
        self.scores[rows] = np.take_along_axis(everything, pick, axis=1)
        fresh = names[np.maximum(pick - k, 0)]
        self.ids[rows] = np.where(pick < k, np.take_along_axis(held, np.minimum(pick, k - 1), axis=1), fresh)

    def rows(self, query_ids) -> pd.DataFrame:
        query, place = np.nonzero(self.scores > -np.inf)
        asked = pd.Series(query_ids).to_numpy(dtype=object)
        return pd.DataFrame(
            {"query_id": asked[query], "id": self.ids[query, place], "score": self.scores[query, place]}
        )


def _null_first(value) -> tuple:
    """A value that sorts as Spark does, also beside nulls."""
    return (True, value) if value is not None and value == value else (False,)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    site_id: str,
    k: int = 6,
    min_score: float | None = None,
    equals: dict | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact cosine search: query_id, id, score, rank for the best ``k`` per query at or above the floor.

    ``queries``: query_id, embedding. ``vectors``: site_id, id, embedding and payload columns. Each task keeps only its
    best ``k`` per query, so the shuffle carries k rows per query and task, never all pairs. The query block is
    counted first. Below the byte bound it goes to every task and the vectors stay where the scan put them; above it,
    both sides are laid on a grid whose cells have a bounded number of rows. What has no vector neither finds nor is found.
    """
    scoped = payload_filter(vectors.filter(F.col("site_id") == site_id), equals).select("id", "embedding").filter("embedding IS NOT NULL")
    floor = -2.0 if min_score is None else min_score
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    shape = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    fields = [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", scoped.schema["id"].dataType)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    if shape["n"] == 0:
        return asked.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if fits_broadcast(shape["n"], 8 * shape["dims"] + 64, broadcast_bytes):
        partial = _search_with_broadcast(asked, scoped, k, floor, schema)
    else:
        partial = _search_on_grid(asked, scoped, k, floor, schema, shape["n"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # at most k rows per counted query, so a join with the payload need not move the vector table
    return F.broadcast(best) if fits_broadcast(shape["n"] * k, 128, broadcast_bytes) else best


def _search_with_broadcast(asked: DataFrame, scoped: DataFrame, k: int, floor: float, schema) -> DataFrame:
    block = asked.toPandas()  # bounded by the caller's byte check
    shared = asked.sparkSession.sparkContext.broadcast((block["query_id"].tolist(), _matrix(block["embedding"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        top = TopMatches(matrix, k, floor)
        for batch in batches:
            if len(batch):
                top.add(batch["id"], _matrix(batch["embedding"]))
        yield top.rows(query_ids)[schema.names]

    return scoped.mapInPandas(run, schema)


def _search_on_grid(asked: DataFrame, scoped: DataFrame, k: int, floor: float, schema, n: int) -> DataFrame:
    rows = max(1, -(-n // CELL_ROWS))
    columns = max(1, -(-scoped.count() // CELL_ROWS))
    across = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    down = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    left = asked.withColumn("_row", F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")).withColumn("_col", across)
    right = scoped.withColumn("_col", F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int")).withColumn("_row", down)

    def cell(some_queries: pd.DataFrame, some_vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(some_queries) or not len(some_vectors):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        top = TopMatches(_matrix(some_queries["embedding"]), k, floor)
        top.add(some_vectors["id"], _matrix(some_vectors["embedding"]))
        return top.rows(some_queries["query_id"])[schema.names]

    return left.groupBy("_row", "_col").cogroup(right.groupBy("_row", "_col")).applyInPandas(cell, schema)


def list_page(vectors: DataFrame, site_id: str, equals: dict | None = None, limit: int = 256, cursor=None) -> tuple[DataFrame, object]:
    """(page without vectors, next cursor or None), ordered by id from the cursor on."""
    rows = payload_filter(vectors.filter(F.col("site_id") == site_id), equals).drop("embedding")
    if cursor is not None:
        rows = rows.filter(F.col("id") >= cursor)
    page = rows.orderBy("id").limit(limit)
    after = rows.orderBy("id").offset(limit).limit(1).select("id").first()
    return page, None if after is None else after["id"]


def delete_points(vectors: DataFrame, site_id: str | None = None, ids: DataFrame | None = None, equals: dict | None = None) -> DataFrame:
    """The rows that remain. Give ids or a filter, not both; a filter is always inside one site."""
    if (ids is None) == (equals is None):
        raise ValueError("delete needs ids or a filter, and only one of them")
    if ids is not None:
        if ids.isEmpty():
            raise ValueError("delete needs at least one id")
        return vectors.join(ids.select("id").distinct(), "id", "left_anti")
    if not site_id:
        raise ValueError("a filtered delete needs a site")
    gone = F.col("site_id") == site_id
    for key, value in equals.items():
        if isinstance(value, str) and value != "":
            gone = gone & (F.col(key) == value)
    return vectors.filter(~F.coalesce(gone, F.lit(False)))


def count_points(vectors: DataFrame, site_id: str, equals: dict | None = None) -> DataFrame:
    return payload_filter(vectors.filter(F.col("site_id") == site_id), equals).agg(F.count("*").alias("points"))
