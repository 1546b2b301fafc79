"""Nearest vectors of many queries: products of blocks of store rows with blocks of queries.

A few queries go to the workers and the store is scanned where it lies; more queries meet the store
in a grid of blocks, in which no task holds more than one block of each.  Products only find
candidates: these are scored again row by row, so that equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the queries that are handed to every worker at most; beyond, queries and store meet in a grid.
BROADCAST_NUMBERS = 4_000_000
#: Numbers of a block of the store and of the queries in the grid, and of a product at a time.
STORE_BLOCK, QUERY_BLOCK, TILE = 2_000_000, 8_000_000, 4_000_000


def matrix(col: pa.Array, size: int | None = None) -> np.ndarray:
    """The rows of a vector column without nulls; an error where lengths differ."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, n = col.flatten(), len(col)
    if flat.null_count:
        raise ValueError("a vector holds nulls")
    lengths = np.diff(np.asarray(col.offsets)) if n else np.zeros(0, np.int64)
    size = size if size is not None else int(lengths[0]) if n else 0
    if n and (lengths != size).any():
        raise ValueError(f"dimension mismatch: expected {size}, got {int(lengths[lengths != size][0])}")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, size)


def keys_of(col: pa.Array) -> np.ndarray:
    return np.asarray(col.to_pylist()) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.to_numpy(zero_copy_only=False)


class Best:
    """The k best (score, key) of each query over all rows that were added: higher score first, then lower key."""

    def __init__(self, queries: np.ndarray, k: int, least: float | None = None):
        self.queries, self.k, self.least = queries, k, least
        self.norms = np.sqrt((queries * queries).sum(1))
        self.unit = queries / np.where(self.norms, self.norms, 1.0)[:, None]
        self.floor = np.full(len(queries), -np.inf)  # the k-th best score so far
        self.asked, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, keys: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        which = np.arange(len(self.queries)) if which is None else which
        if not len(rows) or not len(which) or self.k < 1:
            return
        norms = np.sqrt((rows * rows).sum(1))
        unit = rows / np.where(norms, norms, 1.0)[:, None]
        high = max(1, min(len(rows), TILE // max(1, min(len(which), 1024))))
        for a in range(0, len(which), 1024):
            own = which[a : a + 1024]
            for b in range(0, len(rows), high):
                near = self.unit[own] @ unit[b : b + high].T
                floor = self.floor[own]
                if near.shape[1] > self.k:
                    floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero(near >= (floor - 1e-9)[:, None])
                if len(i):
                    self._merge(own[i], keys[b + j], rows[b + j], norms[b + j])

    def _merge(self, asked: np.ndarray, keys: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> None:
        both = norms * self.norms[asked]
        score = np.where(both, (rows * self.queries[asked]).sum(1) / np.where(both, both, 1.0), 0.0)
        if self.least is not None:
            keep = score >= self.least
            asked, keys, score = asked[keep], keys[keep], score[keep]
        if self.key is not None:
            asked, keys, score = np.concatenate([self.asked, asked]), np.concatenate([self.key, keys]), np.concatenate([self.score, score])
        order = np.lexsort((keys, -score, asked))
        asked, keys, score = asked[order], keys[order], score[order]
        first = np.searchsorted(asked, asked)
        keep = np.arange(len(asked)) - first < self.k
        self.asked, self.key, self.score = asked[keep], keys[keep], score[keep]
        full = np.flatnonzero(np.arange(len(self.asked)) - np.searchsorted(self.asked, self.asked) == self.k - 1)
        self.floor[self.asked[full]] = self.score[full]

    def batch(self, query_keys: pa.Array, key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
        keys = pa.array([] if self.key is None else self.key.tolist(), key_type)
        return pa.RecordBatch.from_arrays([query_keys.take(pa.array(self.asked)), keys, pa.array(self.score, pa.float64())], names)


def ranked(found: DataFrame, k: int, key: str, query_key: str) -> DataFrame:
    """The best of the best of all tasks: at most k rows of a query from each."""
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, key, "score", "rank")


def kept(store: DataFrame, key: str, vector: str, *more: str | Column) -> DataFrame:
    return store.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(vector).alias("_vector"), *more)


def answers(store: DataFrame, queries: DataFrame, key: str, query_key: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"`{query_key}` {kind(queries, query_key)}, `{key}` {kind(store, key)}, score double"


def handed_out(rows: DataFrame, queries: pa.Table, schema: str, names: list[str], k: int, least: float | None, lists: list[np.ndarray] | None) -> DataFrame:
    """Scan the rows where they lie; `lists`: by number of a list the queries that look into it."""
    spark = rows.sparkSession
    qkeys, values = queries.column(0).combine_chunks(), matrix(queries.column(1))
    given = spark.sparkContext.broadcast((qkeys, values, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qkeys, values, lists = given.value
        best, kind = Best(values, k, least), None
        for batch in batches if len(values) else ():
            kind = batch.schema.field(0).type
            for number, part in _by_list(batch, lists is not None):
                best.add(keys_of(part.column(0)), matrix(part.column(1), values.shape[1]), None if lists is None else lists[number])
        if kind is not None:
            yield best.batch(qkeys, kind, names)

    return rows.mapInArrow(run, schema)


def _by_list(batch: pa.RecordBatch, split: bool) -> Iterator[tuple[int, pa.RecordBatch]]:
    if not split:
        yield 0, batch
        return
    numbers = batch.column(2).to_numpy(zero_copy_only=False)
    order = np.argsort(numbers, kind="stable")
    for number in np.unique(numbers):
        a, b = np.searchsorted(numbers[order], [number, number + 1])
        yield int(number), batch.take(pa.array(order[a:b]))


def grid(rows: DataFrame, asked: DataFrame, schema: str, names: list[str], k: int, least: float | None, size: int, key: str, query_key: str) -> DataFrame:
    """Blocks of rows and blocks of queries of the same list, each pair in one task.

    Both are dealt by hash into so many parts as their list's count asks for, and each part goes to
    all parts of the other side: a hot list is as many pairs as its size needs, never one task.
    """
    # one row a list, as many as the index has; both counts combine before the shuffle
    n_store, n_query = max(1, STORE_BLOCK // max(1, size)), max(1, QUERY_BLOCK // max(1, size))
    counts = rows.groupBy("_list").agg(F.ceil(F.count("*") / n_store).alias("_parts")).join(asked.groupBy("_list").agg(F.ceil(F.count("*") / n_query).alias("_cols")), "_list")
    spread = lambda df, by, own, other: df.join(F.broadcast(counts), "_list").withColumns({own[0]: F.pmod(F.xxhash64(by), F.col(own[1])), other[0]: F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1).cast("array<long>"))}).drop("_parts", "_cols")
    left = spread(rows, key, ("_a", "_parts"), ("_b", "_cols"))
    right = spread(asked, query_key, ("_b", "_cols"), ("_a", "_parts"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(matrix(right.column("_vector"), size), k, least)
        best.add(keys_of(left.column(key).combine_chunks()), matrix(left.column("_vector"), size))
        return pa.Table.from_batches([best.batch(right.column(query_key).combine_chunks(), left.schema.field(key).type, names)])

    by = ["_list", "_a", "_b"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def batch_top_k(store: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "embedding", min_score: float | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k rows of the store that are nearest to each query by cosine, ties by key.

    Rows and queries with a null vector or key have no answers; vectors of another length are an error.
    """
    rows, asked = kept(store, key, vector), kept(queries, query_key, vector)
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("_vector")), F.lit(0))).first()
    schema, names = answers(store, queries, key, query_key), [query_key, key, "score"]
    if n * size <= BROADCAST_NUMBERS:
        found = handed_out(rows, asked.toArrow(), schema, names, k, min_score, None)
    else:
        found = grid(rows.withColumn("_list", F.lit(0)), asked.withColumn("_list", F.lit(0)), schema, names, k, min_score, size, key, query_key)
    return ranked(found, k, key, query_key)
