"""Exact nearest neighbours of a set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

#: Queries of one broadcast block and the bytes of their vectors; more are searched block by block.
QUERY_BLOCK, QUERY_BYTES = 16_384, 32 << 20
#: (query, row) pairs that a task keeps of a block, and the queries and rows that it measures at once.
KEPT, TILE = 4 << 20, (256, 1024)
#: Queries beyond which the rows are spread.
MANY = 256
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).min


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) squared distances by one matrix product; exact to about 1e-15 of the squared norms."""
    d = (-2 * q) @ x.T
    d += (x * x).sum(axis=1)[None, :]
    d += (q * q).sum(axis=1)[:, None]
    return np.maximum(d, 0, out=d)


def slack(q: np.ndarray, x: np.ndarray) -> float:
    """What squared_distances() can be off by."""
    return 1e-13 * (q.shape[1] + 1) * (float((q * q).sum(axis=1).max(initial=0)) + float((x * x).sum(axis=1).max(initial=0)))


def slacks(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """slack() of each query by itself."""
    return 1e-13 * (q.shape[1] + 1) * ((q * q).sum(axis=1) + float((x * x).sum(axis=1).max(initial=0)))


def closest(x: np.ndarray, centres: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the nearest centre of each row, the first of equals; `block` centres at a time."""
    place, best_of = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for at in range(0, len(centres), block):
        c = centres[at : at + block]
        d = squared_distances(x, c)
        row, col = np.nonzero(d <= d.min(axis=1, keepdims=True) + slack(x, c))
        exact = ((x[row] - c[col]) ** 2).sum(axis=1)
        order = np.lexsort((col, exact, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        better = exact[first] < best_of[row[first]]
        first = first[better]
        best_of[row[first]], place[row[first]] = exact[first], at + col[first]
    return place, best_of


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) blocks of the queries (query_id, q), read through an iterator; their order doesn't matter."""
    ids, rows = [], []
    for r in queries.select("query_id", F.col("q").cast("array<double>")).where("q is not null").toLocalIterator(prefetchPartitions=True):
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) >= min(size, max(1, QUERY_BYTES // (8 * max(1, len(rows[0]))))):
            yield np.array(ids), np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, dtype=np.float64)


def block_size(k: int) -> int:
    """Queries of a block that keeps k rows of each in every task."""
    return max(1, min(QUERY_BLOCK, KEPT // k))


def spread(rows: DataFrame, queries: int) -> DataFrame:
    """Rows (id, ...) dealt over all cores where many queries meet them: the work is then in pairs, and few files may hold the rows."""
    return rows if queries <= MANY else rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "id")


def tiles(queries: int, rows: int) -> Iterator[tuple[slice, slice]]:
    """Pieces of a (queries, rows) matrix."""
    for i in range(0, rows, TILE[1]):
        for j in range(0, queries, TILE[0]):
            yield slice(j, min(j + TILE[0], queries)), slice(i, min(i + TILE[1], rows))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dim) of an Arrow column of arrays of doubles of one length; null components are NaN."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1 or column.null_count:
        raise ValueError(f"vectors of one length are needed, not of {sizes.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ids_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of longs; null is NO_ID, which comes first."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def finite(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a batch (id, name, ...), without vectors that have no distance to anything."""
    ids, x = ids_of(b.column("id")), matrix(b.column(name))
    good = np.isfinite(x).all(axis=1)
    return (ids, x) if good.all() else (ids[good], x[good])


class Best:
    """The k lowest scores of each query, ties by id, over tiles of scores; scores that aren't finite don't count."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.rows = k, np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, at: slice, rows: np.ndarray, near: np.ndarray, margin: np.ndarray | float = 0.0, exact: Callable | None = None) -> None:
        """Scores of the queries `at` with the rows. exact: the score of (query, row) places in the tile, which `near` differs from by less than the margin."""
        k, last, last_row = self.k, self.scores[at, -1], self.rows[at, -1]
        limit = last + margin
        close = near <= limit[:, None]
        many = np.count_nonzero(close)
        if not many:
            return
        if near.shape[1] > k and many > 4 * k * len(near):
            close = near <= np.fmin(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + margin)[:, None]
        query, col = np.nonzero(close)
        found, rows = near[query, col] if exact is None else exact(query, col), rows[col]
        better = np.isfinite(found) & ((found < last[query]) | (found == last[query]) & (rows < last_row[query]))
        query, found, rows = query[better], found[better], rows[better]
        who, query = np.unique(query, return_inverse=True)  # those that change
        mine = at.start + who
        query = np.concatenate([np.repeat(np.arange(len(who)), k), query])
        found, rows = np.concatenate([self.scores[mine].ravel(), found]), np.concatenate([self.rows[mine].ravel(), rows])
        order = np.lexsort((rows, found, query))
        first = np.searchsorted(query[order], np.arange(len(who)))
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        self.scores[mine], self.rows[mine] = found[kept].reshape(-1, k), rows[kept].reshape(-1, k)

    def batches(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(query_id, id, distance) of all that is kept."""
        step = max(1, (1 << 16) // self.k)
        for i in range(0, len(self.scores), step):
            query, col = np.nonzero(np.isfinite(self.scores[i : i + step]))
            yield found_batch(ids[i + query], self.rows[i + query, col], self.scores[i + query, col])


def found_batch(query_ids: np.ndarray, rows: np.ndarray, distances: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"query_id": pa.array(query_ids, pa.int64(), from_pandas=True), "id": pa.array(rows, pa.int64(), mask=rows == NO_ID), "distance": pa.array(distances, pa.float64())}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in more.items()})


def exactly(q: np.ndarray, x: np.ndarray, metric: str = "l2") -> Callable:
    """Distances of (query, row) places, component by component, so that copies are equally far."""

    def some(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric == "l2":
            return ((b - a) ** 2).sum(axis=1)
        inner = (a * b).sum(axis=1)
        return -inner if metric == "dot" else 1 - inner / np.maximum(1e-300, np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))

    def run(query: np.ndarray, col: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 20) // max(1, q.shape[1]))
        return np.concatenate([some(q[query[i : i + step]], x[col[i : i + step]]) for i in range(0, len(query), step)])

    return run


def ranked(candidates: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k best of each query, ties by id."""
    d = F.col("distance").desc() if descending else F.col("distance").asc()
    w = W.partitionBy("query_id").orderBy(d, "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest rows of each query (query_id, q).

    The condition filters before the search. A task measures tiles of queries and rows and keeps k rows of each query, so
    what is shuffled is k rows for each query and task. `metric`: l2 (squared), cosine distance, or dot (negated, largest first).
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    out = None
    for ids, q in query_blocks(queries, block_size(k)):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            top = Best(len(q), k)
            for b in batches:
                if b.num_rows:
                    rows_of, x = finite(b, "v")
                    for i, j in tiles(len(q), len(x)):
                        top.offer(i, rows_of[j], *near(q[i], x[j], metric), exactly(q[i], x[j], metric))
            yield from top.batches(ids)

        part = spread(rows, len(q)).mapInArrow(scan, "query_id long, id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank long, id long, distance double")
    return ranked(out, k)


def near(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray | float]:
    """(queries, rows) distances by one matrix product, and what those of each query can be off by."""
    if metric == "l2":
        return squared_distances(q, x), slacks(q, x)
    inner, of_q, of_x = q @ x.T, np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    off = 1e-13 * (q.shape[1] + 1)
    if metric == "dot":
        return -inner, off * of_q * of_x.max(initial=0)
    return 1 - inner / np.maximum(1e-300, of_q[:, None] * of_x[None, :]), off
