"""Exact top-k by inner product with a table of distances to pivots.

Integer vectors x become points (x, sqrt(M - |x|^2)) with M the largest squared
length, queries q become (q, 0).  Then |q' - x'|^2 = |q|^2 + M - 2 <q, x>, so
the largest inner product is the smallest distance.  Distances of all points
to ``PIVOTS`` pivots are computed once and written.  For a query and a point
the largest difference of their distances to a pivot bounds their own distance
from below, hence the inner product from above.  A task evaluates its points in
the order of that bound and stops when the k-th best product found is above the
next bound, so the answer is exact.

Queries come in blocks that are broadcast (``QUERY_BLOCK`` rows); every block
meets all points.  Only k rows a query and task are shuffled.

Defined cases: vectors that are null or hold nulls or values that are not
finite take no part, nor do rows with a null id; rows with one id count as one;
a query meets vectors of its own length; empty vectors have product 0; products
beyond 64 bits are cut to the largest or smallest long; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import vectors as V
from vigil.session import materialize

PIVOTS = 48
#: Points among which the pivots are chosen, each as far as possible from those before.
SAMPLE = 2048
STEP = 256  # points evaluated between two looks at the bound
SCALE = 1024


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    return F.when(V.finite(vector), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def lifted(points: np.ndarray, most: float) -> np.ndarray:
    points = points.astype(np.float64)
    rest = np.sqrt(np.maximum(most - (points**2).sum(axis=1), 0))
    return np.concatenate([points, rest[:, None]], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1).astype(np.float32)


def choose(points: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Pivots among the points: the longest first, then always the one furthest from those chosen."""
    at = [int((points[:, :-1] ** 2).sum(axis=1).argmax())]
    near = np.full(len(points), np.inf)
    while len(at) < min(count, len(points)):
        near = np.minimum(near, ((points - points[at[-1]]) ** 2).sum(axis=1))
        at.append(int(near.argmax()))
    return points[at]


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    most = float(np.abs(points).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < 2.0**53:
        return (points.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return points @ query
    exact = points.astype(object) @ query.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in exact], dtype=np.int64)


class Best:
    """The k best (product, smaller id) found for one query."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~x = -x - 1 turns the order and cannot overflow
        self.ids, self.scores = ids[order], scores[order]

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def search_batch(best: list[Best], queries: tuple, ids: np.ndarray, points: np.ndarray, table: np.ndarray) -> None:
    """Evaluate a batch of points for all queries, each in the order of its bound."""
    query_ids, vectors, query_table, half = queries
    slack = 1e-6 * (float(table.max(initial=0)) + float(query_table.max(initial=0))) + 1e-6
    for row, (own, query) in enumerate(zip(query_ids, vectors)):
        far = np.zeros(len(ids), dtype=np.float32)
        for j in range(table.shape[1]):
            np.maximum(far, np.abs(table[:, j] - query_table[row, j]), out=far)
        low = np.maximum(far.astype(np.float64) - slack, 0)
        bound = (half[row] - low**2 / 2) * (1 + 1e-12) + 1
        order = np.argsort(-bound, kind="stable")
        mine = best[row]
        for start in range(0, len(order), STEP):
            if bound[order[start]] < mine.least:
                break
            some = order[start : start + STEP]
            some = some[ids[some] != own]
            mine.add(ids[some], products(points[some], query))


def top_products(
    df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k largest products; ``is_query`` is on column ``id``."""
    rows = materialize(V.one_per_id(df, vec_id, whole_numbers(F.col(vector), scale)), "whole_numbers")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    found = []
    tables: dict[int, tuple] = {}
    for ids, queries in V.query_blocks(rows.where(is_query)):
        length = queries.shape[1]
        if length not in tables:
            same = rows.where(F.size("vector") == length)
            most = same.agg(F.max(square)).first()[0]
            sample = same.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
            points = np.array([r["vector"] for r in sample], dtype=np.int64).reshape(len(sample), length)
            pivots = choose(lifted(points, most))
            tables[length] = most, pivots, materialize(_pivot_table(same, most, pivots), "pivot_table")
        most, pivots, table = tables[length]
        queries = queries.astype(np.int64)
        points = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
        half = ((queries.astype(np.float64) ** 2).sum(axis=1) + most) / 2
        found.append(materialize(_searched(table, (ids, queries, distances(points, pivots), half), k), "found"))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return V.best(reduce(DataFrame.unionByName, found), k, descending=True)


def _pivot_table(rows: DataFrame, most: float, pivots: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS points

    def run(batches):
        for batch in batches:
            found = distances(lifted(V.matrix(batch, "vector"), most), shared.value)
            flat = pa.array(found.ravel())
            starts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            columns = [batch.column("id"), batch.column("vector"), pa.ListArray.from_arrays(starts, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "distances"])

    return rows.mapInArrow(run, "id long, vector array<long>, distances array<float>")


def _searched(table: DataFrame, queries: tuple, k: int) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(queries)  # one block

    def run(batches):
        best = [Best(k) for _ in shared.value[0]]
        for batch in batches:
            if len(batch):
                ids = batch.column("id").to_numpy()
                search_batch(best, shared.value, ids, V.matrix(batch, "vector"), V.matrix(batch, "distances"))
        owner = np.repeat(shared.value[0], [len(b.ids) for b in best])
        columns = [owner, np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return table.mapInArrow(run, "query_id long, vec_id long, score long")
