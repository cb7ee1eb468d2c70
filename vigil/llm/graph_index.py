"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by the hash of their id; every
row is in the index.  In a shard equal vectors share a node.  The graph starts
with random edges; then every node is searched for from the middle of the
shard, and of the nodes met those are kept as neighbours that no nearer
neighbour already stands for: b is dropped if SPREAD * d(kept, b) <= d(node, b).
Edges are added in both directions and pruned again where a node has too many.
A shard becomes one row of the index table: ids, vectors and neighbours as bytes.

A search walks every shard's graph with a beam for a whole block of queries at
once, then takes the distances anew in double precision from the original
vectors.  Queries come in blocks that are broadcast (``vectors.QUERY_BLOCK``).

Defined cases: vectors that are null, zero, or hold nulls or values that are
not finite take no part, nor do rows with a null id; rows with one id count as
one; vectors of another length are in other shards and never meet; ties go to
the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import vectors as V
from vigil.session import materialize

SHARD_ROWS = 4096
#: Neighbours a node keeps, room for edges between two prunings, beam while building and searching.
DEGREE, ROOM, BUILD_BEAM, BEAM = 32, 48, 64, 96
SPREAD = 1.2
#: Nodes searched for together, and nodes whose neighbours are opened in one step.
TOGETHER, OPENED = 256, 4
PASSES = 2
MOST_NEW = 64  # proposed edges towards one node that a round takes; further ones wait for the next round

_INDEX = "length int, nodes int, entry int, ids binary, members binary, points binary, edges binary"


def squares(points: np.ndarray, some: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of ``to`` (b x d) to points[some] (b x m)."""
    gap = points[some] - to[:, None, :]
    return np.einsum("bmd,bmd->bm", gap, gap)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, to: np.ndarray, width: int) -> tuple:
    """Nodes (b x width, -1 for none) and squared distances, nearest first, of a greedy search with a beam."""
    count, rows = len(to), np.arange(len(to))[:, None]
    nodes = np.full((count, width), -1, dtype=np.int32)
    far = np.full((count, width), np.inf, dtype=np.float32)
    opened = np.ones((count, width), dtype=bool)
    seen = np.zeros((count, len(points) + 1), dtype=bool)  # the last column takes the -1 of missing edges
    seen[:, -1] = True
    nodes[:, 0], opened[:, 0], seen[:, entry] = entry, False, True
    far[:, 0] = squares(points, nodes[:, :1], to)[:, 0]
    while True:
        live = np.flatnonzero(~opened.all(axis=1))
        if not len(live):
            return nodes, far
        place = np.argsort(opened[live], axis=1, kind="stable")[:, :OPENED]
        here = np.where(opened[live[:, None], place], -1, nodes[live[:, None], place])
        opened[live[:, None], place] = True
        near = np.where(here[:, :, None] >= 0, edges[here], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        gap = squares(points, near, to[live])
        gap[near < 0] = np.inf
        all_far = np.concatenate([far[live], gap], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        pick = rows[: len(live)]
        far[live] = all_far[pick, order]
        nodes[live] = np.concatenate([nodes[live], near], axis=1)[pick, order]
        opened[live] = np.concatenate([opened[live], near < 0], axis=1)[pick, order]


def prune(points: np.ndarray, owner: np.ndarray, some: np.ndarray, spread: float) -> np.ndarray:
    """Of candidates ``some`` (b x m, -1 for none) the diverse neighbours (b x DEGREE) of ``owner``.

    Distances between candidates are taken from points moved by their owner, so
    that rounding is small beside the distance they are compared with.
    """
    some = np.where(some == owner[:, None], -1, some)
    some.sort(axis=1)
    some[:, 1:][some[:, 1:] == some[:, :-1]] = -1
    far = squares(points, some, points[owner])
    far[some < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    some, far = np.take_along_axis(some, order, 1), np.take_along_axis(far, order, 1)
    each = points[some] - points[owner][:, None, :]
    size = np.einsum("bmd,bmd->bm", each, each)
    between = size[:, :, None] + size[:, None, :] - 2 * np.matmul(each, each.transpose(0, 2, 1))
    alive, kept = some >= 0, np.zeros(some.shape, dtype=bool)
    for j in range(some.shape[1]):
        take = alive[:, j] & (kept.sum(axis=1) < DEGREE)
        kept[:, j] = take
        alive &= ~(take[:, None] & (spread * spread * between[:, j, :] <= far))
    place = np.argsort(~kept, axis=1, kind="stable")[:, :DEGREE]
    out = np.full((len(some), DEGREE), -1, dtype=np.int32)
    out[:, : place.shape[1]] = np.where(np.take_along_axis(kept, place, 1), np.take_along_axis(some, place, 1), -1)
    return out


def add_backward(points: np.ndarray, edges: np.ndarray, owner: np.ndarray, chosen: np.ndarray, spread: float) -> None:
    """Edges from the chosen neighbours back to their owners, the nearest first; nodes without room are pruned."""
    head, tail = chosen.ravel(), np.repeat(owner, chosen.shape[1])
    head, tail = head[chosen.ravel() >= 0], tail[chosen.ravel() >= 0]
    gap = points[head] - points[tail]
    order = np.lexsort((np.einsum("md,md->m", gap, gap), head))
    head, tail = head[order], tail[order]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
    place = np.arange(len(head)) - np.repeat(first, np.diff(np.append(first, len(head))))
    for start in range(0, place.max(initial=-1) + 1, MOST_NEW):
        now = (place >= start) & (place < start + MOST_NEW)
        _add_round(points, edges, head[now], tail[now], place[now] - start, spread)


def _add_round(points: np.ndarray, edges: np.ndarray, head: np.ndarray, tail: np.ndarray, place: np.ndarray, spread: float) -> None:
    """Edges from ``head`` to ``tail``; ``place`` numbers those of one head."""
    nodes, at = np.unique(head, return_inverse=True)
    new = np.full((len(nodes), place.max() + 1), -1, dtype=np.int32)
    new[at, place] = tail
    known = (new[:, :, None] == edges[nodes][:, None, :]).any(axis=2)
    new[known] = -1
    total = (edges[nodes] >= 0).sum(axis=1) + (new >= 0).sum(axis=1)
    every = np.concatenate([edges[nodes], new], axis=1)
    packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
    fits = total <= ROOM
    edges[nodes[fits]] = packed[fits, :ROOM]
    for start in range(0, (~fits).sum(), 1024):
        some = np.flatnonzero(~fits)[start : start + 1024]
        edges[nodes[some]] = -1
        edges[nodes[some], :DEGREE] = prune(points, nodes[some], every[some], spread)


def build_graph(points: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Neighbours (n x ROOM, -1 for none) and the entry node of distinct points."""
    n = len(points)
    edges = np.full((n, ROOM), -1, dtype=np.int32)
    middle = points.mean(axis=0)
    entry = int(((points - middle) ** 2).sum(axis=1).argmin())
    if n <= DEGREE + 1:
        for i in range(n):
            edges[i, : n - 1] = [j for j in range(n) if j != i]
        return edges, entry
    draw = np.random.default_rng(seed)
    edges[:, : DEGREE // 2] = draw.integers(0, n, (n, DEGREE // 2))
    for step in range(PASSES):
        spread = 1.0 if step + 1 < PASSES else SPREAD
        turn = draw.permutation(n)
        for start in range(0, n, TOGETHER):
            owner = turn[start : start + TOGETHER]
            met, _ = beam_search(points, edges, entry, points[owner], BUILD_BEAM)
            chosen = prune(points, owner, np.concatenate([met, edges[owner]], axis=1), spread)
            edges[owner] = -1
            edges[owner, :DEGREE] = chosen
            add_backward(points, edges, owner, chosen, spread)
    return edges, entry


def usable(vector: Column) -> Column:
    """The vector in double precision; null if it takes no part."""
    some = F.exists(vector, lambda x: x != 0)
    return F.when(V.finite(vector) & some, F.transform(vector, lambda x: x.cast("double")))


def build(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index table: one row a shard.  Every row that takes part is in it."""
    rows = materialize(V.one_per_id(df, vec_id, usable(F.col(vector))), "points").withColumn("length", F.size("vector"))
    shards = rows.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).alias("_shards"))
    dealt = rows.join(materialize(shards, "shards"), "length").withColumn("_shard", F.pmod(F.xxhash64("id"), "_shards"))

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by("id")
        ids, length = shard.column("id").to_numpy(), shard.column("length")[0].as_py()
        every = shard.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), length)
        points, node = np.unique(every, axis=0, return_inverse=True)
        node = node.ravel()
        order = np.lexsort((ids, node))
        edges, entry = build_graph(points.astype(np.float32), int(ids[0]) & 0xFFFFFFFF)
        packed = ids[order], np.bincount(node, minlength=len(points)), points, edges
        row = [length, len(points), entry, *(x.tobytes() for x in packed)]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return dealt.groupBy("length", "_shard").applyInArrow(run, _INDEX)


def search_shard(shard: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple:
    """(query, id, distance) of the k nearest found in one shard, the query's own id left out."""
    points = np.frombuffer(shard["points"]).reshape(shard["nodes"], shard["length"])
    edges = np.frombuffer(shard["edges"], dtype=np.int32).reshape(shard["nodes"], ROOM)
    ids, count = np.frombuffer(shard["ids"], dtype=np.int64), np.frombuffer(shard["members"], dtype=np.int64)
    first, coarse, out = np.cumsum(count) - count, points.astype(np.float32), []
    for start in range(0, len(queries), TOGETHER):
        to = queries[start : start + TOGETHER]
        nodes, _ = beam_search(coarse, edges, shard["entry"], to.astype(np.float32), width)
        exact = np.sqrt(squares(points, nodes, to))
        at, place = np.nonzero(nodes >= 0)
        node, score = nodes[at, place], exact[at, place]
        many = np.minimum(count[node], k + 1)  # equal vectors by id, one more for the query's own
        at, score = np.repeat(at, many), np.repeat(score, many)
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        found = ids[np.repeat(first[node], many) + place]
        own = found == query_ids[start + at]
        at, score, found = at[~own], score[~own], found[~own]
        order = np.lexsort((found, score, at))
        at, score, found = at[order], score[order], found[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        out.append([x[rank < k] for x in (query_ids[start + at], found, score)])
    return tuple(np.concatenate(x) for x in zip(*out))


def search(index: DataFrame, queries: DataFrame, k: int = 10, width: int = BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (distance) of the k nearest found.

    ``index`` is a written index table, ``queries`` has ``id`` and ``vector``.
    """
    found = []
    for ids, vectors in V.query_blocks(queries):
        part = index.where(F.col("length") == vectors.shape[1])
        found.append(materialize(_searched(part, (ids, vectors.astype(np.float64)), k, width), "found"))
    if not found:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return V.best(reduce(DataFrame.unionByName, found), k, descending=False)


def _searched(index: DataFrame, queries: tuple, k: int, width: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)  # one block

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                shard = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                columns = search_shard(shard, *shared.value, k, max(width, k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Index all rows, then search for those that ``is_query`` (on column ``id``) chooses."""
    index = materialize(build(df, vec_id, vector), "index")
    chosen = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("_vector")).where(is_query)
    return search(index, V.one_per_id(chosen, "id", usable(F.col("_vector"))), k)
