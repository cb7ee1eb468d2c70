import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import graph_index, pivots

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, score, sign):
    """rank lists by a full scan; rows of one id count as the one of the smallest vector."""
    one = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            one[i] = min(one.get(i, v), v)
    out = {}
    for q in one:
        if q % 100 == 0:
            found = sorted((sign * score(one[q], v), i) for i, v in one.items() if i != q and len(v) == len(one[q]))
            out[q] = [(n + 1, i, sign * s) for n, (s, i) in enumerate(found[:k])]
    return {q: found for q, found in out.items() if found}


def product(a, b):
    return sum(int(np.floor(1024 * float(x))) * int(np.floor(1024 * float(y))) for x, y in zip(a, b))


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(found) for q, found in out.items()}


def vectors(count, seed, size=8, kind=np.float32):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, size))
    return [(i, [float(x) for x in (centres[i % 5] + draw.normal(size=size) * 0.4).astype(kind)]) for i in range(count)]


def odd(rows):
    same = rows[0][1]
    return rows + [(5000 + i, same) for i in range(40)] + [
        (9000, None), (9100, []), (9101, []), (9200, [NAN] * 8), (9201, [INF] + [0.0] * 7), (9202, [None] + [1.0] * 7),
        (9300, [0.0] * 8), (9400, [1.0, 2.0]), (9401, [2.0, 1.0]), (None, same), (9500, same), (9500, same), (9501, [1e30] * 8), (9600, [3e30] * 8),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumns(
        {"id": F.lit("x"), "vector": F.lit("y"), "length": F.lit(1)}
    )


def test_exact_products_equal_brute_force(spark):
    rows = odd(vectors(1500, 1))
    got = grouped(pivots.top_products(frame(spark, rows), F.col("id") % 100 == 0).collect())
    limit = 2**63
    expected = brute(rows, 10, lambda a, b: max(-limit, min(limit - 1, product_cut(a, b))), -1)
    assert got == {q: [(n, i, s) for n, i, s in found] for q, found in expected.items()}


def product_cut(a, b):
    limit = 2**63
    cut = lambda x: max(-limit, min(limit - 1, int(np.floor(1024 * float(x)))))
    return sum(cut(x) * cut(y) for x, y in zip(a, b))


def test_several_query_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(pivots.V, "query_blocks", lambda q, rows=3, f=pivots.V.query_blocks: f(q, rows))
    rows = vectors(900, 2)
    got = grouped(pivots.top_products(frame(spark, rows), F.col("id") % 100 == 0, k=4).collect())
    assert got == brute(rows, 4, product, -1)
    few = rows[:3]
    assert grouped(pivots.top_products(frame(spark, few), F.col("id") % 100 == 0).collect()) == brute(few, 10, product, -1)


def test_search_stops_early():
    """Well separated points: most are never evaluated."""
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.normal(c, 1, (2000, 4)) for c in (0, 50, 100, 200)]).round().astype(np.int64) * 100
    lifted = pivots.lifted(points, most := float((points.astype(float) ** 2).sum(axis=1).max()))
    chosen = pivots.choose(lifted, 16)
    query = points[-1:]
    table = pivots.distances(np.concatenate([query, [[0]]], axis=1).astype(float), chosen)
    half = ((query.astype(float) ** 2).sum(axis=1) + most) / 2
    seen = []
    best = pivots.Best(5)
    add = best.add
    best.add = lambda ids, scores: (seen.append(len(ids)), add(ids, scores))
    pivots.search_batch([best], (np.array([-1]), query, table, half), np.arange(len(points)), points, pivots.distances(lifted, chosen))
    scores = points @ query[0]
    assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert sum(seen) < len(points) / 2


def test_empty_tables(spark):
    none = frame(spark, [])
    assert pivots.top_products(none, F.col("id") % 100 == 0).collect() == []
    assert graph_index.nearest(none, F.col("id") % 100 == 0).collect() == []


def distance(a, b):
    return float(np.sqrt(((np.array(a, dtype=np.float64) - np.array(b, dtype=np.float64)) ** 2).sum()))


def test_graph_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "SHARD_ROWS", 700)
    rows = odd(vectors(3000, 4, 24))
    rows = [r for r in rows if r[1] is None or len(r[1]) != 8 or r[0] is None]
    index = graph_index.build(frame(spark, rows)).collect()
    valid = [r for r in rows if r[0] is not None and r[1] and any(r[1])]
    assert sum(len(r.ids) // 8 for r in index) == len({i for i, _ in valid}) and len(index) >= 5
    got = grouped(graph_index.nearest(frame(spark, rows), F.col("id") % 100 == 0).collect())
    expected = brute(valid, 10, distance, 1)
    assert set(got) == set(expected)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in found}) for q, found in expected.items())
    assert hits >= 0.95 * sum(map(len, expected.values()))
    known = dict(valid)
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, len(found) + 1))
        assert found == sorted(found, key=lambda f: (f[2], f[1])) and q not in {i for _, i, _ in found}
        assert all(s == pytest.approx(distance(known[q], known[i]), rel=1e-12) for _, i, s in found)


def test_equal_vectors_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300, 0, -1)] + [(1000 + i, [float(i), 0.5, 0.25]) for i in range(60)]
    got = grouped(graph_index.nearest(frame(spark, rows), F.col("id") == 100).collect())
    assert [(i, s) for _, i, s in got[100]] == [(i, 0.0) for i in range(1, 11)]


def test_zero_and_broken_vectors_take_no_part(spark):
    rows = odd([(i, [float(i + 1)] * 8) for i in range(20)])
    rows = [r for r in rows if r[0] not in (9501, 9600)]
    got = grouped(graph_index.nearest(frame(spark, rows), F.col("id") % 100 == 0).collect())
    met = {i for found in got.values() for _, i, _ in found} | set(got)
    assert not met & {9000, 9100, 9101, 9200, 9201, 9202, 9300, None}
    assert [i for _, i, _ in got[9400]] == [9401]
    assert got[0][0][2] == 0.0 and 0 not in {i for _, i, _ in got[0]}


def test_pruned_graph_is_diverse_and_connected():
    points = np.array([v for _, v in vectors(800, 6, 16)], dtype=np.float32)
    edges, entry = graph_index.build_graph(points, 1)
    assert edges.shape == (800, graph_index.ROOM) and edges.max() < 800
    reached, open_ = {entry}, [entry]
    while open_:
        for n in edges[open_.pop()]:
            if n >= 0 and n not in reached:
                reached.add(int(n))
                open_.append(int(n))
    assert len(reached) == 800


def near_copies(count, noise, seed):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=16)
    return (middle / np.linalg.norm(middle) + draw.normal(size=(count, 16)) * noise).astype(np.float32)


@pytest.mark.parametrize("noise", [1e-2, 1e-4, 1e-5])
def test_pruning_equals_exact_distances(noise):
    """Also for near copies, whose distances are small beside their norm."""
    points = near_copies(200, noise, 7)
    owner = np.arange(20)
    some = np.array([[j for j in range(100, 196)]] * 20)
    got = graph_index.prune(points, owner, some.copy(), 1.2)
    exact = points.astype(np.float64)
    for i, found in zip(owner, got):
        kept = []
        for j in sorted(some[i], key=lambda j: distance(exact[i], exact[j])):
            if len(kept) < graph_index.DEGREE and all(1.2 * distance(exact[k], exact[j]) > distance(exact[i], exact[j]) for k in kept):
                kept.append(j)
        assert [n for n in found if n >= 0] == kept


def test_no_proposed_edge_is_lost(monkeypatch):
    """More edges towards one node than a round takes give what one large round gives."""
    points = np.concatenate([np.zeros((1, 400)), np.eye(400)]).astype(np.float32)
    monkeypatch.setattr(graph_index, "ROOM", 401)
    edges = np.full((401, 401), -1, dtype=np.int32)
    owner = np.arange(1, 301)
    graph_index.add_backward(points, edges, owner, np.zeros((300, 1), dtype=np.int32), 1.2)
    assert sorted(edges[0][edges[0] >= 0]) == list(owner)


def test_recall_on_near_copies(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "SHARD_ROWS", 500)
    copies = near_copies(500, 1e-5, 8)
    rows = vectors(1000, 9, 16) + [(1000 + i, [float(x) for x in v]) for i, v in enumerate(copies)]
    got = grouped(graph_index.nearest(frame(spark, rows), F.col("id") % 50 == 0).collect())
    known, hits = np.array([v for _, v in rows]), 0
    for q, found in got.items():
        far = np.sqrt(((known - known[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(len(rows)), far))[:10].tolist()))
    assert len(got) == 30 and hits >= 0.95 * 300
