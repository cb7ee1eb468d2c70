import numpy as np
import pytest

from vigil.llm import mixing


def targets(sizes):
    """Shares by weight, capped at twice the size, the rest shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in above}


def check(rows, got):
    sizes, texts, taken = {}, {}, {}
    for doc, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    expected = targets(sizes)
    for r in got:
        texts[r.doc_id] = r
    for doc, text, _, source, _ in rows:
        row = texts[doc]
        size = len((text or "").encode().split())
        assert (row._size, row._words) == (size, sizes[source])
        assert row._target == pytest.approx(expected[source])
        assert 0 <= row._copies <= 2
        taken[source] = taken.get(source, 0) + size * row._copies
    most = {s: max(len((r[1] or "").encode().split()) for r in rows if r[3] == s) for s in sizes}
    for source, words in taken.items():
        assert abs(words - expected[source]) <= 2 * most[source] + 1


def many(count, seed, sources):
    draw = np.random.default_rng(seed)
    return [
        (i, " ".join(["w"] * int(draw.integers(1, 60))), "en", sources[int(draw.integers(len(sources)))] if i % 3 else sources[0], 1)
        for i in range(count)
    ]


def test_targets_and_balance(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)  # several blocks and rounds
    rows = many(3000, 1, ["a", "b", "Z", "é", "zz", None])
    got = mixing.copies(documents(rows), ["doc_id"], "source", "text").collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_documents_are_balanced_too(spark, documents):
    rows = many(4000, 2, ["a", "b", "c"])
    got = mixing.copies(documents(rows), ["doc_id"], "source", "text").collect()
    of = {r[0]: r[3] for r in rows}
    for source in "abc":
        mine = [r for r in got if of[r.doc_id] == source]
        assert abs(sum(r._copies for r in mine) - len(mine) * mine[0]._target / mine[0]._words) <= 3


def test_reruns_and_partitions_agree(spark, documents):
    docs = documents(many(800, 3, ["a", "b"]))
    one = sorted((r.doc_id, r._copies) for r in mixing.copies(docs.repartition(7), ["doc_id"], "source", "text").collect())
    two = sorted((r.doc_id, r._copies) for r in mixing.copies(docs.coalesce(1), ["doc_id"], "source", "text").collect())
    assert one == two


def test_chances_are_kept_on_average():
    size, chance = np.array([5.0, 9, 2, 7, 7, 3]), np.full(6, 0.35)
    draws = [mixing.decide(size, chance, np.random.default_rng(i), True) for i in range(4000)]
    np.testing.assert_allclose(np.mean(draws, axis=0), chance, atol=0.03)
    assert {0.0, 1.0} == set(np.unique(draws))


def test_a_block_leaves_two_and_keeps_both_totals():
    draw = np.random.default_rng(8)
    size, chance = draw.integers(0, 500, 400).astype(float), np.full(400, 0.4)
    out = mixing.decide(size, chance, draw, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(chance.sum()) and (out * size).sum() == pytest.approx((chance * size).sum())


def test_edges(spark, documents):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "x y", "en", None, 3), (4, " \t", "en", "b", 2), (5, "w " * 50_000, "en", "c", 9), (None, "u v", "en", "c", 3)]
    docs = documents(rows, "1 as _size;2 as _copies;3 as _hash")
    got = mixing.copies(docs, ["doc_id"], "source", "text").collect()
    assert len(got) == 6 and all(r._copies >= 0 for r in got)
    assert {r._target for r in got if r.doc_id in (1, 2, 4)} == {0.0}
    assert mixing.copies(documents([]), ["doc_id"], "source", "text").collect() == []


def test_mixed_rows(spark, documents):
    rows = many(300, 5, ["a", "b"]) + [(900, "same same", "en", "a", 1)] * 3 + [(None, "no id", "en", "b", 1)]
    docs = documents(rows, "1 as _own;2 as _of;3 as _hash;4 as _copies;5 as _rows;6 as _one")
    copies = {}
    for r in mixing.copies(docs, ["doc_id"], "source", "text").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r._copies
    got = {}
    for r in mixing.mix(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in copies.items() if n}
    assert mixing.mix(documents([])).collect() == []
