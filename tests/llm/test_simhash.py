import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import graphs, simhash


def brute_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def near_pairs(fps):
    values = np.array(fps, dtype=np.uint64)
    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ value) <= 4):
            yield fps[i], fps[i + 1 + j]


def test_every_word_has_one_or_six_codewords():
    _, count = simhash.coset_errors()
    assert sorted(set(count.tolist())) == [1, 6] and len(count) == 2048


def test_words_at_four_bits_share_a_key():
    keys, draw = simhash.key_maker(), np.random.default_rng(5)
    for _ in range(3000):
        a = draw.integers(0, 1 << 64, dtype=np.uint64)
        b = a
        for bit in draw.choice(64, draw.integers(1, 5), replace=False):
            b ^= np.uint64(1 << int(bit))
        first, second = (set(keys(np.array([x]))[0].tolist()) for x in (a, b))
        assert first & second


@pytest.mark.parametrize("size", [3, 40, 400])
def test_links_of_a_bucket_connect_what_all_pairs_connect(size):
    draw = np.random.default_rng(size)
    centres = draw.integers(0, 1 << 64, 3, dtype=np.uint64)
    fps = set()
    for _ in range(size):
        value = centres[draw.integers(3)]
        for bit in draw.choice(64, draw.integers(0, 7), replace=False):
            value ^= np.uint64(1 << int(bit))
        fps.add(int(value))
    fps = sorted(fps)
    array = np.array(fps, dtype=np.uint64)
    for links in (np.concatenate(simhash.bucket_links(array)), simhash.run_links(np.zeros(len(fps), np.int64), array)):
        pairs = [(int(a), int(b)) for a, b in links]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        assert brute_components(fps, pairs) == brute_components(fps, near_pairs(fps))


def near_copies(count, rng):
    """Texts in groups of copies that differ in some words, and a large tight group."""
    words = [f"w{i}" for i in range(500)]
    texts = []
    for group in range(count):
        base = rng.choices(words, k=rng.randint(1, 120))
        for _ in range(rng.choice([1, 1, 2, 6, 40 if group == 0 else 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_components_equal_brute_force(spark, documents, sample):
    texts = near_copies(60, random.Random(2)) + [r.text for r in sample.select("text").collect()]
    texts += [None, "", " \t", "one", "ONE", "two words", "a b c d", "a b c d e", "x " * 50_000]
    docs = documents(list(enumerate(texts, 1000)), "'c' as fingerprint;1 as component;2 as label;3 as _first")
    rows = simhash.near_duplicates(docs, ["doc_id"]).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts, 1000)}
    assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in rows} == fps
    distinct = sorted(set(fps.values()))
    label = brute_components(distinct, near_pairs(distinct))
    smallest = {}
    for i, fp in fps.items():
        smallest[label[fp]] = min(i, smallest.get(label[fp], i))
    assert {r.doc_id: r.component_id for r in rows} == {i: smallest[label[fp]] for i, fp in fps.items()}


def test_nulls_repeats_and_empty_tables(spark, documents):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents([(None, text), (7, text), (7, text), (3, "other words here"), (None, "alone in here")])
    rows = simhash.near_duplicates(docs, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 7), (3, 3), (7, 7), (7, 7)]
    assert simhash.near_duplicates(documents([]), ["doc_id"]).collect() == []
    kept = simhash.keep_one(docs.withColumns({"_own": F.lit(1), "_of": F.lit(2), "component": F.lit(3)})).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 7]
    assert simhash.keep_one(documents([])).collect() == []
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, ["doc_id"], bits=3)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (5000, 4000), (4000, 5000)]
    rows = graphs.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for pair in links for n in pair}
    assert {r.node: r.label for r in rows} == brute_components(nodes, links)
    assert len(rows) == len(nodes)
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)]
    rows = graphs.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = brute_components({n for pair in links for n in pair}, links)
    assert {r.node: r.label for r in rows} == {n: expected[n] for n in {n for a, b in links if a != b for n in (a, b)}}
