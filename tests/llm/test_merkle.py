import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from vigil.llm import merkle, queries

#: An id whose row claims one more character.
CLAIMED = next(i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 7 == 0), "long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels of a tree, by recursion on pairs."""
    if len(nodes) == 1:
        return [nodes]
    return [nodes, *tree([digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)])]


def siblings_of(rows, at):
    out = []
    for row in rows[:-1]:
        pair = at // 2 * 2
        out.append([n for i, n in enumerate(row[pair : pair + 2], pair) if i != at])
        at //= 2
    return out


def folded(rows, at, leaf):
    for row in rows[:-1]:
        pair = list(row[at // 2 * 2 : at // 2 * 2 + 2])
        pair[at % 2] = leaf
        leaf, at = digest(*pair), at // 2
    return leaf


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified), counted for all rows in one place."""
    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        by[lang].append((doc_id, source, lang, n, text))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in by[g]])
    top = tree([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for place, g in enumerate(order):
        for i, r in enumerate(by[g]):
            doc_id, source, lang, n, text = r
            proof = siblings_of(trees[g], i) + siblings_of(top, place)
            claimed = r
            if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                claimed = (doc_id, source, lang, n + 1, text)
            end = folded(top, place, folded(trees[g], i, leaf_of(claimed)))
            out.append((doc_id, leaf_of(r), trees[g][-1][0], root, digest(*sum(proof, [])), end, end == root))
    return sorted(out, key=repr)


def found(docs):
    return sorted(map(tuple, queries.merkle_rows(docs).collect()), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 70])
def test_trees_of_any_size_equal_brute_force(spark, documents, small_blocks, n):
    rows = [(i * 3, f"text {i}", "en", "a", i) for i in range(n)]
    rows += [(10_000 + i, None, None, None, None) for i in range(n // 3)] + [(20_000, "ü中", "de", "b", 2)]
    assert found(documents(rows)) == expected(rows)


def test_odd_rows_equal_brute_force(spark, documents, small_blocks):
    odd = [None, "", "-", "1:a", "x" * 300_000, "é中\U0001f600", "same", "same"]
    rows = [(i, t, ["en", None, "", "é"][i % 4], "a", 5) for i, t in enumerate(odd)]
    rows += [(None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (7, "again", "en", "a", 2**63 - 1), (*CLAIMED, "en", "a", 2**63 - 1)]
    rows += [(7, "same", "é", "a", 5)] * 13
    rows += [(50 + i, f"{i}", f"l{i:02d}", "a", i) for i in range(40)]
    docs = documents(rows, "'x' as leaf;'y' as root;'z' as _group;1 as _pos")
    assert found(docs) == expected(rows)


def test_a_tampered_row_alone_is_refused(spark, documents):
    rows = [(i, "t", "en", "a", 1) for i in range(300)]
    got = queries.merkle_rows(documents(rows)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert len({r.root for r in got}) == 1


def test_empty_table(spark, documents):
    assert queries.merkle_rows(documents([])).collect() == []


def test_whole_sample_equals_brute_force(spark, sample, small_blocks):
    rows = [tuple(r) for r in sample.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found(sample) == expected(rows)


def test_path_folds_to_the_root(spark, sample):
    rows = merkle.manifest(sample, ["doc_id"], FIELDS, "lang", "doc_id").collect()
    assert all(merkle.fold(r.leaf, r.path) == r.root == r.folded_root for r in rows)
    assert sample.select(F.count("*")).first()[0] == len(rows)
