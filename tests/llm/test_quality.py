import zlib

import numpy as np

from vigil.llm import quality


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    trees = quality.learn(docs, labels)
    rows = quality.score(docs.join(labels, "doc_id"), trees, ["doc_id", "quality"]).collect()
    unseen = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good = np.array([r.score for r in unseen if r.quality == 1])
    bad = np.array([r.score for r in unseen if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert np.mean([(r.score >= 0.7) == r.quality for r in unseen]) > 0.98


def test_walk_equals_a_walk_row_by_row():
    draw = np.random.default_rng(3)
    rows = draw.random((500, 4))
    labels = ((rows[:, 0] > 0.4) ^ (rows[:, 1] > 0.7)).astype(float)
    trees = quality.fit(rows, labels, trees=12, depth=3)

    def one(row):
        raw = trees.base
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > limit[at])
            raw += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-raw))

    np.testing.assert_allclose(quality.walk(trees, rows), [one(r) for r in rows])
    assert ((quality.walk(trees, rows) > 0.5) == labels).mean() > 0.97


def test_edges(spark, documents):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = ["Some words in a line. " * (i % 7 + 1) if i % 2 else "##$$ %% &&" * (i % 5 + 1) for i in ids]
    docs = documents(list(zip(ids, texts)), "1 as score;2 as statistics;3 as quality")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], None), (None, 1)], "doc_id long, quality int")
    trees = quality.learn(docs.union(docs), labels)
    odd = [(1, None), (2, ""), (3, " \n\t"), (None, "Some words in a line. "), (5, "é" * 100_000), (5, "é" * 100_000)]
    got = quality.score(documents(odd), trees, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[4].score == got[5].score and got[3].score > 0.5
    assert quality.score(documents([]), trees, ["doc_id"]).collect() == []


def test_no_labels_and_one_class(spark, documents):
    docs = documents([(i, "text") for i in range(20)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, none), ["doc_id"]).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score(docs, quality.learn(docs, ones), ["doc_id"]).collect())


def test_sample_is_bounded(spark, documents, monkeypatch):
    docs = documents([(i, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: sizes.append(len(rows)))
    quality.learn(docs, labels, rows=50)
    assert 20 <= sizes[0] <= 50
