import base64
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from vigil.llm import langid, mixing, personal
from vigil.llm.queries import QUERIES
from vigil.session import materialize

from test_simhash import brute_components, brute_fingerprint, near_pairs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), name)
        out.append((name, docs.collect()))
    return dict(out)


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry.queries())
    assert {"op3_secrets", "op9_pivot_search", "op10_repeats", "op12_merkle_manifest"} <= set(entry.oracle_sql())


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"_key": F.lit(1), "rejected": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS


def test_language_stage_drops_what_is_rejected(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    classify = langid.classifier(langid.learn(docs))
    expected = {r.doc_id for r in stages["documents"] if not classify(r.text)[3]}
    assert {r.doc_id for r in stages["language_id"]} == expected
    assert len(expected) >= 0.98 * len(stages["documents"])


def test_one_document_of_each_group_stays(stages):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in stages["language_id"]}
    label = brute_components(set(fps.values()), near_pairs(sorted(set(fps.values()))))
    first = {}
    for doc, fp in sorted(fps.items()):
        first.setdefault(label[fp], doc)
    assert sorted(r.doc_id for r in stages["near_duplicates"]) == sorted(first.values())


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r for r in stages["near_duplicates"]}
    assert set(before) == {r.doc_id for r in stages["personal_data"]}
    changed = 0
    for row in stages["personal_data"]:
        old = before[row.doc_id]
        assert not personal.base_spans(row.text)
        if personal.base_spans(old.text):
            changed += 1
            assert row.text != old.text and row.n_chars == len(row.text)
        assert (row.lang, row.source) == (old.lang, old.source)
    assert changed


def test_mix_reaches_its_targets(stages):
    texts = {r.doc_id: r for r in stages["personal_data"]}
    size = {d: len(r.text.encode().split()) for d, r in texts.items()}
    total, taken = {}, {}
    for d, r in texts.items():
        total[r.source] = total.get(r.source, 0) + size[d]
    for r in stages["mixed_sources"]:
        assert r == texts[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) < 0.15 * sum(total.values())
    assert all(taken.get(s, 0) <= 2 * n for s, n in total.items())


def test_token_ids_equal_the_reference(stages):
    lines = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages["mixed_sources"]}
    assert len(stages["token_ids"]) == len(stages["mixed_sources"])
    for row in stages["token_ids"]:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(texts[row.doc_id]) and len(ids) == row.n_tokens and row.decodes


def test_odd_rows_pass_all_stages(spark, documents):
    prose = "Some plain words that make a sentence of a language, and some more of it. "
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "12 34", "en", None, 5)]
    rows += [(10 + i, prose + f"number {i} of many", "en", None if i % 2 else "a", 9) for i in range(20)]
    rows += [(None, prose + "without an id", None, "b", None), (40, prose * 2000, "en", "b", 3)] + [(41, prose + "twice", "en", "a", 1)] * 2
    docs = documents(rows, "1 as score;2 as lang_pred;3 as ids")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), "stage")
    assert all(r.decodes for r in docs.collect()) and docs.count() > 0
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), "stage")
    assert docs.collect() == []


def test_run_gives_the_last_stage(spark, stages):
    rows = QUERIES["pipeline"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r.doc_id, r.n_tokens) for r in stages["token_ids"])
    assert mixing.WEIGHTS == (3.0, 1.0, 2.0)
