import base64
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vigil.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    None, "", " ", "a  b\n\n  c\t", "é中\U0001f600 it's 've 12\x00\x01", " " * 50 + "x", "ab" * 30000,
    "<|endoftext|>", "▁x Āǿ", "same", "same",
]


@pytest.fixture(scope="module")
def reference():
    lines = Path(PATH).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip_equal_the_reference(spark, documents, sample, reference):
    texts = [r.text for r in sample.select("text").collect()] + ODD
    docs = documents(list(enumerate(texts)), "1 as ids;'x' as decoded;'y' as _text")
    got = bpe.decode(bpe.encode(docs, ["doc_id"], PATH, PATTERN), ["doc_id", "ids"], PATH).collect()
    once = bpe.round_trip(docs, ["doc_id"], PATH, PATTERN).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in once) == sorted((r.doc_id, r.ids, r.decoded) for r in got)
    assert len(got) == len(texts)
    for row in got:
        text = texts[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_empty_table_and_null_ids(spark, documents):
    assert bpe.encode(documents([]), ["doc_id"], PATH, PATTERN).collect() == []
    rows = spark.createDataFrame([(None, None)], "doc_id long, ids binary")
    assert [bytes(r.decoded) for r in bpe.decode(rows, ["doc_id"], PATH).collect()] == [b""]


def test_remembered_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    pieces = bpe.read_ranks(PATH)
    encode = bpe.encoder(bpe.model_bytes(pieces), pieces, PATTERN)
    texts = [f"alpha beta{i} gamma{i}" for i in range(50)]
    once = encode(texts)
    assert [encode([t])[0] for t in texts] == once


def test_ids_beyond_the_vocabulary_are_refused():
    decode = bpe.decoder(bpe.read_ranks(PATH))
    with pytest.raises(ValueError):
        decode(np.array([50256], dtype="<u4").tobytes())


def test_rank_files_with_gaps_are_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))
