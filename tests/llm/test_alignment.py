from bisect import bisect_left
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vigil.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b\n\n  c\t", "x \n  y", "é中\U0001f600 it's 've 12\x01", "\x1c  z \x85 q",
    "nul\x00 here", "▁x", "a ▁ b", "ab" * 3000, "<|endoftext|> <s> <0x41> </s>", "tab\t x", "same text", "same text",
    "  　 w", "line\n line\n  line", "١٢٣ 456", "naïve Ǆ ﬁ", " " * 40 + "x" + " " * 7,
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, tokenizers):
    """Measures of each text by sets of end offsets over whole texts, counts over all texts."""
    a, b = tokenizers
    back = {ord(k): v for k, v in alignment.byte_letters().items()}
    every = []
    for text in texts:
        none = ([], [], [], [])
        if not text:
            every.append(none)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(back[ord(c)] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            every.append(none)
            continue
        ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, before = [], [], 0
        place_a, place_b = dict(zip(ends_a, ids_a)), dict(zip(ends_b, ids_b))
        by_group_a, by_group_b = defaultdict(list), defaultdict(list)
        for e, i in zip(ends_a, ids_a):
            by_group_a[bisect_left(common, e)].append(i)
        for e, i in zip(ends_b, ids_b):
            by_group_b[bisect_left(common, e)].append(i)
        for g, e in enumerate(common):
            groups.append(",".join(map(str, by_group_a[g])) + "|" + ",".join(map(str, by_group_b[g])))
            links.append((place_a[e], place_b[e]))
        every.append((ids_a, ids_b, groups, links))
    counts = Counter(x for _, _, _, links in every for x in links)
    highest = defaultdict(int)
    for (_, i), n in counts.items():
        highest[i] = max(highest[i], n)
    out = []
    for number, (ids_a, ids_b, groups, links) in enumerate(every):
        best = sum(counts[x] == highest[x[1]] for x in links)
        written = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        total = sum(counts[x] for x in links)
        out.append((number, len(ids_a), len(ids_b), len(groups), len(links), best, total, written))
    return out


def found(docs):
    rows = queries.alignment_rows(docs).collect()
    names = ["doc_id", *alignment.MEASURES, "groups_sha256"]
    return sorted(tuple(r[n] for n in names) for r in rows)


@pytest.mark.parametrize("block", [1 << 22, 2000])
def test_equals_brute_force_in_any_blocks(spark, documents, sample, tokenizers, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    texts = [r.text for r in sample.select("text").collect()] + ODD
    docs = documents(list(enumerate(texts)), "1 as n_a;'x' as digest;'y' as block")
    assert found(docs) == brute(texts, tokenizers)


def test_copies_count_as_often_as_they_occur(spark, documents, tokenizers):
    texts = ["one two"] * 500 + ["one three"] * 3
    assert found(documents(list(enumerate(texts)))) == brute(texts, tokenizers)


def test_empty_table_and_null_ids(spark, documents):
    assert found(documents([])) == []
    assert found(documents([(1, None), (2, "")])) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
    rows = queries.alignment_rows(documents([(None, "a b"), (None, None)])).collect()
    assert sorted((r.doc_id, r.n_links) for r in rows) == [(None, 0), (None, 2)]


def test_cuts_agree_with_whole_texts_for_every_kind_of_space(tokenizers):
    a, b = tokenizers
    aligner = alignment.Vocabularies(A, B).aligner()
    assert aligner.cuts
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() or c < 33 and c > 0] + ["​", "﻿"]
    for s in spaces:
        for text in (f"x{s} y", f"x {s}y", f"{s}  y", f"x{s}{s} y  {s}", f"1{s} '{s}s"):
            parts = aligner.pieces(text)
            ids = [i for p in parts for i in a.encode(" " + p, add_special_tokens=False).ids]
            assert ids == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
            ids = [i for p in parts for i in (b.encode(p) or [aligner.space])]
            assert ids == b.encode(text), repr(text)


def test_remembered_pieces_are_bounded(spark, documents, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    texts = [f"alpha beta{i} gamma{i}" for i in range(100)]
    assert found(documents(list(enumerate(texts)))) == brute(texts, tokenizers)
