import re

from vigil.llm import repeats

PASSAGE = "here is a passage of quite a few words that many documents share without any change. And it goes on for a while with more and more words in it."


def brute(rows):
    """Spans that go, from all units of all documents in order of rank."""
    seen, lost = {}, {}
    for doc, text in sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        spans, start = [], 0
        for line in text.split("\n"):
            spans.append((start, start + len(line), 6))
            at = start
            for part in re.split(r"(?<=[.!?]) ", line):
                spans.append((at, at + len(part), 8))
                at += len(part) + 1
            start += len(line) + 1
        here = {}
        for a, b, least in sorted(spans, key=lambda s: (s[0], -s[1])):
            words = text[a:b].lower().split()
            if len(words) < least:
                continue
            key = " ".join(words)
            if key in here and a < here[key]:
                continue
            if key in here or seen.setdefault(key, doc) != doc:
                lost.setdefault((doc, text), []).append((a, b))
            here.setdefault(key, b)
    return lost


def covered(spans):
    return {i for a, b in spans for i in range(a, b)}


def test_equals_brute_force(spark, documents, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    rows += [(1001, PASSAGE), (1002, "x y z. " + PASSAGE + " tail"), (1003, PASSAGE.upper().replace(" ", "  "))]
    rows += [(1004, PASSAGE + "\n" + PASSAGE + "\nshort line"), (1005, "\n".join([PASSAGE] * 200)), (1006, "Is onhe. " * 5000)]
    got = repeats.remove_repeats(documents(rows, "'x' as removed;1 as _key;2 as _spans")).collect()
    lost, texts = brute(rows), dict(rows)
    assert len(got) == len(rows)
    for row in got:
        whole = texts[row.doc_id]
        gone = covered((s.start, s.end) for s in row.removed)
        assert gone == covered(lost.get((row.doc_id, whole), []))
        assert row.text == "".join(c for i, c in enumerate(whole) if i not in gone)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1001].text == PASSAGE and len(by_id[1002].text) < 20 and by_id[1003].text.strip() == ""
    assert by_id[1004].text.strip() == "short line"


def test_nulls_repeats_ties_and_empty(spark, documents):
    docs = documents([(5, PASSAGE), (5, PASSAGE), (6, None), (7, ""), (None, PASSAGE), (2, "one. " + PASSAGE + " end of it")])
    got = repeats.remove_repeats(docs).collect()
    texts = sorted((r.doc_id or 0, r.text) for r in got if r.text is not None)
    assert len(got) == 6 and [r.text for r in got if r.doc_id == 6] == [None]
    kept = [t for d, t in texts if "passage" in t]
    assert kept == ["one. " + PASSAGE + " end of it"]  # the smallest id keeps it; both rows of id 5 lose it
    assert texts[0][0] == 0 and "passage" not in texts[0][1]
    assert repeats.remove_repeats(documents([])).collect() == []


def test_clean_documents_stay(spark, documents):
    rows = [(i, f"Every line of document {i} has its own words number {i} and nothing more.\nTo be.") for i in range(50)]
    got = repeats.remove_repeats(documents(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows


def test_overlapping_occurrences_in_one_document_are_one():
    found = repeats.units("one two three four five six seven eight ")
    assert len(found) == 1
