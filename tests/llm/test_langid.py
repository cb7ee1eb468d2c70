import re
import struct
import zlib
from collections import defaultdict

import xxhash
import zstandard

from vigil.llm import langid


def spark_hash(number, *more):
    """Hash of a long, then of integers, each seeded by the one before; signed."""
    found = xxhash.xxh64_intdigest(struct.pack("<q", number), seed=42)
    for i in more:
        found = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=found)
    return found - (1 << 64) if found >> 63 else found


def plain_samples(rows):
    """(lang, rows learned from, sample) in the order in which ties go."""
    classes, count = defaultdict(dict), defaultdict(int)
    for r in rows:
        if r.doc_id is None or r.lang is None or not r.text or zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            continue
        number = spark_hash(r.doc_id)
        count[r.lang] += 1
        old = classes[r.lang].get(number % langid.SAMPLE_ROWS)
        classes[r.lang][number % langid.SAMPLE_ROWS] = min(old or (number, r.text), (number, r.text))
    out = []
    for lang in sorted(count, key=lambda x: (-count[x], x)):
        parts = []
        for number, text in sorted(classes[lang].values()):
            if len(text) > langid.SAMPLE_CHARS:
                part, size = len(text) // 8, langid.SAMPLE_CHARS // 8 - 1
                starts = [part * i + spark_hash(number, i) % max(part - size + 1, 1) for i in range(8)]
                text = "\n".join(text[a : a + size] for a in starts)
            parts.append(text)
        out.append((lang, "\n".join(parts).lower().encode()))
    return out


def plain_sizes(samples, data):
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY, min_match=3, search_log=5, hash_log=17, chain_log=17, window_log=18,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    sums = {}
    for lang, sample in samples:
        words = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=settings)
        tool = zstandard.ZstdCompressor(compression_params=settings, dict_data=words)
        sums[lang] = [sum(len(tool.compress(data[i : i + step])) for i in range(0, len(data), step)) for step in (2048, 64)]
    first = sorted(x[0] for x in sums.values())
    narrow = (first[1] - first[0]) / first[1] < 0.03
    return {lang: x[0] + narrow * x[1] for lang, x in sums.items()}


def test_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, learned = docs.collect(), langid.learn(docs)
    samples = plain_samples(rows)
    assert [x for x, _ in samples] == learned.names and [x for _, x in samples] == learned.samples
    got = {r.doc_id: r for r in langid.identify(docs, learned, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        sizes = plain_sizes(samples, r.text.lower().encode())
        best = min(sizes.values())
        assert got[r.doc_id].lang_pred == next(x for x, size in sizes.items() if size == best)
        assert abs(got[r.doc_id].score - 1 / sum(2.0 ** (best - x) for x in sizes.values())) < 1e-9


def test_learns_from_all_over_a_text(spark, documents):
    """A header in another language, as long as a sample, is not what is learned."""
    head = "the cat and the dog were in the house " * 120
    tail = "le chien et le chat sont dans la maison avec les enfants "
    rows = [(i, head + tail * 800, "fr", "s", 1) for i in range(40)] + [(100 + i, head * 3, "en", "s", 1) for i in range(40)]
    learned = langid.learn(documents(rows))
    assert all(b"maison" in x for name, x in zip(learned.names, learned.samples) if name == "fr")
    got = langid.identify(documents([(1, "avec les enfants dans la maison")]), learned, ["doc_id"]).collect()
    assert got[0].lang_pred == "fr"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.learn(docs), ["doc_id", "lang"]).collect()
    unseen = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_edges(spark, documents):
    words = {"en": "the cat and the dog were in the house ", "fr": "le chat et le chien dans la maison "}
    rows = [(i, w * 20 + str(i), lang, "s", 1) for i, (lang, w) in enumerate(list(words.items()) * 20)]
    learned = langid.learn(documents(rows))
    assert set(learned.names) == {"en", "fr"}
    odd = [(1, None), (2, ""), (3, "12 !? 34"), (4, "the dog and the cat"), (5, words["fr"] * 20_000), (None, "le chien dans la maison"), (4, "the dog and the cat")]
    docs = documents(odd, "'x' as lang_pred;1 as score;2 as _text")
    got = langid.identify(docs, learned, ["doc_id"]).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "fr", "fr", "en"]
    assert [r.rejected for r in got][:3] == [True] * 3 and not any(r.rejected for r in got[3:])
    assert [r.score for r in got][:3] == [0.0] * 3


def test_texts_of_no_learned_language_are_rejected(spark, documents):
    words = {"en": "the cat and the dog were in the house ", "fr": "le chat et le chien dans la maison "}
    rows = [(i, w * 20 + str(i), lang, "s", 1) for i, (lang, w) in enumerate(list(words.items()) * 20)]
    strange = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(3000))
    got = langid.identify(documents([(1, strange)]), langid.learn(documents(rows)), ["doc_id"]).collect()
    assert got[0].rejected


def test_a_language_that_is_left_out_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").cache()
    for left in ("en", "de", "fr", "es"):
        learned = langid.learn(docs.where(docs.lang != left))
        assert left not in learned.names
        rows = langid.identify(docs, learned, ["doc_id", "lang", "text"]).collect()
        strange = [r.rejected for r in rows if r.lang == left and len(r.text.encode()) >= 256]
        short = [r.rejected for r in rows if r.lang == left and 100 <= len(r.text.encode()) < 256]
        others = [r.rejected for r in rows if r.lang != left and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
        assert sum(strange) > 0.9 * len(strange)
        assert sum(short) >= 0.5 * len(short)
        assert sum(others) <= 0.02 * len(others)


def test_nothing_learned(spark, documents):
    docs = documents([(1, "some text", None, "s", 1), (2, None, "en", "s", 1)])
    learned = langid.learn(docs)
    assert learned.names == []
    assert [r.lang_pred for r in langid.identify(docs, learned, ["doc_id"]).collect()] == ["und", "und"]
    assert langid.identify(documents([]), learned, ["doc_id"]).collect() == []


def test_samples_are_bounded_and_skip_held_out_rows(spark, documents):
    rows = [(i, f"<{i}>x" * 3000, "en", "s", 1) for i in range(300)]  # marked, as excerpts cut words
    learned = langid.learn(documents(rows + rows), rows=8, chars=100)
    assert len(learned.samples[0]) <= 8 * 101
    unseen = {str(i) for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    seen = set(re.findall("<([0-9]+)>", learned.samples[0].decode()))
    assert seen and not unseen & seen
