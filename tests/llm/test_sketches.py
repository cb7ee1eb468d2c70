import re
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from vigil.llm import queries, sketches

ODD = [
    None, "", " ", "a", "a b c d e f", "a b c d e f", "é中\U0001f600 \x0b x y " * 9, "x" * 200_000,
    "same words over and over " * 3000, " lead and trail ", "one two three four five", "\x1c a \x85 b", "a b  c\n\nd\te",
]


def brute_sketch(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = sorted(md5(s.encode()).hexdigest()[:16] for s in shingles)
    low = [x for x in hashes if x < "1"]
    return low if len(low) >= 16 else hashes[:16]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    seen = [x for x in a if len(b) < 16 or x < "1" or x <= b[-1]]
    return len(set(seen) & set(b)) / len(seen) if seen else 0.0


def brute(rows):
    """All rows in one list, by descending id (none last), then digest of id and text."""
    order = sorted(
        ((i, t or "") for i, t in rows),
        key=lambda r: (r[0] is None, -(r[0] or 0), sha256(f"{'-' if r[0] is None else r[0]} {r[1]}".encode()).digest()),
    )
    out = []
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, new = brute_sketch(text), brute_sketch(after), brute_sketch(edited)
        out.append(
            (i, len(text), sha256(edited.encode()).hexdigest(), "".join(own), "".join(new),
             brute_likeness(own, new), brute_likeness(own, other))
        )
    return sorted(out, key=repr)


def found(docs):
    return sorted(map(tuple, queries.sketch_rows(docs).collect()), key=repr)


def test_equals_brute_force(spark, documents, sample):
    texts = [r.text for r in sample.select("text").collect()] + ODD
    rows = list(enumerate(texts))
    docs = documents(rows, "1 as _id;'x' as sketch;'y' as _text;2 as _pos")
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("repeats", [1 << 16, 3])
def test_ties_repeated_rows_and_null_ids(spark, documents, monkeypatch, repeats):
    monkeypatch.setattr(sketches, "REPEATS", repeats)
    rows = [(7, "a b c d e f g h i")] * 10 + [(7, "another text of the same id")] * 2 + [(None, "no id at all")] * 3
    rows += [(None, None), (3, None), (9, "x y z"), (9, ""), (9, "")]
    assert found(documents(rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one document here")], [(1, None)], [(1, "twice here")] * 2])
def test_small_tables(spark, documents, rows):
    assert found(documents(rows)) == brute(rows)


def test_sketches_merge_and_tell_containment(spark):
    words = [f"w{i * i % 100_003}" for i in range(30_000)]
    long, short, apart = " ".join(words), " ".join(words[5000:6000]), " ".join(f"z{i}" for i in range(1000))
    row = spark.createDataFrame([(long, short, apart)], "a string, b string, c string").select(
        *[sketches.sketch(F.col(x)).alias(x) for x in "abc"]
    )
    got = row.select(
        sketches.containment(F.col("b"), F.col("a")).alias("inside"),
        sketches.containment(F.col("a"), F.col("b")).alias("covered"),
        sketches.containment(F.col("c"), F.col("a")).alias("none"),
        sketches.merged(F.col("a"), F.col("c")).alias("both"),
        sketches.merged(F.col("b"), F.col("a")).alias("same"),
        "a", "c",
    ).first()
    assert got.inside == 1.0 and got.none == 0.0 and 0 < got.covered < 0.08
    assert got.same == got.a and set(got.both) == set(x for x in [*got.a, *got.c] if x < "1")


def test_plan_runs_no_python(spark, documents):
    plan = queries.sketch_rows(documents([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
