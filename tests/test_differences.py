from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import differences as D

COLUMNS = ["k", "v", "w"]


def made(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, w double")


def test_rows_that_differ_are_named(spark):
    rows = [(i, f"v{i % 7}", float(i % 3)) for i in range(3000)] + [(None, None, None), (None, "x", None)]
    other = [r for r in rows if r[0] != 17] + [(17, "changed", 2.0), (9999, "new", None), rows[5], rows[5], (None, None, 1.0)]
    found = D.differing_rows(made(spark, rows), made(spark, other), ["k"], COLUMNS).collect()
    left, right = Counter(rows), Counter(other)
    expected = {(*r, "left", n) for r, n in (left - right).items()} | {(*r, "right", n) for r, n in (right - left).items()}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("rows", [[], [(1, "a", 1.0)], [(i % 10, None, None) for i in range(500)]])
def test_equal_tables_have_no_differences(spark, rows):
    a, b = made(spark, rows), made(spark, rows[::-1])
    assert D.differing_rows(a, b, ["k"], COLUMNS).collect() == []
    assert D.differing_buckets(D.tree(a, ["k"], COLUMNS), D.tree(b, ["k"], COLUMNS)).collect() == []


def test_levels_add_up(spark):
    tree = D.tree(made(spark, [(i, "a", 0.5) for i in range(1000)]), ["k"], COLUMNS)
    sums = tree.groupBy("level").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest")).collect()
    assert len(sums) == len(D.LEVELS) and {r["rows"] for r in sums} == {1000} and len({r["digest"] for r in sums}) == 1


def test_one_changed_value_leads_to_one_bucket(spark):
    rows = [(i, "a", 0.5) for i in range(1000)]
    a, b = made(spark, rows), made(spark, [*rows[:500], (500, "b", 0.5), *rows[501:]])
    assert D.differing_buckets(D.tree(a, ["k"], COLUMNS), D.tree(b, ["k"], COLUMNS)).count() == 1
