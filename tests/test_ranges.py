from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import ranges


def rows_of(spark, n=4000):
    draw = np.random.default_rng(5)
    names = ["a", "b", None, "c"]
    made = [(names[min(3, int(g))], float(v) if v >= 0 else None, int(w)) for g, v, w in zip(
        draw.choice(4, n, p=[0.7, 0.1, 0.15, 0.05]), draw.integers(-20, 300, n), draw.integers(0, 9, n))]
    return made, spark.createDataFrame(made, "g string, v double, w long")


def test_positions_count_each_group_through_all_pieces(spark):
    made, df = rows_of(spark)
    found = ranges.positions(df, ["g"], [F.col("v").asc_nulls_first()]).collect()
    by = defaultdict(list)
    for r in found:
        by[r.g].append((r.position, r.v, r["size"]))
    assert len(found) == len(made)
    for g, some in by.items():
        some.sort()
        assert [p for p, _, _ in some] == list(range(len(some)))
        assert {n for _, _, n in some} == {sum(x[0] == g for x in made)}
        values = [v for _, v, _ in some]
        assert values == sorted(values, key=lambda v: (v is not None, v))


def test_running_sums_equal_a_loop(spark):
    made, df = rows_of(spark)
    one = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    found = ranges.running(one, ["g"], [F.col("v").desc_nulls_last()], {"upto": F.col("w")}, {"all": "upto"}).collect()
    expected, whole = defaultdict(int), defaultdict(int)
    for g, _, w in made:
        whole[g] += w
    for g, v in {(g, v) for g, v, _ in made}:
        expected[g, v] = sum(
            w for h, u, w in made if h == g and (v is None or (u is not None and u >= v))
        )
    assert {(r.g, r.v): (r.upto, r["all"]) for r in found} == {k: (n, whole[k[0]]) for k, n in expected.items()}


@pytest.mark.parametrize("group", [[], ["g"]])
def test_empty_tables_stay_empty(spark, group):
    df = spark.createDataFrame([], "g string, v double, w long")
    assert ranges.positions(df, group, [F.col("v")]).collect() == []
    assert ranges.running(df, group, [F.col("v")], {"s": F.col("w")}).collect() == []


def test_one_value_in_all_rows_is_still_cut(spark):
    df = spark.range(0, 20000, 1, 8).select(F.lit("a").alias("g"), F.lit(1.0).alias("v"), F.col("id").alias("tie"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    pieces = ranges.in_pieces(df, ["g"], [F.col("v"), F.col("tie")]).groupBy("_range_piece").count().collect()
    spark.conf.set(name, "true")
    assert len(pieces) > 1 and max(r["count"] for r in pieces) < 10000
