import numpy as np
import pytest

from vigil.operators import evaluate as E
from vigil.operators import profile as R
from vigil.operators import quality as Q
from vigil.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
NAN = float("nan")


@pytest.mark.parametrize("accuracy", [100, 50_000])
def test_equal_to_numpy_per_group(spark, accuracy):
    draw = np.random.default_rng(1)
    values = {
        "wide": draw.lognormal(0, 3, 4000), "few": draw.integers(0, 9, 5000) / 10, "one": np.array([4.5]),
        "two": np.array([1.0, 2.0]), None: draw.normal(size=700), "same": np.full(900, -7.25),
    }
    rows = [(g, float(v)) for g, some in values.items() for v in some] + [("wide", None), ("wide", NAN), ("empty", None)]
    found = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", FRACTIONS, accuracy).collect()
    assert {r.g for r in found} == set(values)
    for r in found:
        np.testing.assert_allclose(r.quantiles, np.quantile(values[r.g], FRACTIONS), rtol=1e-12)


@pytest.fixture
def no_small_tables(spark):
    """Tables of any size are joined like large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values_of_a_group_do_not_meet_in_one_task(spark, no_small_tables):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(700)], "a int, b double")
    found = R.describe(df, ["a", "b"]).orderBy("column")
    assert [r.p50 for r in found.collect()] == [3.0, 349.5]
    values = exact_quantiles(df, ["a"], "b", [0.5])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in values and "SortMergeJoin" not in values


def scored(spark):
    rows = [(1, 0.9), (0, 0.2), (0, None), (1, NAN)]
    return spark.createDataFrame(rows, "y int, s double")


def test_missing_scores_are_not_high_scores(spark):
    df = scored(spark)
    curve = {r.threshold: r.precision for r in E.pr_curve(df, "y", "s").collect()}
    assert set(curve) == {0.9, 0.2} and curve[0.9] == 1.0
    (row,) = E.probability_metrics(df, "y", "s").collect()
    assert row.brier == pytest.approx((0.1**2 + 0.2**2) / 2)
    (row,) = E.threshold_metrics(df, "y", "s", 0.5).collect()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 0, 1, 2)
    assert sum(r["rows"] for r in E.reliability(df, "y", "s", 2).collect()) == 2
    same = {"coef": 1.0, "intercept": 0.0}
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(E.apply_calibration(F.col("s"), same)).collect()]
    assert got[0] == pytest.approx(0.9) and got[2] is None and got[3] is None


def test_ranking_of_very_large_counts(spark):
    curve = spark.createDataFrame(
        [(0.5, 4_000_000_000, 8_000_000_000, 4_000_000_000, 4_000_000_000, 8_000_000_000, 0.5)],
        "threshold double, tp long, n long, cum_tp long, positives long, total long, precision double",
    )
    (row,) = E.ranking_metrics(curve).collect()
    assert row.roc_auc == pytest.approx(0.5)


def test_row_hash_tells_where_nulls_are(spark):
    left = spark.createDataFrame([("a", None)], "x string, y string")
    right = spark.createDataFrame([(None, "a")], "x string, y string")
    assert not Q.same_content(left, right, ["x", "y"])
    assert Q.same_content(left, left, ["x", "y"])


def test_null_clusters_are_numbered(spark):
    from vigil.operators.ordered import number_rows

    rows = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert sorted(r.n for r in number_rows(rows, "k", "n").collect()) == [0, 1, 2]


def test_outliers_do_not_shuffle_values_by_column(spark, no_small_tables):
    df = spark.createDataFrame([(float(i),) for i in [*range(1, 100), 1000]], "a double")
    found = R.outlier_share(df, ["a"])
    (row,) = found.collect()
    q1, q3 = np.quantile([*range(1, 100), 1000], [0.25, 0.75])
    assert (row.q1, row.q3, row.iqr, row.outside_percent) == (q1, q3, q3 - q1, 1.0)
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
