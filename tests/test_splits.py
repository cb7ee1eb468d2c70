import datetime as dt

import pytest
from moments import moment
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import quality as Q
from vigil.operators import splits as SP
from vigil.operators.contracts import monthly_feature_names, panel_feature_names, validate_features

DAY = dt.timedelta(days=1)


def split(spark, *days):
    rows = [("a", moment(d), y) for d in days for y in (0,)] + [("b", moment(d), 1) for d in days]
    return spark.createDataFrame(rows, "entity_id string, prediction_time timestamp_ntz, y int")


def test_windows_of_two_days_are_purged(spark):
    later = split(spark, "2025-01-01")
    test = split(spark, "2025-06-01")
    fine = {"train": split(spark, "2024-12-30"), "validation": later, "test": test}
    assert SP.validate(fine, "y").count() == 3
    with pytest.raises(Q.AuditError, match="overlap"):
        SP.validate({**fine, "train": split(spark, "2024-12-31")}, "y")


def test_missing_labels_are_refused(spark):
    bad = split(spark, "2024-12-30").withColumn("y", F.when(F.col("y") == 1, 1))
    with pytest.raises(Q.AuditError):
        SP.validate({"train": bad}, "y")


@pytest.mark.parametrize("name", ["channel_id", "target_end", "last_seen", "Events", "target_x"])
def test_names_that_are_no_features(name):
    with pytest.raises(ValueError):
        validate_features(["events_1d", name])


def test_feature_lists():
    assert len(panel_feature_names()) == 68
    names = monthly_feature_names(fv.CONTRACT_FEATURES)
    assert len(names) == len(set(names)) == 27 + 22 + 17
    with pytest.raises(ValueError):
        validate_features(["a", "a"])


def delivery(spark, **changes):
    base = {
        "feature_max_ts": F.col("prediction_time") - F.expr("interval 1 hour"),
        "target_start": F.col("prediction_time") + F.expr("interval 24 hours"),
        "target_end": F.col("prediction_time") + F.expr("interval 48 hours"),
        "sensor_type_current": F.lit("Датчик дыма"),
        "at_risk_with_history": F.lit(True),
        "last_explicit_state": F.lit(fv.NORMAL),
        "channel_followup_48h": F.lit(True),
        "global_complete_24_48h": F.lit(True),
        "sample_weight": F.lit(1.0),
        "sampling_probability": F.lit(1.0),
        **{f: F.lit(1.0) for f in fv.CONTRACT_FEATURES},
    }
    splits = {}
    years = {"train_compact": 2020, "validation": 2021, "test": 2022, "scoring_latest": 2023}
    for name, year in years.items():
        rows = [(i, dt.datetime(year, 2, 1), i % 2) for i in (1, 2)]
        schema = "channel_id long, prediction_time timestamp_ntz, target_fault_24_48h int"
        df = spark.createDataFrame(rows, schema).withColumns(base)
        splits[name] = df.withColumns(changes) if name == "train_compact" else df
    return splits


def test_a_clean_delivery_passes(spark):
    report = Q.audit_splits(delivery(spark), fv.CONTRACT_FEATURES, "target_fault_24_48h")
    assert report.where("split = 'test'").first()["positives"] == 1


@pytest.mark.parametrize(
    "column, value",
    [
        ("feature_max_ts", "prediction_time"),
        ("target_start", "prediction_time"),
        ("sample_weight", "20.0"),
        ("at_risk_with_history", "false"),
        ("last_explicit_state", "'x'"),
        ("target_fault_24_48h", "2"),
        ("global_complete_24_48h", "cast(null as boolean)"),
    ],
)
def test_corruptions_are_found(spark, column, value):
    broken = delivery(spark, **{column: F.expr(value)})
    with pytest.raises(Q.AuditError, match="train_compact"):
        Q.audit_splits(broken, fv.CONTRACT_FEATURES, "target_fault_24_48h")


def test_sampled_splits_need_weights(spark):
    splits = delivery(spark)
    splits["train_compact"] = splits["train_compact"].drop("sample_weight")
    with pytest.raises(ValueError, match="sample_weight"):
        Q.split_audit(splits, fv.CONTRACT_FEATURES, "target_fault_24_48h")


def test_compact_keeps_positives_and_weights(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("channel_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("prediction_time"),
        (F.col("id") < 100).cast("int").alias("y"),
    )
    found = SP.compact(rows, "y")
    assert found.where("y = 1").count() == 100
    assert 100 < found.where("y = 0").count() < 300
    assert Q.weight_check(found).first()["invalid_weights"] == 0
    assert SP.compact(rows.repartition(7), "y").exceptAll(found).count() == 0


def test_hash_sample_equals_a_full_sort(spark):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("channel_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("prediction_time"),
    )
    from vigil.functions.scalars import row_order

    order = row_order([F.col("channel_id"), F.col("prediction_time")], 42)
    expected = rows.orderBy(order).limit(700)
    found = SP.hash_sample(rows, 700)
    assert found.count() == 700 and found.exceptAll(expected).count() == 0


def test_unseen_ignores_null(spark):
    train = spark.createDataFrame([("x",), (None,)], "o string")
    rows = spark.createDataFrame([("x",), ("y",), (None,)], "o string")
    found = {r["o"]: r["new"] for r in SP.mark_unseen(rows, train, "o", "new").collect()}
    assert found == {"x": False, "y": True, None: False}


def test_roles_and_folds(spark):
    rows = spark.createDataFrame(
        [(moment("2024-11-30"),), (moment("2024-12-15"),), (moment("2025-01-01"),)],
        "prediction_time timestamp_ntz",
    )
    found = SP.roles(rows, ["2025-01-01", "2025-07-01", "2026-01-01"], 31).collect()
    assert sorted(r["role"] for r in found) == ["train", "tune"]
    end = F.col("prediction_time") + F.expr("interval 48 hours")
    folds = SP.expanding_folds(rows.withColumn("target_end", end), [2024, 2025]).collect()
    assert sorted((r["fold"], r["role"]) for r in folds) == [
        (2024, "validation"),
        (2024, "validation"),
        (2025, "train"),
        (2025, "train"),
        (2025, "validation"),
    ]
