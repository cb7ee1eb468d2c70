import datetime as dt

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import profile as R


def rows(spark, data):
    kinds = "channel_id string, events_1d long, events_7d long, dow int, target_fault_0_24h tinyint, last_seen timestamp_ntz, other double"
    return spark.createDataFrame(data, kinds)


def test_every_column_has_a_row(spark):
    seen = dt.datetime(2024, 1, 1)
    panel = rows(spark, [("a", 1, 5, 3, 1, seen, None), ("b", 1, 6, None, 0, seen, 2.0), ("c", 1, 7, 4, None, seen, 2.0)])
    found = {r["column"]: r for r in R.feature_dictionary(panel, F.col("channel_id") != "c").collect()}
    assert list(found) == panel.columns
    assert {c: r.role for c, r in found.items() if r.role != "feature"} == {
        "channel_id": "metadata_or_diagnostic",
        "target_fault_0_24h": "label",
        "last_seen": "metadata_or_diagnostic",
        "other": "metadata_or_diagnostic",
    }
    # a feature that varies only outside the training rows, or not at all, is not recommended
    assert {c for c, r in found.items() if r.use_default} == {"events_7d"}
    assert {c for c, r in found.items() if r.is_constant} == {"events_1d", "last_seen", "other"}
    assert {c for c, r in found.items() if r.has_nulls} == {"dow", "target_fault_0_24h", "other"}
    assert found["events_7d"].definition == fv.MEASURE_TEXT["events"] + " за предыдущие 7 суток"
    assert found["other"].definition is None and found["dow"].dtype == "int" and found["dow"].rows == 3


def test_empty_panel(spark):
    found = R.feature_dictionary(rows(spark, [])).collect()
    assert len(found) == 7
    assert all(r.rows == 0 and r.is_constant and not r.has_nulls and not r.use_default for r in found)
