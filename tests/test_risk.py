import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import quality as Q
from vigil.operators import risk as K

MODELS = {
    "sensor": {"version": "v1", "threshold": 0.5, "target": "target_fault_24_48h"},
    "smoke": {"version": "v2", "threshold": 0.1, "target": "smoke_signal_24_48h"},
}
T0 = dt.datetime(2024, 1, 1)
SCHEMA = (
    "entity_id string, object_id string, sensor_type string, prediction_time timestamp_ntz,"
    " direction string, score double, alarms_7d int, last_explicit_state string"
)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("1", "7", "Датчик дыма", T0, "sensor", 0.9, 3, "норма"),
        ("2", "8", "Контакт", T0, "sensor", 0.25, None, "норма"),
        ("3", "8", "Контакт", T0, "sensor", 0.24, 0, "норма"),
        ("4", "9", "Контакт", T0, "sensor", None, 0, None),
        ("1", "7", "Датчик дыма", T0 - dt.timedelta(days=1), "sensor", 0.8, 3, "норма"),
    ]
    objects = spark.createDataFrame([("7", "Seven")], "object_id string, object_name string")
    return K.prediction_table(spark.createDataFrame(rows, SCHEMA), MODELS, objects)


def test_bands_factors_and_texts(records):
    rows = {r["entity_id"]: r for r in records.where(F.col("prediction_time") == F.lit(T0)).collect()}
    assert [rows[k]["risk"] for k in "1234"] == ["high", "medium", "low", "unavailable"]
    assert rows["1"]["object_name"] == "Seven" and rows["2"]["object_name"] == "8"
    assert rows["1"]["factors"][0]["value"] == 3.0 and rows["2"]["factors"] == []
    assert rows["4"]["recommendation"] == fv.RECOMMEND_NO_SCORE and rows["4"]["state"] == "unknown"
    assert rows["1"]["target_end"] == T0 + dt.timedelta(hours=48)
    assert len(rows["1"]["id"]) == 24


def test_appending_twice_adds_nothing(records):
    assert K.append_new(records, records).count() == 0
    assert K.append_new(records.where("entity_id = '1'"), records).count() == 3


def test_pages_do_not_overlap(records):
    total, first = K.prediction_page(records, 2, 0)
    _, second = K.prediction_page(records, 2, 2)
    assert total == 5
    ids = [r["id"] for r in first.collect()] + [r["id"] for r in second.collect()]
    assert len(set(ids)) == 4
    found, _ = K.prediction_page(records, 10, 0, term="ДАТЧИК ДЫМА")
    assert found == 2
    assert K.active(records, MODELS).count() == 4


def empty_tickets(spark):
    kinds = "id long, prediction_id string, status string, created_at timestamp_ntz,"
    return spark.createDataFrame(
        [], kinds + " updated_at timestamp_ntz, comment string, automatic int"
    )


def test_tickets_open_once_and_follow_the_rules(spark, records):
    now = F.lit(T0).cast("timestamp_ntz")
    latest = K.active(records, MODELS)
    first = K.new_tickets(latest, empty_tickets(spark), now)
    assert [r["id"] for r in first.collect()] == [1]
    assert K.new_tickets(latest, first, now).count() == 0
    wanted = "id long, status string, comment string, at timestamp_ntz"
    jump = spark.createDataFrame([(1, "done", "x", T0), (9, "done", "x", T0)], wanted)
    same, refused = K.apply_changes(first, jump)
    assert same.first()["status"] == "new"
    reasons = {r["id"]: r["reason"] for r in refused.collect()}
    assert reasons == {1: "status change not allowed", 9: "unknown ticket"}
    started, none = K.apply_changes(
        first, spark.createDataFrame([(1, "in_progress", "go", T0)], wanted)
    )
    assert none.count() == 0 and started.first()["status"] == "in_progress"
    done, _ = K.apply_changes(started, spark.createDataFrame([(1, "done", "ok", T0)], wanted))
    assert done.first()["status"] == "done"
    assert K.new_tickets(latest, done, now).first()["id"] == 2
    assert K.ticket_details(done, records).count() == 1


def test_unscored_and_unknown_predictions_are_refused(spark, records):
    unscored = records.where("risk = 'unavailable'").first()["id"]
    asked = spark.createDataFrame([(unscored,), ("nope",)], "prediction_id string")
    reasons = {r["prediction_id"]: r["reason"] for r in K.refused_tickets(asked, records).collect()}
    assert reasons == {unscored: "no score", "nope": "unknown prediction"}


def test_smoke_rows_and_views(spark, records):
    rows = spark.createDataFrame(
        [("1", "sensor", "Датчик дыма"), ("2", "sensor", "Контакт")],
        "entity_id string, direction string, sensor_type string",
    )
    both = K.with_smoke_rows(rows, ["channel_history_rate"])
    assert both.where("direction = 'smoke'").count() == 1 and both.count() == 3
    heads = K.kpis(K.active(records, MODELS), empty_tickets(spark)).first()
    assert (heads["channels"], heads["high_risk"], heads["unavailable"]) == (4, 1, 1)
    assert heads["open_tickets"] == 0
    assert K.trend(records, days=1).count() == 1 and K.trend(records, days=2).count() == 2


def test_alert_cards_join_neighbour_days(spark):
    days = [0, 1, 2, 5]
    rows = [("a", T0 + dt.timedelta(days=d)) for d in days]
    alerts = spark.createDataFrame(rows, "entity_id string, prediction_time timestamp_ntz")
    cards = sorted(K.alert_cards(alerts).collect(), key=lambda r: r["card"])
    assert [r["alerts"] for r in cards] == [3, 1]


def test_requests_are_checked(spark):
    schema = (
        "entity_id string, prediction_time timestamp_ntz, sensor_type string, eligible boolean,"
        " last_explicit_state string, last_state_ts timestamp_ntz, events_1d int"
    )
    good = ("1", T0, "Датчик дыма", True, "Норма", T0 - dt.timedelta(hours=1), 1)
    pattern = fv.DIRECTION_PATTERNS["sensor"]
    df = spark.createDataFrame([good], schema)
    assert Q.validate_request(df, ["events_1d"], pattern).count() == 1
    for position, value in [(0, None), (1, T0 + dt.timedelta(hours=1)), (2, "насос"), (4, "x"), (5, T0)]:
        bad = list(good)
        bad[position] = value
        with pytest.raises(Q.AuditError):
            Q.validate_request(spark.createDataFrame([tuple(bad)], schema), ["events_1d"], pattern)
    with pytest.raises(Q.AuditError):
        Q.validate_request(df.union(df), ["events_1d"], pattern)
    with pytest.raises(ValueError):
        Q.validate_request(df, ["events_7d"], pattern)
