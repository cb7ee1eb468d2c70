import datetime as dt
import random

import pytest
from moments import moment
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import calendar as C
from vigil.operators import states as ST
from vigil.operators.asof import asof_join

N, X = fv.NORMAL, fv.FAULT
GOLDEN = [
    ("2024-01-01 00:00:00", X),
    ("2024-01-02 00:00:00", N),
    ("2024-01-03 00:00:00", X),
    ("2024-01-03 01:00:00", X),
    ("2024-01-04 00:00:00", N),
    ("2024-01-04 00:00:00", X),
    ("2024-01-05 00:00:00", X),
    ("2024-01-06 00:00:00", N),
    ("2024-01-07 00:00:00", X),
]
EVENTS = "channel_id string, ts timestamp_ntz, state string"


def events(spark, rows):
    return spark.createDataFrame([("a", moment(t), s) for t, s in rows], EVENTS)


def test_golden_time_line(spark):
    line = ST.timeline(events(spark, GOLDEN))
    rows = sorted(line.collect(), key=lambda r: r["ts"])
    assert dt.datetime(2024, 1, 3, 1) not in [r["ts"] for r in rows]
    assert sum(r["state"] == fv.AMBIGUOUS for r in rows) == 1
    assert rows[0]["prev_state"] is None
    runs = sorted(ST.episodes(line).collect(), key=lambda r: r["start_ts"])
    assert [r["start_ts"].day for r in runs if r["observed_start"]] == [3, 7]
    assert runs[0]["left_censored"] and runs[0]["duration_hours"] == 24.0
    assert runs[1]["ambiguous_end"] and runs[1]["duration_hours"] is None
    assert runs[-1]["right_censored"] and runs[-1]["ambiguous_end"] is None


def test_time_line_against_a_loop(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (str(rng.randrange(3)), start + dt.timedelta(hours=rng.randrange(400)), rng.choice([N, X]))
        for _ in range(600)
    ]
    found = {
        (r["channel_id"], r["ts"]): (r["state"], r["prev_state"], r["next_change_ts"])
        for r in ST.timeline(spark.createDataFrame(rows, EVENTS)).collect()
    }
    expected = {}
    for channel in "012":
        instants = {}
        for c, t, s in rows:
            if c == channel:
                instants.setdefault(t, set()).add(s)
        line = []
        for t in sorted(instants):
            state = next(iter(instants[t])) if len(instants[t]) == 1 else fv.AMBIGUOUS
            if not line or line[-1][1] != state:
                line.append((t, state))
        for i, (t, s) in enumerate(line):
            before = line[i - 1][1] if i else None
            after = line[i + 1][0] if i + 1 < len(line) else None
            expected[channel, t] = (s, before, after)
    assert found == expected


def test_sessions_split_after_the_gap_and_at_midnight(spark):
    times = ["2024-01-01 23:49:00", "2024-01-01 23:59:00", "2024-01-02 00:01:00"]
    times += ["2024-01-02 00:11:01"]
    rows = events(spark, [(t, "s") for t in times])
    found = sorted(ST.gap_sessions(rows).collect(), key=lambda r: r["episode_id"])
    assert [(r["episode_id"], r["messages"], r["duration_minutes"]) for r in found] == [
        (1, 2, 10.0),
        (2, 1, 0.0),
        (3, 1, 0.0),
    ]
    merged = ST.gap_sessions(rows, break_on_date=False).collect()
    assert sorted(r["messages"] for r in merged) == [1, 3]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_against_a_loop(spark, direction, strict):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)

    def some(n, hours):
        keys = {(rng.choice("aab"), rng.randrange(hours)) for _ in range(n)}
        return sorted((k, start + dt.timedelta(hours=h)) for k, h in keys)

    left, right = some(120, 300), some(25, 300)
    lefts = spark.createDataFrame(left, "k string, t timestamp_ntz")
    rights = spark.createDataFrame(right, "k string, u timestamp_ntz")
    found = asof_join(lefts, rights, ["k"], "t", "u", ["u"], direction, strict)
    rows = {(r["k"], r["t"]): r["u"] for r in found.collect()}
    assert len(rows) == len(left)
    for k, t in left:
        if direction == "backward":
            fits = [u for kk, u in right if kk == k and (u < t or (u == t and not strict))]
            best = max(fits, default=None)
        else:
            fits = [u for kk, u in right if kk == k and (u > t or (u == t and not strict))]
            best = min(fits, default=None)
        assert rows[k, t] == best


def test_calendar_gaps_stay_gaps(spark):
    rows = [(dt.date(2026, 6, 1), 8, 1, 0), (dt.date(2026, 6, 3), 12, 2, 3)]
    seen = spark.createDataFrame(rows, "date date, events int, sensor int, infrastructure int")
    found = sorted(C.observation_history(seen, 3).collect(), key=lambda r: r["date"])
    assert [r["events"] for r in found] == [8, None, 12]
    assert tuple(found[1])[1:] == (None, None, None)
    assert len(C.observation_history(seen, 2).collect()) == 2


def test_coverage_of_missing_and_partial_days(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [start + dt.timedelta(hours=h) for h in [*range(24), *range(48, 60), *range(72, 96)]]
    rows = spark.createDataFrame([("a", t, "s") for t in hours], EVENTS)
    dense = C.dense_coverage(C.day_coverage(rows))
    found = [r["observed_hours"] for r in dense.orderBy("day").collect()]
    assert found == [24, 0, 12, 24]
    assert [r["day"].day for r in C.missing_days(C.day_coverage(rows)).collect()] == [2]
    features = C.coverage_features(dense, [1, 7]).orderBy("day").collect()
    assert [r["complete_before_7d"] for r in features] == [0, 1, 1, 1, 2]
    assert [r["complete_next"] for r in features] == [False, False, True, False, False]
    ahead = C.incomplete_ahead(dense, 1, 3).orderBy("day").collect()
    assert [r["bad_ahead"] for r in ahead] == [2, 1, 0, 0]


def test_half_open_day(spark):
    times = ["2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-02 23:59:59"]
    times += ["2024-01-03 00:00:00"]
    rows = events(spark, [(t, "s") for t in times])
    daily = rows.groupBy(F.to_date("ts").alias("day")).count()
    assert daily.where("day = '2024-01-02'").first()["count"] == 2


def test_asof_of_missing_keys_ties_and_repeated_rows(spark):
    noon = moment("2024-01-01 12:00:00")
    left = spark.createDataFrame(
        [("a", noon, 1), ("a", noon, 1), (None, noon, 2), ("a", None, 3)], "k string, t timestamp_ntz, x int"
    )
    early = moment("2024-01-01 06:00:00")
    right = spark.createDataFrame([("a", early, 5), ("a", early, 7), (None, early, 9)], "k string, u timestamp_ntz, v int")
    found = asof_join(left, right, ["k"], "t", "u", ["v"])
    assert sorted((r["x"], r["v"]) for r in found.collect()) == [(1, 7), (1, 7), (2, None), (3, None)]


def test_sessions_of_a_missing_key_go_on(spark):
    start = moment("2024-01-01 23:55:00")
    rows = spark.createDataFrame(
        [(None, start + dt.timedelta(minutes=m)) for m in (0, 6, 12, 100)], "channel_id string, ts timestamp_ntz"
    )
    merged = ST.gap_sessions(rows, break_on_date=False).collect()
    assert sorted(r["messages"] for r in merged) == [1, 3]
    split = ST.gap_sessions(rows).collect()
    assert sorted((r["episode_id"], r["messages"]) for r in split) == [(1, 1), (2, 2), (3, 1)]
