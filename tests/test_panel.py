import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import calendar as C
from vigil.operators import causal as CA
from vigil.operators import episode_features as EF
from vigil.operators import panel as P
from vigil.operators import quality as Q
from vigil.operators import states as ST

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "event_id string, channel_id string, ts timestamp_ntz, alarm boolean, num double,"
    " nonfinite boolean, state string"
)
META = "channel_id string, sensor_type_current string, object_id_current long, system_type_current string"


def make_events():
    """Three channels over 120 days; one sparse, one silent for weeks."""
    rng = random.Random(11)
    rows = []
    for channel, days in (("a", range(120)), ("b", range(0, 120, 9)), ("c", [3, 4, 60, 61, 119])):
        for day in days:
            for _ in range(rng.randrange(1, 4)):
                t = START + dt.timedelta(days=day, hours=rng.randrange(24), seconds=rng.randrange(60))
                state = rng.choice([fv.NORMAL, fv.FAULT, None])
                num = None if state else round(rng.uniform(-5, 5), 3)
                rows.append(("e", channel, t, rng.choice([True, False, None]), num, False, state))
    for day in range(120):  # a channel that makes most days complete
        for hour in range(24 if day % 10 else 20):
            t = START + dt.timedelta(days=day, hours=hour, minutes=30)
            rows.append(("e", "full", t, False, 1.0, False, None))
    return rows


def build(spark, rows, lookback=30):
    events = spark.createDataFrame(rows, SCHEMA)
    line = ST.timeline(events)
    meta = spark.createDataFrame([("a", "t", 1, "s")], META)
    coverage = C.dense_coverage(C.day_coverage(events))
    daily = C.daily_aggregate(events)
    return P.build(daily, coverage, line, meta, lookback=lookback), ST.episodes(line), coverage


@pytest.fixture(scope="module")
def built(spark):
    rows = make_events()
    panel, runs, coverage = build(spark, rows)
    found = {(r["channel_id"], r["prediction_time"]): r for r in panel.collect()}
    return rows, found, runs.collect(), coverage.collect(), panel


def test_grid_has_the_days_with_recent_activity(built):
    rows, found, *_ = built
    expected = set()
    for channel in ("a", "b", "c", "full"):
        active = {r[2].date() for r in rows if r[1] == channel}
        for day in range(121):
            t = START.date() + dt.timedelta(days=day)
            if any(0 < (t - d).days <= 30 for d in active):
                expected.add((channel, dt.datetime.combine(t, dt.time())))
    assert set(found) == expected


def test_features_and_labels_by_brute_force(built):
    rows, found, runs, coverage, _ = built
    complete = {c["day"] for c in coverage if c["observed_hours"] == 24}
    last_seen = {c: max(r[2] for r in rows if r[1] == c) for c in ("a", "b", "c", "full")}
    for (channel, t), row in found.items():
        mine = [r for r in rows if r[1] == channel and r[2] < t]
        for width in (1, 7, 30):
            near = [r for r in mine if r[2] >= t - dt.timedelta(days=width)]
            assert row[f"events_{width}d"] == len(near)
            assert row[f"alarms_{width}d"] == sum(r[3] is True for r in near)
            assert row[f"unknown_alarm_{width}d"] == sum(r[3] is None for r in near)
            assert row[f"fault_messages_{width}d"] == sum(r[6] == fv.FAULT for r in near)
            numbers = [r[4] for r in near if r[4] is not None]
            assert row[f"numeric_n_{width}d"] == len(numbers)
            if numbers:
                mean = sum(numbers) / len(numbers)
                spread = math.sqrt(sum((v - mean) ** 2 for v in numbers) / len(numbers))
                assert row[f"numeric_mean_{width}d"] == pytest.approx(mean, abs=1e-9)
                assert row[f"numeric_std_{width}d"] == pytest.approx(spread, abs=1e-6)
                assert row[f"numeric_max_{width}d"] == max(numbers)
            else:
                assert row[f"numeric_mean_{width}d"] is None
                assert row[f"numeric_std_{width}d"] is None
        assert row["feature_max_ts"] == max(r[2] for r in mine)
        day = t.date()
        before = [day - dt.timedelta(days=i) for i in range(1, 31)]
        assert row["history_complete_days"] == sum(d in complete for d in before)
        assert row["global_complete_days_1d"] == int(before[0] in complete)

        def label(offset):
            low = t + dt.timedelta(days=offset)
            high = low + dt.timedelta(days=1)
            hit = any(
                r["observed_start"] and r["channel_id"] == channel and low <= r["start_ts"] < high
                for r in runs
            )
            if hit:
                return 1
            return 0 if low.date() in complete and last_seen[channel] >= high else None

        assert row["target_fault_24_48h"] == label(1)
        assert row["target_fault_0_24h"] == label(0)


def test_future_events_do_not_change_features(spark, built):
    rows, found, *_ = built
    cut = START + dt.timedelta(days=70)
    panel, _, _ = build(spark, [r for r in rows if r[2] < cut])
    names = P.panel_feature_names()
    for row in panel.where(F.col("prediction_time") <= F.lit(cut)).collect():
        whole = found[row["channel_id"], row["prediction_time"]]
        assert [row[n] for n in names] == [whole[n] for n in names]
        assert row["last_state_ts"] == whole["last_state_ts"]


def test_structure_checks_are_clean(built):
    report = Q.structure_checks(built[4]).first().asDict()
    rows = report.pop("rows")
    assert rows == len(built[1]) and not any(report.values())


def test_short_lookback_shortens_the_grid(spark, built):
    panel, _, _ = build(spark, built[0], lookback=7)
    rows = panel.where("channel_id = 'c'").collect()
    assert len(rows) == len({(d + k) for d in (3, 4, 60, 61, 119) for k in range(1, 8) if d + k <= 120})


def test_monthly_label_by_brute_force(spark, built):
    _, found, runs, coverage, panel = built
    events = spark.createDataFrame(built[0], SCHEMA)
    line = ST.timeline(events)
    dense = C.dense_coverage(C.day_coverage(events))
    rows = P.monthly_label(panel, ST.episodes(line), dense, 1, 5).collect()
    bad = {c["day"] for c in coverage if c["observed_hours"] != 24}
    kept = {(r["channel_id"], r["prediction_time"]): r for r in rows}
    for key, row in found.items():
        channel, t = key
        window = [(t + dt.timedelta(days=i)).date() for i in range(1, 5)]
        ok = row["last_seen"] >= t + dt.timedelta(days=5) and not bad & set(window)
        assert (key in kept) == ok
        if ok:
            starts = [
                r["start_ts"]
                for r in runs
                if r["observed_start"]
                and r["channel_id"] == channel
                and r["start_ts"] >= t + dt.timedelta(days=1)
            ]
            first = min(starts, default=None)
            assert kept[key]["next_start_after_24h"] == first
            hit = first is not None and first < t + dt.timedelta(days=5)
            assert kept[key]["target_monthly"] == int(hit)


def test_episode_features_by_brute_force(spark, built):
    _, found, runs, _, panel = built
    events = spark.createDataFrame(built[0], SCHEMA)
    keys = panel.select("channel_id", "prediction_time")
    rows = EF.episode_features(keys, ST.episodes(ST.timeline(events))).collect()
    assert len(rows) == len(found)
    for row in rows:
        t = row["prediction_time"]
        mine = [r for r in runs if r["channel_id"] == row["channel_id"] and r["observed_start"]]
        past = [r["start_ts"] for r in mine if r["start_ts"] < t]
        for d in fv.EPISODE_WINDOWS:
            near = [s for s in past if s >= t - dt.timedelta(days=d)]
            assert row[f"fault_starts_{d}d"] == len(near)
            assert row[f"fault_start_days_{d}d"] == len({s.date() for s in near})
        for d in fv.EPISODE_LAGS:
            day = (t - dt.timedelta(days=d)).date()
            assert row[f"fault_day_lag_{d}"] == int(any(s.date() == day for s in past))
        closed = [r for r in mine if r["end_ts"] is not None and r["end_ts"] < t]
        near = [r for r in closed if r["end_ts"] >= t - dt.timedelta(days=30)]
        assert row["fault_closes_30d"] == len(near)
        if near:
            logs = [math.log1p(r["duration_hours"]) for r in near]
            assert row["past_log_duration_mean_30d"] == pytest.approx(sum(logs) / len(logs))
        if past:
            hours = (t - max(past)).total_seconds() / 3600
            assert row["hours_since_fault_start"] == pytest.approx(hours)


def test_causal_rate_bounds(spark):
    day = dt.timedelta(days=1)
    rows = [("a", START + i * day, START + (i + 2) * day, int(i % 2 == 0)) for i in range(6)]
    rows.append(("new", START + 5 * day, START + 7 * day, 0))
    rows.append(("late", START + 3 * day, START + 5 * day + dt.timedelta(seconds=1), 1))
    schema = "channel_id string, prediction_time timestamp_ntz, target_end timestamp_ntz, y int"
    df = spark.createDataFrame(rows, schema)
    found = {
        (r["channel_id"], r["prediction_time"]): r for r in CA.causal_rate(df, df, "y", alpha=10).collect()
    }
    for channel, t, _, _ in rows:
        mine = [y for c, _, end, y in rows if c == channel and end <= t]
        every = [y for _, _, end, y in rows if end <= t]
        prior = sum(every) / len(every) if every else 0.0
        row = found[channel, t]
        assert row["channel_history_count"] == sum(mine)
        rate = (sum(mine) + 10 * prior) / (len(mine) + 10)
        assert row["channel_history_rate"] == pytest.approx(rate, rel=1e-6)
