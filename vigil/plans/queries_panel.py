"""Queries: daily tables, time lines, episodes, sessions and the panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import calendar as C
from vigil.operators import causal as CA
from vigil.operators import episode_features as EF
from vigil.operators import panel as P
from vigil.operators import panel_store as PS
from vigil.operators import quality as Q
from vigil.operators import states as ST
from vigil.operators.asof import asof_join
from vigil.plans import bindings as B
from vigil.plans.registry import part, query
from vigil.session import scratch_path

_ROUND_MEAN = [f"numeric_mean_{w}d" for w in fv.PANEL_WINDOWS]
_ROUND_STD = [f"numeric_std_{w}d" for w in fv.PANEL_WINDOWS]
_ROUND_HOURS = ["hours_since_last_event", "history_days", "dow_sin", "dow_cos"]
_ROUND_RATIO = ["alarm_rate_7d", "event_ratio_1d_7d", "event_ratio_7d_30d"]


def rounded(df, columns, digits):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_panel(df):
    df = rounded(rounded(df, _ROUND_HOURS, 6), _ROUND_STD, 4)
    return rounded(df, _ROUND_MEAN + _ROUND_RATIO, 9)


PANEL_ROWS = """SELECT * REPLACE (at_risk_with_history::INT AS at_risk_with_history,
  channel_followup_48h::INT AS channel_followup_48h, global_complete_0_24h::INT AS global_complete_0_24h,
  global_complete_24_48h::INT AS global_complete_24_48h) FROM """


@query(
    "daily_aggregate",
    "SELECT * REPLACE (day::TIMESTAMP AS day, round(numeric_sum, 6) AS numeric_sum,"
    " round(numeric_sumsq, 4) AS numeric_sumsq) FROM daily_t",
)
def _(spark, sf):
    out = rounded(B.daily(spark, sf).drop("hour_mask"), ["numeric_sum"], 6)
    return rounded(out, ["numeric_sumsq"], 4)


@query(
    "day_coverage",
    "SELECT ts::DATE::TIMESTAMP AS day, count(*) AS events, count(DISTINCT hour(ts)) AS observed_hours,"
    " count(DISTINCT channel_id) AS channels FROM journal_t GROUP BY 1",
)
def _(spark, sf):
    return C.day_coverage(B.journal(spark, sf))


@query("calendar_coverage", "SELECT * REPLACE (day::TIMESTAMP AS day) FROM coverage_t")
def _(spark, sf):
    return B.coverage(spark, sf)


@query(
    "incomplete_days",
    "SELECT * REPLACE (day::TIMESTAMP AS day) FROM coverage_t WHERE observed_hours < 24",
)
def _(spark, sf):
    return C.incomplete_days(B.coverage(spark, sf))


@query(
    "order_calendar_gaps",
    """SELECT d AS day FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d
       FROM order_journal_t) WHERE d NOT IN (SELECT ts FROM order_journal_t WHERE ts IS NOT NULL)""",
)
def _(spark, sf):
    return C.missing_days(C.day_coverage(B.order_journal(spark, sf)))


@query("state_timeline", "SELECT * FROM transitions_t")
def _(spark, sf):
    return B.transitions(spark, sf)


@query(
    "fault_episodes",
    """SELECT * REPLACE (observed_start::INT AS observed_start, left_censored::INT AS left_censored,
       right_censored::INT AS right_censored, ambiguous_end::INT AS ambiguous_end,
       round(duration_hours, 6) AS duration_hours) FROM runs_t""",
)
def _(spark, sf):
    return rounded(B.fault_runs(spark, sf), ["duration_hours"], 6)


@query(
    "order_episodes",
    """SELECT * REPLACE (observed_start::INT AS observed_start, left_censored::INT AS left_censored,
       right_censored::INT AS right_censored, ambiguous_end::INT AS ambiguous_end,
       round(duration_hours, 6) AS duration_hours) FROM order_runs_t""",
)
def _(spark, sf):
    return rounded(B.order_runs(spark, sf), ["duration_hours"], 6)


def _sessions_sql(minutes: int, by_date: bool) -> str:
    broken = "OR p.ts::DATE <> j.ts::DATE" if by_date else ""
    return f"""
SELECT channel_id, episode_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages,
       round(date_diff('microsecond', min(ts), max(ts)) / 6e7, 4) AS duration_minutes
FROM (SELECT j.channel_id, j.ts, count(DISTINCT o.ts) AS episode_id
      FROM journal_t j JOIN
           (SELECT j.channel_id, j.ts FROM journal_t j
            ASOF LEFT JOIN journal_t p ON p.channel_id = j.channel_id AND p.ts < j.ts
            WHERE p.ts IS NULL OR date_diff('microsecond', p.ts, j.ts) > {minutes * 60_000_000}::BIGINT {broken}) o
        ON o.channel_id = j.channel_id AND o.ts <= j.ts
      GROUP BY j.channel_id, j.event_id, j.ts)
GROUP BY channel_id, episode_id"""


@query("gap_sessions", _sessions_sql(240, True))
def _(spark, sf):
    out = ST.gap_sessions(B.journal(spark, sf), gap_minutes=240)
    return rounded(out, ["duration_minutes"], 4)


@query("gap_sessions_across_dates", _sessions_sql(600, False))
def _(spark, sf):
    out = ST.gap_sessions(B.journal(spark, sf), gap_minutes=600, break_on_date=False)
    return rounded(out, ["duration_minutes"], 4)


@query("feature_panel", PANEL_ROWS + "panel_t")
def _(spark, sf):
    return rounded_panel(B.build_panel(spark, sf))


@query("refreshed_panel", PANEL_ROWS + "panel_t")
def _(spark, sf):
    """The panel from three batches of days, each computed from the state that the one before left."""
    events, stated = B.journal(spark, sf), B.state_events(spark, sf)
    first, last = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()  # one row
    days = (last - first).days + 1
    store = PS.PanelStore(scratch_path(spark, "panel"), B.WORDS, min_history_days=B.HISTORY_DAYS)
    cuts = [first + dt.timedelta(n) for n in (0, days // 2, days - 1, days)]
    for a, b in zip(cuts, cuts[1:]):
        new = (F.to_date("ts") >= a) & (F.to_date("ts") < b)
        PS.append_days(store, events.where(new), C.day_coverage(stated.where(new)), stated.where(new))
    return rounded_panel(PS.panel(spark, store, B.metadata(spark, sf)))


@query(
    "sparse_panel",
    """SELECT channel_id, count(*) AS rows, min(prediction_time) AS first_time, max(prediction_time) AS last_time,
       sum(events_7d)::BIGINT AS events_7d, sum(fault_messages_30d)::BIGINT AS fault_messages_30d,
       sum(active_days_30d)::BIGINT AS active_days_30d, max(numeric_max_30d) AS numeric_max_30d,
       round(sum(numeric_mean_30d) / 1e6, 4) AS numeric_mean_30d, count(last_explicit_state) AS with_state,
       round(sum(hours_since_last_event), 3) AS hours_since_last_event, count(target_fault_24_48h) AS labelled,
       sum(target_fault_24_48h)::BIGINT AS positives FROM order_panel_t GROUP BY 1""",
)
def _(spark, sf):
    events = B.order_journal(spark, sf)
    built = P.build(
        C.daily_aggregate(events, B.ORDER_WORDS),
        C.dense_coverage(C.day_coverage(events)),
        B.order_transitions(spark, sf),
        B.metadata(spark, sf),
        words=B.ORDER_WORDS,
    )
    return built.groupBy("channel_id").agg(
        F.count("*").alias("rows"),
        F.min("prediction_time").alias("first_time"),
        F.max("prediction_time").alias("last_time"),
        F.sum("events_7d").alias("events_7d"),
        F.sum("fault_messages_30d").alias("fault_messages_30d"),
        F.sum("active_days_30d").alias("active_days_30d"),
        F.max("numeric_max_30d").alias("numeric_max_30d"),
        F.round(F.sum("numeric_mean_30d") / 1e6, 4).alias("numeric_mean_30d"),
        F.count("last_explicit_state").alias("with_state"),
        F.round(F.sum("hours_since_last_event"), 3).alias("hours_since_last_event"),
        F.count("target_fault_24_48h").alias("labelled"),
        F.sum(F.col("target_fault_24_48h").cast("long")).alias("positives"),
    )


@query(
    "panel_structure",
    """SELECT count(*) AS rows, count(*) - count(DISTINCT (channel_id, prediction_time)) AS duplicate_keys,
       0::BIGINT AS future_features, 0::BIGINT AS future_state, 0::BIGINT AS invalid_labels,
       0::BIGINT AS invalid_counts, 0::BIGINT AS numbers_without_measurements FROM panel_t""",
)
def _(spark, sf):
    return Q.structure_checks(B.panel(spark, sf))


@query(
    "leakage_guard",
    "SELECT 0::BIGINT AS future_feature_max_ts, 0::BIGINT AS future_last_state_ts, count(*) AS rows FROM panel_t",
)
def _(spark, sf):
    panel = B.panel(spark, sf)
    found = Q.leakage(panel, ["feature_max_ts", "last_state_ts"])
    rows = panel.agg(F.count("*").alias("rows"))
    one = F.lit(1)
    return found.withColumn("_k", one).join(rows.withColumn("_k", one), "_k").drop("_k")


part(
    "smoke_sessions_t",
    """SELECT p.channel_id, p.ts AS start_ts FROM (SELECT * FROM journal_t WHERE state = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM journal_t WHERE state = 'purchase') q
         ON q.channel_id = p.channel_id AND q.ts < p.ts
       WHERE q.ts IS NULL OR q.ts::DATE <> p.ts::DATE OR p.ts - q.ts > INTERVAL 10 MINUTE""",
)
part(
    "smoke_panel_t",
    """SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM smoke_sessions_t s WHERE s.channel_id = p.channel_id
           AND s.start_ts >= p.target_start AND s.start_ts < p.target_end) THEN 1
         WHEN p.global_complete_24_48h AND p.channel_followup_48h THEN 0 END AS smoke_signal_24_48h
       FROM panel_t p""",
)


def smoke_panel(spark, sf):
    smoke = ST.with_states(B.journal(spark, sf), [B.WORDS.smoke])
    starts = ST.starts_per_day(ST.gap_sessions(smoke), only_observed=False)
    return P.add_forward_label(B.panel(spark, sf), starts, "smoke_signal_24_48h")


@query("smoke_label", "SELECT channel_id, prediction_time, smoke_signal_24_48h FROM smoke_panel_t")
def _(spark, sf):
    return smoke_panel(spark, sf).select("channel_id", "prediction_time", "smoke_signal_24_48h")


part(
    "monthly_t",
    """SELECT p.*, n.next_start_after_24h,
         coalesce(n.next_start_after_24h < p.prediction_time + INTERVAL 7 DAY, false)::INT AS target_monthly
       FROM panel_t p LEFT JOIN
         (SELECT p.channel_id, p.prediction_time, min(r.start_ts) AS next_start_after_24h
          FROM panel_t p JOIN runs_t r ON r.channel_id = p.channel_id AND r.observed_start
            AND r.start_ts >= p.prediction_time + INTERVAL 1 DAY GROUP BY ALL) n
         USING (channel_id, prediction_time)
       WHERE p.last_seen >= p.prediction_time + INTERVAL 7 DAY AND NOT EXISTS
         (SELECT 1 FROM coverage_t c WHERE c.observed_hours <> 24
            AND c.day >= p.prediction_time + INTERVAL 1 DAY AND c.day < p.prediction_time + INTERVAL 7 DAY)""",
)


def monthly(spark, sf):
    return P.monthly_label(
        B.panel(spark, sf), B.fault_table(spark, sf), B.coverage(spark, sf), lead=1, horizon=7
    )


@query(
    "monthly_label",
    "SELECT channel_id, prediction_time, target_monthly, next_start_after_24h FROM monthly_t",
)
def _(spark, sf):
    return monthly(spark, sf).select(
        "channel_id", "prediction_time", "target_monthly", "next_start_after_24h"
    )


def _asof_sql(sign: str, right: str, on_key: bool = True) -> str:
    match = "r.channel_id = l.channel_id AND " if on_key else ""
    return f"""SELECT l.channel_id, l.event_id, l.ts, r.value, r.at FROM
      (SELECT channel_id, event_id, date_trunc('hour', ts) AS ts FROM journal_t) l
      ASOF LEFT JOIN {right} r ON {match}l.ts {sign} r.at"""


_RIGHT = "(SELECT channel_id, state AS value, ts AS at FROM transitions_t)"


def _asof(spark, sf, direction: str, strict: bool):
    left = B.hourly(B.journal(spark, sf))
    right = B.transitions(spark, sf).select(
        "channel_id", F.col("state").alias("value"), F.col("ts").alias("at")
    )
    return asof_join(
        left.select("channel_id", "event_id", "ts"),
        right,
        ["channel_id"],
        "ts",
        "at",
        ["value", "at"],
        direction,
        strict,
    )


@query("asof_before", _asof_sql(">", _RIGHT))
def _(spark, sf):
    return _asof(spark, sf, "backward", True)


@query("asof_at_or_before", _asof_sql(">=", _RIGHT))
def _(spark, sf):
    return _asof(spark, sf, "backward", False)


@query("asof_after", _asof_sql("<", _RIGHT))
def _(spark, sf):
    return _asof(spark, sf, "forward", True)


@query("asof_at_or_after", _asof_sql("<=", _RIGHT))
def _(spark, sf):
    return _asof(spark, sf, "forward", False)


@query(
    "asof_global",
    _asof_sql(
        ">=",
        "(SELECT sum(events) OVER (ORDER BY day)::BIGINT AS value, day::TIMESTAMP AS at FROM coverage_t)",
        on_key=False,
    ),
)
def _(spark, sf):
    from pyspark.sql import Window

    left = B.hourly(B.journal(spark, sf))
    days = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    right = B.coverage(spark, sf).select(
        F.sum("events").over(days).alias("value"), F.col("day").cast("timestamp_ntz").alias("at")
    )
    return asof_join(
        left.select("channel_id", "event_id", "ts"), right, [], "ts", "at", ["value", "at"], "backward", False
    )


def _episode_features_sql() -> str:
    day = "p.prediction_time::DATE"
    confirmed = "r.observed_start"
    closed = f"{confirmed} AND r.end_ts IS NOT NULL AND r.end_ts::DATE < {day}"
    started = f"{confirmed} AND r.start_ts::DATE < {day}"
    cells = [
        f"round(date_diff('microsecond', max(r.start_ts) FILTER (WHERE {started}), p.prediction_time) / 3.6e9, 6)"
        " AS hours_since_fault_start",
        f"round(date_diff('microsecond', max(r.end_ts) FILTER (WHERE {closed}), p.prediction_time) / 3.6e9, 6)"
        " AS hours_since_fault_end",
    ]
    for d in fv.EPISODE_WINDOWS:
        near = f"FILTER (WHERE {started} AND r.start_ts::DATE >= {day} - {d})"
        cells.append(f"count(*) {near} AS fault_starts_{d}d")
        cells.append(f"count(DISTINCT r.start_ts::DATE) {near} AS fault_start_days_{d}d")
    for d in fv.EPISODE_LAGS:
        cells.append(
            f"(count(*) FILTER (WHERE {confirmed} AND r.start_ts::DATE = {day} - {d}) > 0)::INT AS fault_day_lag_{d}"
        )
    for d in fv.CLOSE_WINDOWS:
        near = f"FILTER (WHERE {closed} AND r.end_ts::DATE >= {day} - {d}"
        cells.append(f"count(*) {near}) AS fault_closes_{d}d")
        cells.append(f"count(*) {near} AND r.duration_hours <= 1.0 / 60) AS short_fault_closes_{d}d")
        cells.append(f"round(avg(ln(1 + r.duration_hours)) {near}), 6) AS past_log_duration_mean_{d}d")
    cells.append(
        f"greatest(max(r.start_ts) FILTER (WHERE {started}), max(r.end_ts) FILTER (WHERE {closed}))"
        " AS episode_feature_max_ts"
    )
    return (
        f"SELECT p.channel_id, p.prediction_time, {', '.join(cells)} FROM panel_t p"
        " LEFT JOIN runs_t r ON r.channel_id = p.channel_id GROUP BY p.channel_id, p.prediction_time"
    )


part("episode_features_t", _episode_features_sql())
_LOGS = [f"past_log_duration_mean_{d}d" for d in fv.CLOSE_WINDOWS]
_SINCE = ["hours_since_fault_start", "hours_since_fault_end"]


@query("episode_features", "SELECT * FROM episode_features_t")
def _(spark, sf):
    keys = B.panel(spark, sf).select("channel_id", "prediction_time")
    found = EF.episode_features(keys, B.fault_table(spark, sf))
    return rounded(found, _LOGS + _SINCE, 6)


@query(
    "episode_leakage",
    """SELECT 'as built' AS kind, count(*) FILTER (WHERE episode_feature_max_ts >= prediction_time)
         AS future_episode_feature_max_ts FROM episode_features_t
       UNION ALL SELECT 'three days early', count(*) FILTER (WHERE episode_feature_max_ts >= prediction_time - INTERVAL 3 DAY)
       FROM episode_features_t""",
)
def _(spark, sf):
    """The guard of episode features, on them and on rows whose prediction is put three days early."""
    keys = B.panel(spark, sf).select("channel_id", "prediction_time")
    found = EF.episode_features(keys, B.fault_table(spark, sf))
    early = found.withColumn("prediction_time", F.col("prediction_time") - F.expr("interval 3 days"))
    checks = {"as built": found, "three days early": early}
    parts = [Q.leakage(rows, ["episode_feature_max_ts"]).withColumn("kind", F.lit(k)) for k, rows in checks.items()]
    return parts[0].unionByName(parts[1])


# the check states the shares by itself instead of reading the formulas
_SHARES = [
    ("alarm_share_1d", "alarms_1d", "events_1d"),
    ("fault_share_7d", "fault_messages_7d", "events_7d"),
    ("undefined_share_7d", "undefined_messages_7d", "events_7d"),
    ("night_share_7d", "night_events_7d", "events_7d"),
    ("numeric_share_7d", "numeric_n_7d", "events_7d"),
    *[(f"events_per_active_day_{d}d", f"events_{d}d", f"active_days_{d}d") for d in (7, 30)],
    ("starts_per_fault_day_30d", "fault_starts_30d", "fault_start_days_30d"),
    ("short_fault_share_90d", "short_fault_closes_90d", "fault_closes_90d"),
]


def _ratio_sql() -> str:
    cells = [
        "round(date_diff('microsecond', last_state_ts, prediction_time) / 3.6e9, 6) AS hours_since_explicit_state"
    ]
    cells += [f"round({top} / nullif({bottom}, 0), 9) AS {name}" for name, top, bottom in _SHARES]
    cells += [f"round(numeric_max_{d}d - numeric_min_{d}d, 6) AS numeric_range_{d}d" for d in (7, 30)]
    cells.append(
        "round((fault_starts_7d / 7) / nullif(fault_starts_30d / 30, 0), 9) AS fault_start_ratio_7d_30d"
    )
    cells += [f"round(fault_start_days_{d}d / {d}, 9) AS fault_day_rate_{d}d" for d in (30, 90, 365)]
    cells.append(" + ".join(f"fault_day_lag_{d}" for d in fv.EPISODE_LAGS) + " AS fault_weekly_repeats")
    return (
        f"SELECT channel_id, prediction_time, {', '.join(cells)} FROM panel_t"
        " JOIN episode_features_t USING (channel_id, prediction_time)"
    )


@query("ratio_features", _ratio_sql())
def _(spark, sf):
    built = EF.episode_features(B.panel(spark, sf), B.fault_table(spark, sf))
    names = list(fv.RATIO_FORMULAS)
    out = EF.ratio_features(built).select("channel_id", "prediction_time", *names)
    hours = ["hours_since_explicit_state", "numeric_range_7d", "numeric_range_30d"]
    rest = [n for n in names if n not in hours and n != "fault_weekly_repeats"]
    return rounded(rounded(out, hours, 6), rest, 9)


@query(
    "model_matrix",
    """SELECT channel_id, prediction_time, round(numeric_mean_7d, 9)::FLOAT AS numeric_mean_7d,
       round(alarm_rate_7d, 9)::FLOAT AS alarm_rate_7d, events_7d::FLOAT AS events_7d,
       coalesce(sensor_type_current, '__MISSING__') AS sensor_type_current,
       coalesce(last_explicit_state, '__MISSING__') AS last_explicit_state FROM panel_t""",
)
def _(spark, sf):
    panel = rounded(B.panel(spark, sf), ["numeric_mean_7d", "alarm_rate_7d"], 9)
    numbers = ["numeric_mean_7d", "alarm_rate_7d", "events_7d"]
    texts = ["sensor_type_current", "last_explicit_state"]
    out = EF.model_matrix(panel, numbers, texts)
    return out.select("channel_id", "prediction_time", *numbers, *texts)


part(
    "history_t",
    """SELECT channel_id, prediction_time, target_end, smoke_signal_24_48h AS y FROM smoke_panel_t
       WHERE smoke_signal_24_48h IS NOT NULL""",
)


@query(
    "causal_rate",
    """SELECT r.channel_id, r.prediction_time, coalesce(m.pos, 0)::FLOAT AS channel_history_count,
         ((coalesce(m.pos, 0) + 100 * coalesce(g.rate, 0)) / (coalesce(m.n, 0) + 100))::FLOAT AS channel_history_rate
       FROM history_t r
       LEFT JOIN (SELECT r.channel_id, r.prediction_time, sum(h.y)::DOUBLE AS pos, count(*) AS n FROM history_t r
                  JOIN history_t h ON h.channel_id = r.channel_id AND h.target_end <= r.prediction_time GROUP BY ALL) m
         USING (channel_id, prediction_time)
       LEFT JOIN (SELECT t.prediction_time, avg(h.y) AS rate FROM (SELECT DISTINCT prediction_time FROM history_t) t
                  JOIN history_t h ON h.target_end <= t.prediction_time GROUP BY ALL) g USING (prediction_time)""",
)
def _(spark, sf):
    label = "smoke_signal_24_48h"
    rows = smoke_panel(spark, sf).where(F.col(label).isNotNull())
    keys = rows.select("channel_id", "prediction_time", "target_end", label)
    found = CA.causal_rate(keys, keys, label)
    return found.select(
        "channel_id", "prediction_time", "channel_history_count", "channel_history_rate"
    )
