"""Named SQL of the checks: the same results stated directly, without the
formulation the Spark operators use."""

from __future__ import annotations

from vigil import fixed_values as fv
from vigil.plans import bindings as B
from vigil.plans.registry import part

part("journal_t", B.JOURNAL_SQL)
part("raw_journal_t", B.RAW_JOURNAL_SQL)
part("channels_t", B.CHANNELS_SQL)
part("typed_raw_t", B.TYPED_RAW_SQL)
part("order_journal_t", B.ORDER_JOURNAL_SQL)
part("scored_t", B.SCORED_SQL)


def daily_sql(source: str, w: object) -> str:
    undefined = ", ".join(f"'{u}'" for u in w.undefined)
    words = {
        "fault_messages": f"= '{w.fault}'",
        "power_messages": f"= '{w.power_off}'",
        "undefined_messages": f"IN ({undefined})",
        "disabled_messages": f"= '{w.disabled}'",
        "smoke_messages": f"= '{w.smoke}'",
        "gas_messages": f"= '{w.gas}'",
        "flood_messages": f"= '{w.flood}'",
    }
    by_word = ", ".join(f"count(*) FILTER (WHERE state {test}) AS {name}" for name, test in words.items())
    return f"""
SELECT channel_id, ts::DATE AS day, count(*) AS events, count(*) FILTER (WHERE alarm) AS alarms,
       count(*) FILTER (WHERE alarm IS NULL) AS unknown_alarm, count(num) AS numeric_n, sum(num) AS numeric_sum,
       sum(num ** 2) AS numeric_sumsq, min(num) AS numeric_min, max(num) AS numeric_max,
       count(state) AS text_n, {by_word}, count(*) FILTER (WHERE hour(ts) < 6) AS night_events,
       count(*) FILTER (WHERE nonfinite) AS nonfinite_n, min(ts) AS first_ts, max(ts) AS last_ts
FROM {source} GROUP BY ALL"""


def timeline_sql(source: str) -> str:
    """Changes by comparing each instant with the nearest earlier one."""
    return f"""
SELECT c.channel_id, c.ts, c.state, c.prev_state,
       min(n.ts) AS next_change_ts, arg_min(n.state, n.ts) AS next_state
FROM {source} c LEFT JOIN {source} n ON n.channel_id = c.channel_id AND n.ts > c.ts
GROUP BY c.channel_id, c.ts, c.state, c.prev_state"""


def changes_sql(source: str) -> str:
    return f"""
SELECT a.channel_id, a.ts, a.state, b.state AS prev_state
FROM {source} a ASOF LEFT JOIN {source} b ON a.channel_id = b.channel_id AND a.ts > b.ts
WHERE b.state IS DISTINCT FROM a.state"""


def instants_sql(source: str) -> str:
    return f"""
SELECT channel_id, ts, CASE count(DISTINCT state) WHEN 1 THEN any_value(state) ELSE 'ambiguous' END AS state
FROM {source} GROUP BY channel_id, ts"""


def runs_sql(source: str, fault: str, normal: str) -> str:
    return f"""
SELECT channel_id, ts AS start_ts, if(next_state = '{normal}', next_change_ts, NULL) AS end_ts,
       prev_state IS NOT DISTINCT FROM '{normal}' AS observed_start,
       prev_state IS DISTINCT FROM '{normal}' AS left_censored,
       next_state IS DISTINCT FROM '{normal}' AS right_censored,
       next_state = 'ambiguous' AS ambiguous_end,
       if(next_state = '{normal}', date_diff('microsecond', ts, next_change_ts) / 3.6e9, NULL) AS duration_hours
FROM {source} WHERE state = '{fault}'"""


def coverage_sql(source: str) -> str:
    return f"""
SELECT CAST(x.d AS DATE) AS day, count(j.ts) AS events, count(DISTINCT hour(j.ts)) AS observed_hours,
       count(DISTINCT j.channel_id) AS channels
FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM {source}) x
LEFT JOIN {source} j ON j.ts::DATE = x.d GROUP BY x.d"""


def panel_sql(daily: str, cover: str, changes: str, runs: str, meta: str, normal: str, history: int) -> str:
    """Panel row by row: every feature is a sum over the days before the date."""
    cells = []
    for w in fv.PANEL_WINDOWS:
        near = f"FILTER (WHERE d.day >= g.t - {w})"
        cells += [f"coalesce(sum(d.{m}) {near}, 0)::BIGINT AS {m}_{w}d" for m in fv.COUNT_MEASURES]
        total = f"nullif(sum(d.numeric_n) {near}, 0)"
        mean = f"(sum(d.numeric_sum) {near} / {total})"
        cells += [
            f"coalesce({total}, 0)::BIGINT AS numeric_n_{w}d",
            f"round({mean}, 9) AS numeric_mean_{w}d",
            f"CASE WHEN {total} > 0 THEN round(sqrt(greatest(0, sum(d.numeric_sumsq) {near} / {total} - {mean} * {mean})), 4) END"
            f" AS numeric_std_{w}d",
            f"min(d.numeric_min) {near} AS numeric_min_{w}d",
            f"max(d.numeric_max) {near} AS numeric_max_{w}d",
        ]
    for w in fv.ACTIVE_WINDOWS:
        cells.append(f"count(DISTINCT d.day) FILTER (WHERE d.day >= g.t - {w})::INT AS active_days_{w}d")

    def full(width: int) -> str:
        return f"coalesce(k.full_{width}, 0)"

    def day_is_full(offset: int) -> str:
        return f"f.t + {offset} IN (SELECT day FROM {cover} WHERE observed_hours = 24)"

    def started(offset: int) -> str:
        return (
            f"EXISTS (SELECT 1 FROM {runs} r WHERE r.observed_start AND r.channel_id = f.channel_id"
            f" AND r.start_ts >= f.t + {offset} AND r.start_ts < f.t + {offset + 1})"
        )

    def seen(offset: int) -> str:
        return f"f.last_seen >= (f.t + {offset})::TIMESTAMP"

    return f"""
SELECT f.channel_id, f.t::TIMESTAMP AS prediction_time, (f.t + 1)::TIMESTAMP AS target_start,
       (f.t + 2)::TIMESTAMP AS target_end, m.sensor_type AS sensor_type_current,
       m.object_id AS object_id_current, m.system_type AS system_type_current,
       f.* EXCLUDE (channel_id, t, feature_max_ts, first_seen, last_seen),
       round(date_diff('microsecond', f.feature_max_ts, f.t::TIMESTAMP) / 3.6e9, 6) AS hours_since_last_event,
       round(date_diff('microsecond', f.first_seen, f.t::TIMESTAMP) / 8.64e10, 6) AS history_days,
       round(alarms_7d / nullif(events_7d, 0), 9) AS alarm_rate_7d,
       round(events_1d / nullif(events_7d / 7.0, 0), 9) AS event_ratio_1d_7d,
       round((events_7d / 7.0) / nullif(events_30d / 30.0, 0), 9) AS event_ratio_7d_30d,
       isodow(f.t)::INT AS dow, month(f.t)::INT AS month,
       round(sin(isodow(f.t) * 2 * pi() / 7), 6) AS dow_sin, round(cos(isodow(f.t) * 2 * pi() / 7), 6) AS dow_cos,
       {full(30)} AS history_complete_days, {full(1)} AS global_complete_days_1d, {full(7)} AS global_complete_days_7d,
       CASE WHEN {started(1)} THEN 1 WHEN {day_is_full(1)} AND {seen(2)} THEN 0 END AS target_fault_24_48h,
       CASE WHEN {started(0)} THEN 1 WHEN {day_is_full(0)} AND {seen(1)} THEN 0 END AS target_fault_0_24h,
       f.feature_max_ts, s.state AS last_explicit_state, s.ts AS last_state_ts,
       (s.state IS NOT DISTINCT FROM '{normal}'
         AND f.t::TIMESTAMP - f.first_seen >= INTERVAL {history} DAY AND {day_is_full(-1)}) AS at_risk_with_history,
       {seen(2)} AS channel_followup_48h, {day_is_full(0)} AS global_complete_0_24h,
       {day_is_full(1)} AS global_complete_24_48h, f.first_seen, f.last_seen
FROM (SELECT g.channel_id, g.t, {", ".join(cells)}, max(d.last_ts) AS feature_max_ts,
             any_value(b.first_seen) AS first_seen, any_value(b.last_seen) AS last_seen
      FROM (SELECT DISTINCT channel_id, day + k::INT AS t FROM {daily}, range(1, 31) x(k)
            WHERE day + k::INT <= (SELECT max(day) + 1 FROM {cover})
              AND day + k::INT >= (SELECT min(day) FROM {cover})) g
      JOIN {daily} d ON d.channel_id = g.channel_id AND d.day >= g.t - 30 AND d.day < g.t
      JOIN (SELECT channel_id, min(first_ts) AS first_seen, max(last_ts) AS last_seen
            FROM {daily} GROUP BY channel_id) b ON b.channel_id = g.channel_id
      GROUP BY g.channel_id, g.t) f
LEFT JOIN {meta} m ON m.channel_key::VARCHAR = f.channel_id
LEFT JOIN (SELECT x.t, count(*) AS full_30, count(*) FILTER (WHERE c.day >= x.t - 7) AS full_7,
             count(*) FILTER (WHERE c.day >= x.t - 1) AS full_1
           FROM (SELECT day + 1 AS t FROM {cover}) x
           JOIN (SELECT day FROM {cover} WHERE observed_hours = 24) c ON c.day < x.t AND c.day >= x.t - 30
           GROUP BY x.t) k ON k.t = f.t
ASOF LEFT JOIN {changes} s ON s.channel_id = f.channel_id AND s.ts < f.t::TIMESTAMP"""


part("daily_t", daily_sql("journal_t", B.WORDS))
part(
    "state_events_t",
    "SELECT channel_id, date_trunc('hour', ts) AS ts, state, alarm, event_id"
    " FROM journal_t WHERE state IN ('error', 'view')",
)
part("instants_t", instants_sql("state_events_t"))
part("changes_t", changes_sql("instants_t"))
part("transitions_t", timeline_sql("changes_t"))
part("runs_t", runs_sql("transitions_t", B.WORDS.fault, B.WORDS.normal))
part("coverage_t", coverage_sql("state_events_t"))
part(
    "panel_t",
    panel_sql("daily_t", "coverage_t", "transitions_t", "runs_t", "channels_t", "view", B.HISTORY_DAYS),
)
part("order_daily_t", daily_sql("order_journal_t", B.ORDER_WORDS))
part(
    "order_instants_t",
    instants_sql("(SELECT * FROM order_journal_t WHERE state IN ('F', 'O')) o"),
)
part("order_changes_t", changes_sql("order_instants_t"))
part("order_transitions_t", timeline_sql("order_changes_t"))
part("order_runs_t", runs_sql("order_transitions_t", B.ORDER_WORDS.fault, B.ORDER_WORDS.normal))
part("order_coverage_t", coverage_sql("order_journal_t"))
part(
    "order_panel_t",
    panel_sql("order_daily_t", "order_coverage_t", "order_transitions_t", "order_runs_t", "channels_t", "O", 30),
)
