"""Queries: the operators on a stream of the journal, which give out what the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.plans import bindings as B
from vigil.plans.queries_panel import _sessions_sql
from vigil.plans.registry import part, query
from vigil.session import scratch_path
from vigil.sources import journal as J
from vigil.streaming import incremental as I

_CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM journal_t)"


def _stream(spark, sf):
    schema = B.table(spark, sf, "events").schema
    return I.journal_stream(spark, f"{sf}/[e]vents.parquet", schema)  # a stream reads one file by a pattern only


def _run(spark, stream, name):
    return I.run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-log"))


@query(
    "stream_daily_counts",
    f"""SELECT channel_id, ts::DATE::TIMESTAMP AS day, count(*) AS events, count(*) FILTER (WHERE alarm) AS alarms,
       count(*) FILTER (WHERE state = 'error') AS fault_messages, count(num) AS numeric_n, min(num) AS numeric_min,
       max(num) AS numeric_max FROM journal_t WHERE ts::DATE + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""",
)
def _(spark, sf):
    return _run(spark, I.daily_counts(B.as_journal(_stream(spark, sf)), words=B.WORDS), "counts")


@query(
    "stream_copies",
    """SELECT raw_date, count(*) AS rows FROM (SELECT DISTINCT event_id, channel_id, raw_date, raw_time, alarm_raw,
       value_raw FROM typed_raw_t WHERE ts IS NOT NULL) GROUP BY 1""",
)
def _(spark, sf):
    rows = J.typed(B.as_raw_journal(_stream(spark, sf))).where(F.col("ts").isNotNull())
    kept = I.suppress_copies(rows).select(*fv.RAW_COLUMNS)
    return _run(spark, kept, "copies").groupBy("raw_date").agg(F.count("*").alias("rows"))


@query(
    "stream_sessions",
    f"""SELECT channel_id, start_ts::DATE::TIMESTAMP AS day, start_ts, end_ts, messages FROM ({_sessions_sql(240, True)})
        WHERE end_ts + INTERVAL 14400000001 MICROSECOND <= {_CLOSED}""",
)
def _(spark, sf):
    return _run(spark, I.sessions(B.as_journal(_stream(spark, sf)), 240), "sessions")


_HOURS = "(SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM journal_t WHERE state IN ('error', 'view'))"
part(
    "closed_changes_t",
    f"""SELECT *, lag(state) OVER (PARTITION BY channel_id ORDER BY ts) AS before
        FROM (SELECT channel_id, ts, if(min(state) = max(state), min(state), '') AS state FROM {_HOURS} GROUP BY ALL)
        WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM {_HOURS}) QUALIFY state IS DISTINCT FROM before""",
)


@query(
    "stream_fault_episodes",
    """SELECT channel_id, start_ts, CASE WHEN next_state = 'view' THEN next_ts END AS end_ts, observed_start,
       (next_state = '')::INT AS ambiguous_end
       FROM (SELECT channel_id, ts AS start_ts, state, coalesce(before = 'view', false)::INT AS observed_start,
               lead(ts) OVER (PARTITION BY channel_id ORDER BY ts) AS next_ts,
               lead(state) OVER (PARTITION BY channel_id ORDER BY ts) AS next_state FROM closed_changes_t)
       WHERE state = 'error' AND next_ts IS NOT NULL""",
)
def _(spark, sf):
    events = B.hourly(B.as_journal(_stream(spark, sf)))
    instants = I.state_instants(events, words=B.WORDS)
    return I.follow_episodes(instants, scratch_path(spark, "episodes"), scratch_path(spark, "episodes-log"), B.WORDS)
