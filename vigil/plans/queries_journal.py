"""Queries: reading, cleaning and auditing journals and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import calendar as C
from vigil.operators import differences as DIF
from vigil.operators import profile as R
from vigil.operators import quality as Q
from vigil.plans import bindings as B
from vigil.plans.registry import part, query
from vigil.session import materialize, scratch_path
from vigil.sources import dictionaries as D
from vigil.sources import journal as J
from vigil.sources import tables as T

_TYPED = "SELECT * REPLACE (alarm::INT AS alarm, nonfinite::INT AS nonfinite) FROM "
part("clean_t", "SELECT DISTINCT * FROM typed_raw_t")
part("valid_t", "SELECT * FROM clean_t WHERE ts IS NOT NULL AND channel_id <> ''")


@query("typed_journal", _TYPED + "typed_raw_t")
def _(spark, sf):
    return B.typed_raw(spark, sf)


# A text file does not tell an empty field from a missing one.
@query(
    "journal_text_source",
    """SELECT * REPLACE (alarm::INT AS alarm, nonfinite::INT AS nonfinite, nullif(channel_id, '') AS channel_id,
       nullif(value_raw, '') AS value_raw, nullif(state, '') AS state) FROM typed_raw_t""",
)
def _(spark, sf):
    root = scratch_path(spark, "journal")
    names = dict(zip(fv.RAW_COLUMNS, fv.JOURNAL_COLUMNS))
    raw = B.raw_journal(spark, sf).withColumnsRenamed(names)
    (
        raw.write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(f"{root}/ext-journal-2024/ext-journal-2024.csv")
    )
    path = J.journal_path(spark, root, 2024)
    return J.read_journal(spark, path, B.channels(spark, sf))


@query("journal_prepared_source", _TYPED + "typed_raw_t")
def _(spark, sf):
    root = scratch_path(spark, "journal")
    typed = B.typed_raw(spark, sf)
    prepared = typed.select(
        F.col("event_id").alias(fv.PREPARED_EVENT_ID[0]),
        F.col("channel_id").alias(fv.PREPARED_CHANNEL_ID[1]),
        F.col("raw_date").alias("дата"),
        F.col("raw_time").alias("время"),
        F.col("alarm_raw").alias(fv.PREPARED_ALARM_RAW),
        F.col("value_raw").alias(fv.PREPARED_VALUE_RAW),
        F.col("ts").alias(fv.PREPARED_TS),
        F.col("alarm").alias(fv.PREPARED_ALARM),
        F.when(F.col("nonfinite"), F.lit(float("inf")))
        .otherwise(F.col("num"))
        .alias(fv.PREPARED_NUM),
        F.col("state").alias(fv.PREPARED_STATE),
        F.col("sensor_type").alias(fv.SENSOR_TYPE),
        F.col("object_id").alias(fv.OBJECT_KEY),
        F.col("system_type").alias(fv.SYSTEM_TYPE),
    )
    T.write_table(prepared, f"{root}/processed/events_2024.parquet")
    return J.read_journal(spark, J.journal_path(spark, root, 2024), B.channels(spark, sf))


@query("clean_journal", _TYPED + "valid_t")
def _(spark, sf):
    return Q.clean_journal(B.typed_raw(spark, sf))


@query(
    "invalid_rows",
    _TYPED + "clean_t WHERE ts IS NULL OR coalesce(channel_id, '') = '' OR alarm IS NULL",
)
def _(spark, sf):
    return Q.invalid_sample(Q.drop_exact_duplicates(B.typed_raw(spark, sf)), None)


@query(
    "exact_duplicates",
    """SELECT event_id, channel_id, raw_date, raw_time, alarm_raw, value_raw, count(*) AS copies
       FROM typed_raw_t GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf):
    return Q.exact_duplicates(B.typed_raw(spark, sf))


@query(
    "reused_event_ids",
    "SELECT event_id, count(*) AS variants FROM clean_t WHERE event_id <> '' GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf):
    return Q.reused_event_ids(Q.drop_exact_duplicates(B.typed_raw(spark, sf)))


part(
    "audit_t",
    """SELECT substr(raw_date, 1, 4)::INT AS year, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts,
       count(DISTINCT channel_id) AS channels, count(*) FILTER (WHERE alarm) AS alarms,
       count(*) - count(ts) AS bad_ts, count(*) FILTER (WHERE year(ts) <> substr(raw_date, 1, 4)::INT) AS wrong_year,
       count(*) - count(alarm) AS bad_alarm, count(*) FILTER (WHERE coalesce(event_id, '') = '') AS missing_event_id,
       count(*) FILTER (WHERE coalesce(channel_id, '') = '') AS missing_channel_id,
       count(*) FILTER (WHERE channel_id IS NOT NULL AND try_cast(channel_id AS BIGINT) IS NULL) AS noninteger_channel_id,
       count(*) - count(sensor_type) AS unknown_channel_rows, count(*) - count(object_id) AS missing_object_rows,
       count(*) FILTER (WHERE nonfinite) AS nonfinite_rows,
       count(*) FILTER (WHERE coalesce(trim(value_raw), '') = '') AS missing_value_rows,
       count(*) - count(DISTINCT event_id) AS repeated_or_null_event_ids
       FROM typed_raw_t GROUP BY 1""",
)


@query("year_audit", "SELECT * FROM audit_t")
def _(spark, sf):
    return Q.year_audit(B.typed_raw(spark, sf), F.substring("raw_date", 1, 4).cast("int"))


@query(
    "row_balance",
    """SELECT sum(rows)::BIGINT AS source_rows, sum(bad_ts)::BIGINT AS bad_ts,
       round(100 * sum(unknown_channel_rows) / sum(rows), 9) AS unknown_channel_percent,
       (SELECT count(*) FROM typed_raw_t) - (SELECT count(*) FROM clean_t) AS exact_copies,
       (SELECT count(*) FROM clean_t) - sum(bad_ts)::BIGINT AS kept_rows FROM audit_t""",
)
def _(spark, sf):
    events = B.typed_raw(spark, sf)
    audit = Q.year_audit(events, F.substring("raw_date", 1, 4).cast("int"))
    balance = Q.row_balance(audit, Q.exact_duplicates(events))
    return balance.withColumn(
        "unknown_channel_percent", F.round("unknown_channel_percent", 9)
    )


@query(
    "source_signature",
    """SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', event_id, channel_id, raw_date, raw_time,
       alarm_raw, value_raw)), 1, 12))::BIGINT)::VARCHAR AS signature FROM raw_journal_t""",
)
def _(spark, sf):
    found = Q.signature(B.raw_journal(spark, sf), portable=True)
    return found.withColumn("signature", F.col("signature").cast("string"))


@query(
    "source_parity",
    """SELECT raw_date, count(*) AS source_rows, count(DISTINCT r) AS prepared_rows,
       (count(*) = count(DISTINCT r))::INT AS matches FROM (SELECT raw_date, r FROM raw_journal_t r) GROUP BY 1""",
)
def _(spark, sf):
    text = B.raw_journal(spark, sf)
    return Q.source_parity(Q.drop_exact_duplicates(text), text, ["raw_date"])


@query(
    "repaired_journal",
    "SELECT raw_date, count(*) AS rows, 0 AS prepared_used FROM raw_journal_t GROUP BY 1",
)
def _(spark, sf):
    text = B.raw_journal(spark, sf)
    source, used = Q.repaired_source(Q.drop_exact_duplicates(text), text)
    return source.groupBy("raw_date").agg(
        F.count("*").alias("rows"), F.lit(int(used)).alias("prepared_used")
    )


def _states(spark, sf):
    """State dictionary made from parts: brand as type, size as state set."""
    return B.table(spark, sf, "part").select(
        F.col("p_brand").alias(fv.SENSOR_TYPE),
        F.col("p_size").cast("long").alias(fv.STATE_SET),
        F.col("p_type").alias(fv.STATE_NAME),
        F.when(F.col("p_retailprice") > 1450, "true").otherwise("false").alias(fv.STATE_ALARM),
        S.normal_text(F.col("p_type")).alias("state"),
    )


part(
    "states_t",
    """SELECT p_brand AS sensor_type, p_size::BIGINT AS state_set, lower(trim(p_type)) AS state,
       if(p_retailprice > 1450, 'true', 'false') AS alarm FROM part""",
)


@query(
    "dictionary_keys",
    """SELECT 'channels' AS "table", count(*) AS rows, count(*) - count(DISTINCT channel_key) AS extra_duplicate_keys,
         count(*) - count(channel_key) AS missing_keys, 0::BIGINT AS extra_exact_duplicates FROM channels_t
       UNION ALL SELECT 'objects', count(*), count(*) - count(DISTINCT n_nationkey), 0, 0 FROM nation
       UNION ALL SELECT 'states', count(*), count(*) - count(DISTINCT sensor_type), 0,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM states_t)) FROM states_t""",
)
def _(spark, sf):
    states = _states(spark, sf).drop(fv.STATE_NAME)
    return (
        Q.key_audit(B.channels(spark, sf), fv.CHANNEL_KEY, "channels")
        .unionByName(Q.key_audit(B.objects(spark, sf), fv.OBJECT_KEY, "objects"))
        .unionByName(Q.key_audit(states, fv.SENSOR_TYPE, "states"))
    )


@query(
    "state_conflicts",
    """SELECT sensor_type, state_set, state, count(DISTINCT alarm) AS alarm_variants FROM states_t
       GROUP BY ALL HAVING count(DISTINCT alarm) > 1""",
)
def _(spark, sf):
    return Q.state_conflicts(_states(spark, sf))


@query(
    "state_lookup",
    """SELECT sensor_type, state, count(DISTINCT alarm) AS alarm_variants, min(alarm) AS dict_alarm,
       count(DISTINCT state_set) AS n_sets FROM states_t GROUP BY ALL""",
)
def _(spark, sf):
    return Q.state_lookup(_states(spark, sf))


@query(
    "channels_without_objects",
    """SELECT channel_key AS channel_id, object_id FROM channels_t WHERE object_id NOT IN
       (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0)""",
)
def _(spark, sf):
    known = B.objects(spark, sf).where(F.col(fv.OBJECT_KEY) % 5 != 0).select(fv.OBJECT_KEY)  # some objects are not listed
    lost = Q.without_dictionary(B.channels(spark, sf), known, fv.OBJECT_KEY)
    return lost.select(
        F.col(fv.CHANNEL_KEY).alias("channel_id"), F.col(fv.OBJECT_KEY).alias("object_id")
    )


@query(
    "validated_join",
    """SELECT j.channel_id, m.sensor_type AS sensor_type_current, m.system_type AS system_type_current,
       count(*) AS events FROM journal_t j LEFT JOIN channels_t m ON m.channel_key::VARCHAR = j.channel_id GROUP BY ALL""",
)
def _(spark, sf):
    joined = Q.many_to_one(B.journal(spark, sf), B.metadata(spark, sf), ["channel_id"])
    return joined.groupBy("channel_id", "sensor_type_current", "system_type_current").agg(
        F.count("*").alias("events")
    )


@query(
    "observed_states",
    """SELECT year(ts)::INT AS year, sensor_type, state, alarm::INT AS alarm, count(*) AS events,
       count(DISTINCT channel_id) AS channels FROM valid_t WHERE state IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return R.observed_states(Q.clean_journal(B.typed_raw(spark, sf)), F.year("ts"))


part(
    "years_t",
    """SELECT year(ts)::INT AS year, channel_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events,
       count(*) FILTER (WHERE alarm) AS alarms, any_value(c.sensor_type) AS sensor_type,
       any_value(c.object_id) AS object_id, count(num) AS numeric_n, min(num) AS numeric_min,
       max(num) AS numeric_max, count(DISTINCT num) AS numeric_distinct
       FROM order_journal_t o LEFT JOIN
         channels_t c ON c.channel_key::VARCHAR = o.channel_id
       GROUP BY year(ts), channel_id""",
)


def _channel_years(spark, sf):
    return R.channel_years(J.attach_channels(B.order_journal(spark, sf), B.channels(spark, sf)), F.year("ts"))


@query("channel_years", "SELECT * FROM years_t")
def _(spark, sf):
    return _channel_years(spark, sf)


@query(
    "channel_composition",
    """SELECT year, channels, if(year = (SELECT min(year) FROM years_t), NULL, fresh) AS new_vs_previous_year,
       if(year = (SELECT min(year) FROM years_t), NULL, gone) AS disappeared_vs_previous_year,
       round(top1 / events, 9) AS top1_event_share, round(top10 / events, 9) AS top10_event_share
       FROM (SELECT y.year, count(*) AS channels, sum(events) AS events, max(events) AS top1,
               (SELECT count(*) FROM years_t a WHERE a.year = y.year AND a.channel_id NOT IN
                  (SELECT channel_id FROM years_t b WHERE b.year = y.year - 1)) AS fresh,
               (SELECT count(*) FROM years_t a WHERE a.year = y.year - 1 AND a.channel_id NOT IN
                  (SELECT channel_id FROM years_t b WHERE b.year = y.year)) AS gone,
               list_sum(list_slice(list_reverse_sort(list(events)), 1, 10)) AS top10
             FROM years_t y GROUP BY y.year)""",
)
def _(spark, sf):
    found = R.composition(_channel_years(spark, sf))
    return found.withColumns(
        {c: F.round(c, 9) for c in ("top1_event_share", "top10_event_share")}
    )


@query(
    "type_years",
    """SELECT year, sensor_type, sum(events)::BIGINT AS events, sum(alarms)::BIGINT AS alarms,
       count(*) AS channels FROM years_t GROUP BY ALL""",
)
def _(spark, sf):
    return R.type_years(_channel_years(spark, sf))


@query(
    "numeric_types",
    """SELECT year, sensor_type, count(*) AS numeric_channels,
       count(*) FILTER (WHERE numeric_distinct = 1) AS constant_channels, sum(numeric_n)::BIGINT AS numeric_n,
       min(numeric_min) AS min_observed, max(numeric_max) AS max_observed
       FROM years_t WHERE numeric_n > 0 GROUP BY ALL""",
)
def _(spark, sf):
    return R.numeric_types(_channel_years(spark, sf))


@query("unknown_channels", "SELECT * FROM years_t WHERE sensor_type IS NULL")
def _(spark, sf):
    return R.unknown_channels(_channel_years(spark, sf))


part(
    "known_states_t",
    """SELECT DISTINCT c.sensor_type, j.state, c.object_id AS state_set, 'true' AS alarm
       FROM journal_t j JOIN channels_t c ON c.channel_key::VARCHAR = j.channel_id WHERE j.num > 100""",
)


@query(
    "state_semantics",
    """SELECT t.*, l.* EXCLUDE (sensor_type, state), round(alarm_events / events, 9) AS observed_alarm_rate,
         (n_sets IS NULL)::INT AS not_in_dictionary
       FROM (SELECT c.sensor_type, j.state, count(*) AS events, count(*) FILTER (WHERE alarm) AS alarm_events
             FROM journal_t j JOIN channels_t c ON c.channel_key::VARCHAR = j.channel_id GROUP BY ALL) t
       LEFT JOIN (SELECT sensor_type, state, count(DISTINCT alarm) AS alarm_variants, min(alarm) AS dict_alarm,
                    count(DISTINCT state_set) AS n_sets FROM known_states_t GROUP BY ALL) l
       USING (sensor_type, state)""",
)
def _(spark, sf):
    events = J.attach_channels(B.journal(spark, sf), B.channels(spark, sf))
    dictionary = events.where("num > 100").select(
        F.col("sensor_type").alias(fv.SENSOR_TYPE),
        F.col("object_id").alias(fv.STATE_SET),
        F.lit("true").alias(fv.STATE_ALARM),
        "state",
    )
    observed = R.observed_states(events, F.year("ts"))
    found = R.state_semantics(observed, Q.state_lookup(dictionary))
    return found.withColumn("observed_alarm_rate", F.round("observed_alarm_rate", 9))


@query(
    "target_candidates",
    """SELECT year(ts)::INT AS year, count(*) FILTER (WHERE state = 'F') AS F, count(*) FILTER (WHERE state = 'O') AS O,
       count(*) FILTER (WHERE state = 'P') AS P FROM order_journal_t GROUP BY ALL""",
)
def _(spark, sf):
    rows = B.order_journal(spark, sf).withColumn("year", F.year("ts"))
    return R.pivot_sum(rows, "year", "state", F.lit(1), ["F", "O", "P"])


@query(
    "duplicate_keys",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT channel_id, ts FROM state_events_t)) AS duplicate_keys
       FROM state_events_t""",
)
def _(spark, sf):
    return Q.duplicate_keys(B.state_events(spark, sf), ["channel_id", "ts"])


@query(
    "channel_bounds",
    "SELECT channel_id, min(ts) AS first_seen, max(ts) AS last_seen FROM journal_t GROUP BY 1",
)
def _(spark, sf):
    return C.channel_bounds(B.daily(spark, sf))


@query(
    "event_reconciliation",
    "SELECT count(*) AS daily_events, count(*) AS journal_events, 1 AS balanced FROM journal_t",
)
def _(spark, sf):
    events = B.journal(spark, sf)
    return Q.event_reconciliation(C.daily_aggregate(events, B.WORDS), events)


@query(
    "hazard_events",
    "SELECT channel_id, ts, state, alarm::INT AS alarm, event_id FROM journal_t WHERE state IN ('purchase', 'gas', 'flood')",
)
def _(spark, sf):
    events = B.journal(spark, sf).where(F.col("state").isin("purchase", "gas", "flood"))
    return events.select("channel_id", "ts", "state", "alarm", "event_id")


@query(
    "union_by_name",
    """SELECT kind, count(*) AS rows, count(channel_id) AS channels, count(num) AS numbers, count(line) AS lines
       FROM (SELECT 'order' AS kind, channel_id, num, NULL AS line FROM order_journal_t
             UNION ALL SELECT 'line', channel_id, NULL, line FROM scored_t) GROUP BY ALL""",
)
def _(spark, sf):
    left = B.order_journal(spark, sf).select(F.lit("order").alias("kind"), "channel_id", "num")
    right = B.scored(spark, sf).select(F.lit("line").alias("kind"), "channel_id", "line")
    whole = T.union_by_name([left, right])
    return whole.groupBy("kind").agg(
        F.count("*").alias("rows"),
        F.count("channel_id").alias("channels"),
        F.count("num").alias("numbers"),
        F.count("line").alias("lines"),
    )


@query(
    "merged_schema_source",
    """SELECT count(*) AS rows, count(num) AS numbers, count(kind) AS kinds FROM
       (SELECT channel_id, num, NULL AS kind FROM order_journal_t
        UNION ALL SELECT channel_id, NULL, kind FROM scored_t)""",
)
def _(spark, sf):
    root = scratch_path(spark, "parts")
    T.write_table(B.order_journal(spark, sf).select("channel_id", "num"), f"{root}/a")
    T.write_table(B.scored(spark, sf).select("channel_id", "kind"), f"{root}/b")
    whole = T.read_by_name(spark, [f"{root}/a", f"{root}/b"])
    return whole.agg(
        F.count("*").alias("rows"),
        F.count("num").alias("numbers"),
        F.count("kind").alias("kinds"),
    )


_ORDER_DAILY = (
    "SELECT * REPLACE (day::TIMESTAMP AS day, round(numeric_sum, 2) AS numeric_sum,"
    " round(numeric_sumsq / 1e6, 2) AS numeric_sumsq), year(day)::INT AS year FROM order_daily_t"
)


def _order_daily(spark, sf):
    daily = C.daily_aggregate(B.order_journal(spark, sf), B.ORDER_WORDS).drop("hour_mask")
    return daily.withColumns(
        {
            "numeric_sum": F.round("numeric_sum", 2),
            "numeric_sumsq": F.round(F.col("numeric_sumsq") / 1e6, 2),
            "year": F.year("day"),
        }
    )


@query("refreshed_partitions", _ORDER_DAILY)
def _(spark, sf):
    path = scratch_path(spark, "daily")
    daily = materialize(_order_daily(spark, sf), "daily")
    T.write_table(daily.withColumn("events", F.lit(0).cast("long")), path, ["year"])
    stale = spark.read.parquet(path).groupBy("year").agg(F.sum("events").alias("n"))
    changed = daily.join(stale.where("n = 0").select("year"), "year", "left_semi")
    T.overwrite_partitions(changed, path, ["year"])
    return spark.read.parquet(path).select(*daily.columns)


@query(
    "published_set",
    "SELECT channel_id, min(ts) AS first_seen, max(ts) AS last_seen FROM journal_t GROUP BY 1",
)
def _(spark, sf):
    root = scratch_path(spark, "published")
    bounds = C.channel_bounds(B.daily(spark, sf))
    T.publish({"bounds": bounds.withColumn("last_seen", F.col("first_seen"))}, root, "1")
    T.publish({"bounds": bounds}, root, "2")
    return T.read_published(spark, root, "bounds")


@query(
    "experiment_log",
    """SELECT sensor_type, count(*) * 2 AS entries, max(events) AS top FROM
       (SELECT sensor_type, year, sum(events)::BIGINT AS events FROM years_t GROUP BY ALL) GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "log")
    entries = R.type_years(_channel_years(spark, sf)).select("sensor_type", "year", "events")
    T.append_log(entries, path)
    T.append_log(entries, path)
    return (
        spark.read.parquet(path)
        .groupBy("sensor_type")
        .agg(F.count("*").alias("entries"), F.max("events").alias("top"))
    )


@query(
    "report_file",
    """SELECT year::VARCHAR AS year, sensor_type, sum(events)::BIGINT::VARCHAR AS events FROM years_t
       GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "report")
    T.write_report(R.type_years(_channel_years(spark, sf)).select("year", "sensor_type", "events"), path)
    return spark.read.option("header", True).csv(path)


@query(
    "multi_file_source",
    """SELECT o_orderstatus AS status, 2 * count(*) AS rows, 2 * count(DISTINCT o_custkey) AS channel_copies,
       min(o_orderdate) AS first_day FROM orders GROUP BY 1""",
)
def _(spark, sf):
    copy = scratch_path(spark, "orders")
    T.write_table(B.table(spark, sf, "orders"), copy)
    whole = T.read_many(spark, [f"{sf}/orders.parquet", copy])
    return whole.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("rows"),
        (2 * F.count_distinct("o_custkey")).alias("channel_copies"),
        F.min("o_orderdate").cast("timestamp_ntz").alias("first_day"),
    )


@query(
    "time_and_number_functions",
    """SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, hour(ts)::INT AS hour, isodow(ts)::INT AS dow,
       round(date_diff('microsecond', ts::DATE::TIMESTAMP, ts) / 3.6e9, 6) AS hours_since_midnight,
       ts + INTERVAL 24 HOUR AS next_day, ts::DATE::TIMESTAMP AS day, round(ln(1 + value), 9) AS log_value,
       round(sqrt(abs(value - 50)), 9) AS root, round(sin(2 * pi() * isodow(ts) / 7), 9) AS dow_sin,
       round(cos(2 * pi() * isodow(ts) / 7), 9) AS dow_cos, round(100 / nullif(floor(value / 10), 0), 9) AS safe_ratio,
       greatest(value, 25.0) AS at_least, (ts = date_trunc('day', ts))::INT AS midnight FROM events""",
)
def _(spark, sf):
    ts, value = F.col("ts"), F.col("value")
    dow = F.extract(F.lit("dayofweek_iso"), ts).cast("int")
    angle = 2 * F.pi() * dow / 7
    return B.table(spark, sf, "events").select(
        "event_id",
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.hour(ts).alias("hour"),
        dow.alias("dow"),
        F.round(S.hours_between(ts, F.to_date(ts).cast("timestamp_ntz")), 6).alias(
            "hours_since_midnight"
        ),
        (ts + F.expr("interval 24 hours")).alias("next_day"),
        F.to_date(ts).alias("day"),
        F.round(F.log1p(value), 9).alias("log_value"),
        F.round(F.sqrt(F.abs(value - 50)), 9).alias("root"),
        F.round(F.sin(angle), 9).alias("dow_sin"),
        F.round(F.cos(angle), 9).alias("dow_cos"),
        F.round(S.ratio(F.lit(100.0), F.floor(value / 10).cast("double")), 9).alias("safe_ratio"),
        F.greatest(value, F.lit(25.0)).alias("at_least"),
        S.is_midnight(ts).alias("midnight"),
    )


@query("file_inventory")
def _(spark, sf):
    files = T.file_inventory(spark, [f"{sf}/*.parquet"])
    return files.withColumn("modified", F.col("modified").cast("string"))


@query("file_manifest")
def _(spark, sf):
    return T.file_manifest(spark, [f"{sf}/events.parquet", f"{sf}/orders.parquet"])


_DIGESTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_WRITTEN = ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in _DIGESTED)


@query(
    "file_digests",
    f"""SELECT 'orders.parquet' AS file, sum(n)::BIGINT AS rows, {len(_DIGESTED)} AS columns, sha256(string_agg(d, '' ORDER BY block)) AS digest
       FROM (SELECT place // {T.DIGEST_ROWS} AS block, count(*) AS n, sha256(string_agg(d, '' ORDER BY place)) AS d
             FROM (SELECT row_number() OVER () - 1 AS place, sha256(concat({_WRITTEN})) AS d FROM orders) GROUP BY 1)""",
)
def _(spark, sf):
    return T.file_digests(B.table(spark, sf, "orders"), _DIGESTED)


def _plans(spark, sf):
    """Plan tables made from orders: priority as action, customer as object."""
    orders = B.table(spark, sf, "orders")
    word = F.substring("o_orderpriority", 1, 1)
    action = (
        F.when(word == "1", F.lit(fv.PLAN_ACTIONS[0]))
        .when(word == "2", F.lit(fv.PLAN_ACTIONS[1]))
        .when(word == "3", F.lit(fv.PLAN_ACTIONS[2]))
        .otherwise(F.col("o_orderpriority"))
    )
    monthly = orders.select(
        F.month("o_orderdate").alias("month"),
        action.alias("action"),
        F.col("o_custkey").alias("source_row"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias(
            "object_label"
        ),
        F.col("o_totalprice").alias("quantity"),
    )
    repair = orders.select(
        F.col("o_custkey").cast("string").alias("object_label"),
        F.col("o_orderdate").alias("dismantle_start"),
        (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, int(o_totalprice) - 50000)")).alias(
            "acceptance_date"
        ),
    )
    return repair, monthly


part(
    "monthly_plan_t",
    """SELECT month(o_orderdate)::INT AS month, o_custkey AS source_row,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'ТО' WHEN '2' THEN 'ТР' WHEN '3' THEN 'ТО+ТР'
         ELSE o_orderpriority END AS action,
       'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS object_label FROM orders""",
)


@query(
    "plan_counts",
    """SELECT month, count(*) FILTER (WHERE action = 'ТО') AS "ТО", count(*) FILTER (WHERE action = 'ТР') AS "ТР",
       count(*) FILTER (WHERE action = 'ТО+ТР') AS "ТО+ТР" FROM monthly_plan_t GROUP BY 1""",
)
def _(spark, sf):
    return R.plan_counts(_plans(spark, sf)[1])


@query(
    "plan_checks",
    """SELECT (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS repeated_labels,
       (SELECT count(*) FROM orders WHERE trunc(o_totalprice) < 50000) AS start_after_acceptance,
       (SELECT count(*) FROM monthly_plan_t WHERE action NOT IN ('ТО', 'ТР', 'ТО+ТР')) AS unknown_actions,
       0::BIGINT AS quantity_not_numeric""",
)
def _(spark, sf):
    repair, monthly = _plans(spark, sf)
    days = F.date_add(F.to_date("dismantle_start"), F.lit(0))
    late = F.col("acceptance_date")
    return Q.plan_checks(
        repair.withColumns({"dismantle_start": days.cast("timestamp_ntz"), "acceptance_date": late}),
        monthly,
    )


@query(
    "equipment_without_marks",
    """SELECT * FROM (SELECT c_custkey AS source_row, c_name AS equipment FROM customer
         UNION ALL SELECT 1000000000 + s_suppkey, s_name FROM supplier)
       WHERE source_row NOT IN (SELECT source_row FROM monthly_plan_t)""",
)
def _(spark, sf):
    equipment = B.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("source_row"), F.col("c_name").alias("equipment")
    )
    unplanned = B.table(spark, sf, "supplier").select(
        (F.lit(1_000_000_000) + F.col("s_suppkey")).alias("source_row"), F.col("s_name").alias("equipment")
    )
    equipment = equipment.unionByName(unplanned)
    return R.equipment_without_marks(equipment, _plans(spark, sf)[1])


@query(
    "plan_object_match",
    """SELECT object_label, (object_label IN (SELECT c_name FROM customer))::INT AS exact_name_match,
       count(*) AS rows FROM monthly_plan_t GROUP BY ALL""",
)
def _(spark, sf):
    known = B.table(spark, sf, "customer")
    marked = R.match_objects(_plans(spark, sf)[1], known, "c_name")
    return marked.groupBy("object_label", "exact_name_match").agg(F.count("*").alias("rows"))


@query(
    "plan_file_source",
    """SELECT month, action, count(*) AS rows, count(DISTINCT source_row) AS equipment FROM monthly_plan_t GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "plan")
    plan = _plans(spark, sf)[1].select("action", "month", "object_label", "source_row")
    T.write_report(plan, path)
    rows = D.read_table(spark, path, D.MONTHLY_PLAN_SCHEMA)
    return rows.groupBy("month", "action").agg(
        F.count("*").alias("rows"), F.count_distinct("source_row").alias("equipment")
    )


@query(
    "repair_file_source",
    """SELECT year(o_orderdate)::INT AS year, count(*) AS rows, count(DISTINCT o_custkey) AS objects,
       count(*) FILTER (WHERE trunc(o_totalprice) < 50000) AS accepted_early FROM orders GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "repair")
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("dismantle_start", "acceptance_date")}
    T.write_report(_plans(spark, sf)[0].withColumns(stamps), path)
    rows = D.read_table(spark, path, D.REPAIR_PLAN_SCHEMA)
    return rows.groupBy(F.year("dismantle_start").alias("year")).agg(
        F.count("*").alias("rows"),
        F.count_distinct("object_label").alias("objects"),
        S.count_if(F.col("acceptance_date") < F.col("dismantle_start")).alias("accepted_early"),
    )


@query(
    "equipment_file_source",
    """SELECT c_nationkey::INT AS schedule_group, c_mktsegment AS equipment, count(*) AS rows,
       sum(c_custkey)::BIGINT AS quantity FROM customer GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch_path(spark, "equipment")
    T.write_report(
        B.table(spark, sf, "customer").select(
            F.col("c_mktsegment").alias("equipment"),
            F.col("c_custkey").alias("quantity"),
            F.col("c_nationkey").alias("schedule_group"),
            F.col("c_name").alias("object_label"),
        ),
        path,
    )
    rows = D.read_table(spark, path, D.EQUIPMENT_SCHEMA)
    return rows.groupBy("schedule_group", "equipment").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("quantity")
    )


@query(
    "dictionary_files",
    """SELECT sensor_type, n_name AS object_name, count(*) AS channels, min(channel_key)::BIGINT AS first_channel,
       count(DISTINCT system_tag) AS tags FROM channels_t JOIN nation ON n_nationkey = object_id GROUP BY ALL""",
)
def _(spark, sf):
    """Channels and objects written as text, read as dictionaries and joined."""
    paths = scratch_path(spark, "channels"), scratch_path(spark, "objects")
    T.write_report(B.channels(spark, sf), paths[0])
    T.write_report(B.objects(spark, sf), paths[1])
    named = D.read_channels(spark, paths[0]).join(D.read_objects(spark, paths[1]), fv.OBJECT_KEY)
    return named.groupBy(F.col(fv.SENSOR_TYPE).alias("sensor_type"), F.col(fv.OBJECT_NAME).alias("object_name")).agg(
        F.count("*").alias("channels"),
        F.min(fv.CHANNEL_KEY).alias("first_channel"),
        F.count_distinct(fv.SYSTEM_TAG).alias("tags"),
    )


@query(
    "state_file_source",
    """SELECT c.sensor_type, lower(trim(j.state)) AS state, count(DISTINCT c.object_id) AS sets, count(DISTINCT j.alarm) AS alarm_variants
       FROM journal_t j JOIN channels_t c ON c.channel_key::VARCHAR = j.channel_id WHERE j.state IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    """Every state of the journal as a dictionary file; copies and spaces around a state go when it is read."""
    path = scratch_path(spark, "states")
    events = J.attach_channels(B.journal(spark, sf), B.channels(spark, sf)).where("state IS NOT NULL")
    entries = events.select(
        F.col("sensor_type").alias(fv.SENSOR_TYPE),
        F.col("object_id").alias(fv.STATE_SET),
        F.concat(F.lit(" "), "state").alias(fv.STATE_NAME),
        F.col("alarm").cast("string").alias(fv.STATE_ALARM),
    )
    T.write_report(entries, path)
    return D.read_states(spark, path).groupBy(F.col(fv.SENSOR_TYPE).alias("sensor_type"), "state").agg(
        F.count_distinct(fv.STATE_SET).alias("sets"), F.count_distinct(fv.STATE_ALARM).alias("alarm_variants")
    )


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_CHANGED_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + if(o_orderkey % 1000 = 7, 1, 0) AS o_totalprice
  FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 1000 = 11) WHERE o_orderkey % 1000 <> 3"""


def _one_side(side: str, more: str, less: str) -> str:
    columns = ", ".join(_ORDER_COLUMNS)
    return f"""SELECT {columns}, '{side}' AS side, count(*) AS times
       FROM (SELECT {columns} FROM ({more}) EXCEPT ALL SELECT {columns} FROM ({less})) GROUP BY ALL"""


@query(
    "source_differences",
    _one_side("left", "SELECT * FROM orders", _CHANGED_ORDERS)
    + " UNION ALL "
    + _one_side("right", _CHANGED_ORDERS, "SELECT * FROM orders"),
)
def _(spark, sf):
    """Orders against a copy with rows left out, changed and doubled."""
    orders = B.table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    rest = F.pmod("o_orderkey", F.lit(1000))
    price = F.when(rest == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    copy = orders.unionAll(orders.where(rest == 11)).where(rest != 3).withColumn("o_totalprice", price)
    return DIF.differing_rows(orders, copy, ["o_orderkey"], _ORDER_COLUMNS)
