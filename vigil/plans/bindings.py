"""The given tables seen as a journal, dictionaries and scored rows.

``events`` is the journal (a user is a channel, the event type is the state),
``customer`` the channel dictionary, ``nation`` the objects.  ``orders`` is a
second journal over several years and ``lineitem`` a table of scored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import calendar as C
from vigil.operators import panel as P
from vigil.operators import states as ST
from vigil.session import scratch_path
from vigil.sources import journal as J
from vigil.sources.tables import write_table

WORDS = C.StateWords(
    fault="error",
    normal="view",
    power_off="signup",
    undefined=("click", "gone"),
    disabled="disabled",
    smoke="purchase",
    gas="gas",
    flood="flood",
)
ORDER_WORDS = C.StateWords(
    fault="F",
    normal="O",
    power_off="-",
    undefined=("P",),
    disabled="-",
    smoke="-",
    gas="-",
    flood="-",
)
HISTORY_DAYS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed journal of all events."""
    return as_journal(table(spark, sf_dir, "events"))


def as_journal(events: DataFrame) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    state = (
        F.when((kind == "signup") & (value > 100), F.lit("disabled"))
        .when((kind == "click") & (value > 120), F.lit("gas"))
        .when((kind == "purchase") & (value > 150), F.lit("flood"))
        .otherwise(kind)
    )
    measured = kind.isin("click", "signup", "purchase")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("channel_id"),
        "ts",
        F.when(value > 50, F.lit(True)).when(value >= 1, F.lit(False)).alias("alarm"),
        F.when(measured & (value < 150), value).alias("num"),
        (measured & (value >= 150)).alias("nonfinite"),
        state.alias("state"),
    )


JOURNAL_SQL = """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS channel_id, ts,
       CASE WHEN value > 50 THEN true WHEN value >= 1 THEN false END AS alarm,
       CASE WHEN event_type IN ('click','signup','purchase') AND value < 150 THEN value END AS num,
       event_type IN ('click','signup','purchase') AND value >= 150 AS nonfinite,
       CASE WHEN event_type = 'signup' AND value > 100 THEN 'disabled'
            WHEN event_type = 'click' AND value > 120 THEN 'gas'
            WHEN event_type = 'purchase' AND value > 150 THEN 'flood'
            ELSE event_type END AS state
FROM events"""


def raw_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_journal(table(spark, sf_dir, "events"))


def as_raw_journal(events: DataFrame) -> DataFrame:
    """The same events as six text columns, with the faults a raw journal has.

    Identifiers are reused, alarms appear in every spelling, numbers use a
    decimal comma, some times and channels cannot be parsed and the events
    above a value come twice.
    """
    value, kind = F.col("value"), F.col("event_type")
    text_value = (
        F.when(kind == "error", F.concat(F.lit(" "), F.upper(kind), F.lit(" ")))
        .when(kind == "view", kind)
        .when((kind == "purchase") & (value > 150), F.lit("NaN"))
        .when((kind == "signup") & (value > 150), F.lit("-inf"))
        .when((kind == "click") & (value < 1), F.lit(""))
        .otherwise(F.replace(value.cast("string"), F.lit("."), F.lit(",")))
    )
    alarm = (
        F.when(kind == "error", F.lit("t"))
        .when(kind == "view", F.lit("нет"))
        .when(kind == "click", F.lit(" ДА "))
        .when(kind == "signup", F.lit("0"))
        .otherwise(F.lit("maybe"))
    )
    channel = (
        F.when(value.between(1, 1.5), F.concat(F.lit("x"), F.col("user_id").cast("string")))
        .when(value.between(1.6, 1.7), F.lit(""))
        .when(value.between(1.8, 1.9), F.lit("999999999"))
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    )
    clock = F.when((kind == "signup") & (value < 1), F.lit("время")).otherwise(
        F.date_format("ts", "HH:mm:ss")
    )
    once = events.select(
        F.get_json_object("props", "$.k").alias("event_id"),
        channel.alias("channel_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("raw_date"),
        clock.alias("raw_time"),
        alarm.alias("alarm_raw"),
        text_value.alias("value_raw"),
        "value",
    )
    copies = once.where(F.col("value") > 90)
    return once.unionAll(copies).drop("value")


RAW_JOURNAL_SQL = """
SELECT json_extract_string(props, '$.k') AS event_id,
       CASE WHEN value BETWEEN 1 AND 1.5 THEN 'x' || CAST(user_id AS VARCHAR)
            WHEN value BETWEEN 1.6 AND 1.7 THEN ''
            WHEN value BETWEEN 1.8 AND 1.9 THEN '999999999'
            ELSE ' ' || CAST(user_id AS VARCHAR) END AS channel_id,
       strftime(ts, '%Y-%m-%d') AS raw_date,
       CASE WHEN event_type = 'signup' AND value < 1 THEN 'время' ELSE strftime(ts, '%H:%M:%S') END AS raw_time,
       CASE event_type WHEN 'error' THEN 't' WHEN 'view' THEN 'нет' WHEN 'click' THEN ' ДА '
            WHEN 'signup' THEN '0' ELSE 'maybe' END AS alarm_raw,
       CASE WHEN event_type = 'error' THEN ' ERROR ' WHEN event_type = 'view' THEN 'view'
            WHEN event_type = 'purchase' AND value > 150 THEN 'NaN'
            WHEN event_type = 'signup' AND value > 150 THEN '-inf'
            WHEN event_type = 'click' AND value < 1 THEN ''
            ELSE replace(CAST(value AS VARCHAR), '.', ',') END AS value_raw
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 90)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel dictionary: segment as sensor type, nation as object, region as system."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias(fv.CHANNEL_KEY),
            F.col("c_mktsegment").alias(fv.SENSOR_TYPE),
            F.col("c_nationkey").cast("long").alias(fv.OBJECT_KEY),
            F.col("r_name").alias(fv.SYSTEM_TYPE),
            F.col("c_name").alias(fv.SENSOR_NAME),
            F.concat(F.lit("tag-"), F.col("n_name")).alias(fv.SYSTEM_TAG),
        )
    )


CHANNELS_SQL = """
SELECT c_custkey AS channel_key, c_mktsegment AS sensor_type, CAST(c_nationkey AS BIGINT) AS object_id,
       r_name AS system_type, c_name AS sensor_name, 'tag-' || n_name AS system_tag
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias(fv.OBJECT_KEY), F.col("n_name").alias(fv.OBJECT_NAME)
    )


def typed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = J.typed(raw_journal(spark, sf_dir))
    return J.attach_channels(events, channels(spark, sf_dir)).select(J.CLEAN_COLUMNS)


TYPED_RAW_SQL = """
SELECT trim(r.event_id) AS event_id, trim(r.channel_id) AS channel_id, r.raw_date, r.raw_time, r.alarm_raw,
       r.value_raw, try_strptime(raw_date || ' ' || raw_time, '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN lower(trim(alarm_raw)) IN ('t','true','1','да') THEN true
            WHEN lower(trim(alarm_raw)) IN ('f','false','0','нет') THEN false END AS alarm,
       CASE WHEN isfinite(n) THEN n END AS num, coalesce(NOT isfinite(n), false) AS nonfinite,
       CASE WHEN n IS NULL THEN lower(trim(value_raw)) END AS state,
       c.sensor_type, c.object_id, c.system_type
FROM (SELECT *, try_cast(replace(trim(value_raw), ',', '.') AS DOUBLE) AS n FROM raw_journal_t) r
LEFT JOIN channels_t c ON try_cast(trim(r.channel_id) AS BIGINT) = c.channel_key"""


def hourly(events: DataFrame) -> DataFrame:
    """Journal with times cut to the hour, which makes messages coincide."""
    return events.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(ST.with_states(journal(spark, sf_dir), [WORDS.fault, WORDS.normal]))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.timeline(state_events(spark, sf_dir), [WORDS.fault, WORDS.normal])


def fault_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.episodes(transitions(spark, sf_dir), WORDS.fault, WORDS.normal)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.daily_aggregate(journal(spark, sf_dir), WORDS)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the fault and normal messages; it has incomplete days."""
    return C.dense_coverage(C.day_coverage(state_events(spark, sf_dir)))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.sources.dictionaries import channel_metadata

    return channel_metadata(channels(spark, sf_dir))


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.build(
        daily(spark, sf_dir),
        coverage(spark, sf_dir),
        transitions(spark, sf_dir),
        metadata(spark, sf_dir),
        words=WORDS,
        min_history_days=HISTORY_DAYS,
    )


_PREPARED: dict[tuple[str, str, str], str] = {}


def prepared(spark: SparkSession, sf_dir: str, name: str, build: Callable) -> DataFrame:
    """Table of a stage that many queries read, written once per application.

    The panel and the episodes are results of their own; what comes after them
    (splits, evaluation, serving) reads the written tables.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PREPARED:
        path = scratch_path(spark, name)
        write_table(build(spark, sf_dir), path)
        _PREPARED[key] = path
    return spark.read.parquet(_PREPARED[key])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, "panel", build_panel)


def fault_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, "fault_runs", fault_runs)


def order_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sparse journal over several years."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_custkey").cast("string").alias("channel_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderpriority").like("1%").alias("alarm"),
        F.col("o_totalprice").alias("num"),
        F.lit(False).alias("nonfinite"),
        F.col("o_orderstatus").alias("state"),
    )


ORDER_JOURNAL_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_custkey AS VARCHAR) AS channel_id,
       o_orderdate AS ts, o_orderpriority LIKE '1%' AS alarm, o_totalprice AS num,
       false AS nonfinite, o_orderstatus AS state
FROM orders"""


def order_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [ORDER_WORDS.fault, ORDER_WORDS.normal]
    return ST.timeline(order_journal(spark, sf_dir), words)


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.episodes(order_transitions(spark, sf_dir), ORDER_WORDS.fault, ORDER_WORDS.normal)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored rows: supplier as channel, returned or not as label."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("channel_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("prediction_time"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(
            F.col("l_returnflag") == "R",
            (F.col("l_quantity") + F.col("l_extendedprice") / 3000) / 100,
        )
        .otherwise((F.col("l_quantity") + F.col("l_tax") * 100) / 100)
        .alias("probability"),
        (F.lit(1.0) + F.col("l_tax")).alias("weight"),
        F.col("l_linestatus").alias("kind"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    )


SCORED_SQL = """
SELECT CAST(l_suppkey AS VARCHAR) AS channel_id, l_shipdate AS prediction_time, l_orderkey AS order_id,
       l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       CASE WHEN l_returnflag = 'R' THEN (l_quantity + l_extendedprice / 3000) / 100
            ELSE (l_quantity + l_tax * 100) / 100 END AS probability,
       CAST(1.0 AS DOUBLE) + l_tax AS weight, l_linestatus AS kind, strftime(l_shipdate, '%Y-%m') AS month
FROM lineitem"""
