"""The batch operators on a stream of journal files.

Each function takes a streaming journal (or a batch one, for which it gives the
same rows) and bounds its state by a watermark on the event time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import states as ST
from vigil.operators.calendar import StateWords
from vigil.operators.states import with_states
from vigil.session import materialize
from vigil.sources.tables import overwrite_partitions


def journal_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 16) -> DataFrame:
    """Typed journal files as they arrive; with None all that are there make one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Event time as an instant, which watermarks and windows require.

    Source-local times are read as UTC, so that a day of the window is a day of
    the source; the session has to agree.
    """
    if events.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
        raise ValueError("set spark.sql.session.timeZone to UTC for streams")
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark(
        "event_time", delay
    )


def suppress_copies(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Exact copies that arrive within the delay, dropped once and for all."""
    timed = _timed(events, delay)
    if not events.isStreaming:
        return timed.dropDuplicates(fv.RAW_COLUMNS)
    return timed.dropDuplicatesWithinWatermark(fv.RAW_COLUMNS)


def daily_counts(
    events: DataFrame, delay: str = "1 day", words: StateWords = StateWords()
) -> DataFrame:
    """Messages, alarms, faults and numbers per channel and day."""
    return (
        _timed(events, delay)
        .groupBy("channel_id", F.window("event_time", "1 day").alias("_day"))
        .agg(
            F.count("*").alias("events"),
            S.count_if(F.col("alarm")).alias("alarms"),
            S.count_if(F.col("state") == words.fault).alias("fault_messages"),
            F.count("num").alias("numeric_n"),
            F.min("num").alias("numeric_min"),
            F.max("num").alias("numeric_max"),
        )
        .withColumn("day", F.to_date("_day.start"))
        .drop("_day")
    )


def sessions(
    events: DataFrame, gap_minutes: int = fv.SESSION_GAP_MINUTES, delay: str = "1 day"
) -> DataFrame:
    """Runs of messages with no pause longer than the gap, split at midnight."""
    # A pause of exactly the gap does not split, a session window would: one
    # microsecond more makes both agree.
    gap = f"{gap_minutes * 60_000_000 + 1} microseconds"
    window = F.session_window("event_time", gap)
    return (
        _timed(events, delay)
        .groupBy("channel_id", F.to_date("ts").alias("day"), window.alias("_run"))
        .agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("messages")
        )
        .drop("_run")
    )


def state_instants(events: DataFrame, delay: str = "1 day", words: StateWords = StateWords()) -> DataFrame:
    """One row per channel and instant with an explicit state, once the watermark has passed it.

    ``state`` is that of all messages of the instant, else NULL: they have no
    known order.
    """
    stated = with_states(events, [words.fault, words.normal])
    instants = _timed(stated, delay).groupBy("channel_id", "event_time")
    found = instants.agg(F.max("ts").alias("ts"), F.min("state").alias("_lo"), F.max("state").alias("_hi"))
    return found.select("channel_id", "ts", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("state"))


#: Codes of the states: ambiguous, fault, normal.
_AMBIGUOUS, _FAULT, _NORMAL = range(3)


def _latest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Rows of the last batch below ``before`` of a table partitioned by batch."""
    try:
        stored = spark.read.parquet(path).where(F.col("batch") < before)
    except AnalysisException:  # no batch yet
        return None
    last = stored.agg(F.max("batch")).first()[0]  # one number, from the names of the partitions
    return None if last is None else stored.where(F.col("batch") == last).drop("batch")


def follow_episodes(instants: DataFrame, path: str, checkpoint: str, words: StateWords = StateWords()) -> DataFrame:
    """Fault runs of a stream of ``state_instants``, each given out by the change that ends it.

    The watermark lets every micro-batch give out later instants than all
    before, so what carries over is one row a channel: its last change.  A
    batch links its instants to those rows and to each other by channel and
    day, like the batch operator; no channel is held as a whole anywhere, and
    files a batch may be limited.  Both tables are partitioned by batch, so a
    batch that is run again after a failure replaces its own rows.
    """
    spark = instants.sparkSession
    carried_path, episodes_path = f"{path}/carried", f"{path}/episodes"
    word = F.when(F.col("state") == words.fault, _FAULT).when(F.col("state") == words.normal, _NORMAL)
    columns = ["channel_id", "_day", "ts", "_state", "_prev"]

    def step(rows: DataFrame, batch: int) -> None:
        batch_of = rows.sparkSession
        coded = rows.select("channel_id", F.to_date("ts").alias("_day"), "ts", F.coalesce(word, F.lit(_AMBIGUOUS)).alias("_state"))
        coded = materialize(coded, "instants")
        carried = _latest(batch_of, carried_path, batch)
        changes = ST.changes_of(coded, carried).select(*columns)
        every = changes
        if carried is not None:
            met = carried.join(coded.select("channel_id").distinct(), "channel_id", "left_semi")
            every = met.select(*columns).unionByName(changes)
        linked = ST.with_next(every).where((F.col("_state") == _FAULT) & F.col("next_change_ts").isNotNull())
        closed = linked.select(
            "channel_id",
            F.col("ts").alias("start_ts"),
            F.when(F.col("_next") == _NORMAL, F.col("next_change_ts")).alias("end_ts"),
            F.coalesce(F.col("_prev") == _NORMAL, F.lit(False)).alias("observed_start"),
            (F.col("_next") == _AMBIGUOUS).alias("ambiguous_end"),
            F.lit(batch).cast("long").alias("batch"),
        )
        overwrite_partitions(closed, episodes_path, ["batch"])
        whole = changes if carried is None else carried.select(*columns).unionByName(changes)
        last = whole.groupBy("channel_id").agg(F.max_by(F.struct(*columns[1:]), "ts").alias("_last"))
        kept = last.select("channel_id", "_last.*", F.lit(batch).cast("long").alias("batch"))
        overwrite_partitions(kept, carried_path, ["batch"])

    run = instants.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step)
    run.trigger(availableNow=True).start().awaitTermination()
    schema = "channel_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, observed_start boolean, ambiguous_end boolean, batch long"
    return spark.read.schema(schema).parquet(episodes_path).drop("batch")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All files there are now, appended to a Parquet table; a later call goes on where this one stopped."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    run = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
