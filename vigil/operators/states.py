"""State time lines, fault episodes and gap sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators.ordered import neighbour, running_totals


def with_states(events: DataFrame, states: list[str]) -> DataFrame:
    return events.where(F.col("state").isin(*states))


def timeline(events: DataFrame, states: Sequence[str] = (fv.FAULT, fv.NORMAL)) -> DataFrame:
    """Changes of the explicit state per channel.

    Messages of one instant collapse to one state; different states at one
    instant have no known order and become ``ambiguous``.  The collapse is an
    aggregation with partial sums, over small numbers instead of texts so that
    it stays a hash aggregation.  Both neighbour look-ups work per channel and
    day, so a flapping channel never has to fit into one task.
    """
    words = F.lit([fv.AMBIGUOUS, *states])
    number = (F.array_position(words, F.col("state")) - 1).cast("int")
    instants = (
        with_states(events, list(states))
        .groupBy("channel_id", F.to_date("ts").alias("_day"), "ts")
        .agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
        .select(
            "channel_id",
            "_day",
            "ts",
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.lit(0)).alias("_state"),
        )
        # The window and the edge rows both read this exchange.
        .repartition("channel_id", "_day")
    )
    linked = with_next(changes_of(instants))

    def word(code: str) -> Column:
        return F.get(words, F.col(code))

    return linked.select(
        "channel_id",
        "ts",
        word("_state").alias("state"),
        word("_prev").alias("prev_state"),
        "next_change_ts",
        word("_next").alias("next_state"),
    )


def changes_of(instants: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Instants (``channel_id``, ``_day``, ``ts``, ``_state``) whose state is not that before, with it as ``_prev``.

    ``carried`` has the state (``_state``) of each channel before its first instant.
    """
    seen = neighbour(instants, ["channel_id"], "_day", "ts", {"_prev": "_state"})
    if carried is not None:
        before = carried.select("channel_id", F.col("_state").alias("_before"))
        seen = seen.join(before, "channel_id", "left").withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before")
    return seen.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("_state")))


def with_next(changes: DataFrame) -> DataFrame:
    """Changes with time and state of the next change of their channel."""
    return neighbour(
        changes, ["channel_id"], "_day", "ts", {"next_change_ts": "ts", "_next": "_state"}, following=True
    )


def day_states(changes: DataFrame, fault: str = fv.FAULT, normal: str = fv.NORMAL) -> DataFrame:
    """Last state and number of confirmed fault starts per channel and day."""
    confirmed = (F.col("state") == fault) & (F.col("prev_state") == normal)
    return changes.groupBy("channel_id", F.to_date("ts").alias("day")).agg(
        F.max_by("state", "ts").alias("last_state"),
        F.max("ts").alias("last_state_at"),
        S.count_if(confirmed).alias("starts"),
    )


def episodes(changes: DataFrame, fault: str = fv.FAULT, normal: str = fv.NORMAL) -> DataFrame:
    """Fault runs with censoring; a duration only where a recovery was seen."""
    began = F.col("prev_state") == normal
    ended = F.col("next_state") == normal
    end = F.when(ended, F.col("next_change_ts"))
    return changes.where(F.col("state") == fault).select(
        "channel_id",
        F.col("ts").alias("start_ts"),
        end.alias("end_ts"),
        F.coalesce(began, F.lit(False)).alias("observed_start"),
        F.coalesce(~began, F.lit(True)).alias("left_censored"),
        F.coalesce(~ended, F.lit(True)).alias("right_censored"),
        (F.col("next_state") == fv.AMBIGUOUS).alias("ambiguous_end"),
        S.hours_between(end, F.col("ts")).alias("duration_hours"),
    )


def starts_per_day(runs: DataFrame, only_observed: bool = True) -> DataFrame:
    """Episode starts per channel and day."""
    chosen = runs.where("observed_start") if only_observed else runs
    return chosen.groupBy("channel_id", F.to_date("start_ts").alias("day")).agg(
        F.count("*").alias("starts")
    )


def gap_sessions(
    events: DataFrame,
    key: str = "channel_id",
    ts: str = "ts",
    gap_minutes: int = fv.SESSION_GAP_MINUTES,
    break_on_date: bool = True,
) -> DataFrame:
    """Runs of messages with no pause longer than the gap, numbered per key.

    Equal instants are counted together first.  The pause before an instant and
    the running session number are found day by day with a carry from the days
    before, so the work of one key spreads over its days.
    """
    # inside a struct a NULL key joins like any other
    instants = events.groupBy(F.struct(F.col(key).alias("k")).alias("_key"), F.col(ts).alias("_ts")).agg(
        F.count("*").alias("_n")
    )
    instants = instants.withColumn("_day", F.to_date("_ts"))
    if break_on_date:
        inside = Window.partitionBy("_key", "_day").orderBy("_ts")
        seen = instants.withColumn("_last", F.lag("_ts").over(inside))
    else:
        seen = neighbour(instants, ["_key"], "_day", "_ts", {"_last": "_ts"})
    pause = F.timestamp_diff("MICROSECOND", F.col("_last"), F.col("_ts"))
    opens = F.when(
        F.col("_last").isNull() | (pause > F.lit(gap_minutes * 60_000_000)), F.lit(1)
    ).otherwise(F.lit(0))
    marked = seen.withColumn("_opens", opens.cast("long"))
    numbered = running_totals(
        marked, ["_key"], "_day", "_ts", {"episode_id": F.col("_opens")}
    )
    minutes = F.timestamp_diff("MICROSECOND", F.min("_ts"), F.max("_ts")) / F.lit(6e7)
    return numbered.groupBy(F.col("_key.k").alias(key), "episode_id").agg(
        F.min("_ts").alias("start_ts"),
        F.max("_ts").alias("end_ts"),
        F.sum("_n").alias("messages"),
        minutes.alias("duration_minutes"),
    )
