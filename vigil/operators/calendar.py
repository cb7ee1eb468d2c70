"""Daily aggregates, coverage of the calendar and gaps in it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S


@dataclass(frozen=True)
class StateWords:
    """Which state text means what; the defaults are the words of the journal."""

    fault: str = fv.FAULT
    normal: str = fv.NORMAL
    power_off: str = fv.POWER_OFF
    undefined: tuple[str, ...] = tuple(fv.UNDEFINED)
    disabled: str = fv.DISABLED
    smoke: str = fv.SMOKE
    gas: str = fv.GAS
    flood: str = fv.FLOOD


def daily_aggregate(events: DataFrame, words: StateWords = StateWords()) -> DataFrame:
    """One row per channel and day.

    A single aggregation: partial sums are formed before the shuffle, so a hot
    channel costs one row per task and day.  ``hour_mask`` has a bit per
    observed hour, which makes the daily coverage a cheap second step that
    needs no distinct count and no second scan of the events.
    """
    state = F.col("state")
    num = F.col("num")
    return events.groupBy("channel_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"),
        S.count_if(F.col("alarm")).alias("alarms"),
        S.count_if(F.col("alarm").isNull()).alias("unknown_alarm"),
        F.count("num").alias("numeric_n"),
        F.sum("num").alias("numeric_sum"),
        F.sum(num * num).alias("numeric_sumsq"),
        F.min("num").alias("numeric_min"),
        F.max("num").alias("numeric_max"),
        F.count("state").alias("text_n"),
        S.count_if(state == words.fault).alias("fault_messages"),
        S.count_if(state == words.power_off).alias("power_messages"),
        S.count_if(state.isin(*words.undefined)).alias("undefined_messages"),
        S.count_if(state == words.disabled).alias("disabled_messages"),
        S.count_if(state == words.smoke).alias("smoke_messages"),
        S.count_if(state == words.gas).alias("gas_messages"),
        S.count_if(state == words.flood).alias("flood_messages"),
        S.count_if(F.hour("ts") < fv.NIGHT_ENDS_AT_HOUR).alias("night_events"),
        S.count_if(F.col("nonfinite")).alias("nonfinite_n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.bit_or(F.expr("shiftleft(1, hour(ts))")).alias("hour_mask"),
    )


def channel_bounds(daily: DataFrame) -> DataFrame:
    return daily.groupBy("channel_id").agg(
        F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen")
    )


def coverage_of_daily(daily: DataFrame) -> DataFrame:
    """Events, observed hours and channels per day, from the daily table."""
    return daily.groupBy("day").agg(
        F.sum("events").alias("events"),
        F.bit_count(F.bit_or("hour_mask")).cast("long").alias("observed_hours"),
        F.count("channel_id").alias("channels"),
    )


def day_coverage(events: DataFrame) -> DataFrame:
    """Coverage straight from events, reduced to (channel, day) first."""
    per_channel = events.groupBy("channel_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), F.bit_or(F.expr("shiftleft(1, hour(ts))")).alias("hour_mask")
    )
    return coverage_of_daily(per_channel)


def _by_date(day: str = "day") -> WindowSpec:
    """Order of the calendar.

    A calendar has one row per date, so this unpartitioned window sorts a few
    thousand rows (3.65 million is the most four-digit years can give).
    """
    return Window.orderBy(day)


def fill_dates(days: DataFrame, day: str = "day") -> DataFrame:
    """One row per date from the first to the last; ``_given`` tells the input rows.

    Each row opens the dates up to the next one, so the input is read once.
    """
    until = F.coalesce(F.date_sub(F.lead(day).over(_by_date(day)), 1), F.col(day))
    spans = days.withColumn("_until", until)
    opened = spans.withColumn("_date", F.explode(F.sequence(F.col(day), F.col("_until"))))
    given = opened.withColumn("_given", F.col("_date") == F.col(day))
    return given.withColumn(day, F.col("_date")).drop("_date", "_until")


def dense_coverage(coverage: DataFrame) -> DataFrame:
    """Coverage with a row for every date; a day without messages has zeros."""
    measures = ("events", "observed_hours", "channels")
    filled = fill_dates(coverage)
    return filled.select(
        "day", *[F.when(F.col("_given"), F.col(m)).otherwise(F.lit(0)).alias(m) for m in measures]
    )


def incomplete_days(dense: DataFrame) -> DataFrame:
    return dense.where(F.col("observed_hours") < fv.HOURS_PER_DAY)


def missing_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Dates of the calendar on which nothing was observed."""
    return fill_dates(days.select(day), day).where(~F.col("_given")).select(day)


def coverage_features(dense: DataFrame, windows: Iterable[int]) -> DataFrame:
    """Completeness around each date, with one date more than the coverage has."""
    order = _by_date()
    ends = F.lead("day").over(order).isNull()
    tomorrow = F.date_add("day", 1)
    dates = F.when(ends, F.array("day", tomorrow)).otherwise(F.array("day"))
    opened = dense.withColumn("_dates", dates).select(
        F.explode("_dates").alias("_date"),
        ((F.col("_date") == F.col("day")) & (F.col("observed_hours") == fv.HOURS_PER_DAY)).alias(
            "complete"
        ),
    )
    by_date = _by_date("_date")
    full = F.col("complete").cast("long")
    before = {
        f"complete_before_{w}d": F.coalesce(
            F.sum(full).over(by_date.rowsBetween(-w, -1)), F.lit(0)
        )
        for w in sorted(set(windows))
    }
    after = F.coalesce(F.lead("complete").over(by_date), F.lit(False))
    return opened.withColumns({**before, "complete_next": after}).withColumnRenamed("_date", "day")


def incomplete_ahead(dense: DataFrame, lead: int, horizon: int) -> DataFrame:
    """Incomplete days in [day + lead, day + horizon) for each date."""
    bad = (F.col("observed_hours") != fv.HOURS_PER_DAY).cast("long")
    ahead = _by_date().rowsBetween(lead, horizon - 1)
    return dense.select("day", F.coalesce(F.sum(bad).over(ahead), F.lit(0)).alias("bad_ahead"))


def observation_history(observations: DataFrame, days: int = 366, day: str = "date") -> DataFrame:
    """Last ``days`` dates; a date without a row keeps NULL, never a zero."""
    measures = [c for c in observations.columns if c != day]
    last = F.max(day).over(_by_date(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = fill_dates(observations.withColumn("_last", last), day)
    return filled.where(F.col(day) > F.date_sub("_last", days)).select(
        day, *[F.when(F.col("_given"), F.col(m)).alias(m) for m in measures]
    )
