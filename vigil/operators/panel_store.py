"""Feature panel kept up to date day by day from a carried state.

A store is a folder of tables:

``daily``     channel and day: measures, last state and confirmed starts, a partition a day
``coverage``  observed hours of each day, a partition a day
``rolled``    rolling measures of each prediction date, a partition a date
``carried``   channel: first and last message, state and its time, a partition (``upto``) a batch

A batch of new days is aggregated, its state changes are linked to the carried
state, and only the prediction dates it opens are computed, from the daily rows
of the lookback before them.  Neither events nor daily rows of older days are
read.  Labels and completeness depend on days that come later; ``panel`` joins
them when it is read, for the dates that are asked for.

A batch that is appended again replaces itself.  Days before the end of the
store cannot be appended alone: they would change what later days carry.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import calendar as C
from vigil.operators import panel as P
from vigil.operators import states as ST
from vigil.sources.tables import overwrite_partitions


@dataclass(frozen=True)
class PanelStore:
    """Place and settings of a store; the settings must not change between batches."""

    root: str
    words: C.StateWords = field(default_factory=C.StateWords)
    windows: Sequence[int] = fv.PANEL_WINDOWS
    active_windows: Sequence[int] = fv.ACTIVE_WINDOWS
    lookback: int = fv.LOOKBACK_DAYS
    min_history_days: int = fv.MIN_HISTORY_DAYS

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _stored(spark: SparkSession, store: PanelStore, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store.path(name))
    except AnalysisException:
        return None


def stored_until(spark: SparkSession, store: PanelStore) -> list[dt.date]:
    """Last days of the batches of the store, from the names of its partitions."""
    carried = _stored(spark, store, "carried")
    if carried is None:
        return []
    return sorted(r["upto"] for r in carried.select("upto").distinct().collect())  # one row a batch


def linked_changes(events: DataFrame, carried: DataFrame | None, words: C.StateWords) -> DataFrame:
    """State changes of new days, the first of a channel linked to its carried state."""
    changes = ST.timeline(events, [words.fault, words.normal])
    if carried is None:
        return changes
    before = carried.select("channel_id", F.col("state").alias("_state"))
    linked = changes.join(before, "channel_id", "left")
    linked = linked.withColumn("prev_state", F.coalesce("prev_state", "_state")).drop("_state")
    return linked.where(F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state")))


def carry_on(carried: DataFrame | None, daily: DataFrame, changes: DataFrame) -> DataFrame:
    """State of every channel after the new days; one row a channel, merged by an aggregation."""
    seen = daily.select(
        "channel_id", F.col("first_ts").alias("first_seen"), F.col("last_ts").alias("last_seen"),
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("timestamp_ntz").alias("state_at"),
    )
    none = F.lit(None).cast("timestamp_ntz")
    changed = changes.select(
        "channel_id", none.alias("first_seen"), none.alias("last_seen"), "state", F.col("ts").alias("state_at")
    )
    rows = seen.unionByName(changed)
    if carried is not None:
        rows = rows.unionByName(carried.select(*rows.columns))
    return rows.groupBy("channel_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("state", "state_at").alias("state"),
        F.max("state_at").alias("state_at"),
    )


def rolled_dates(
    store: PanelStore, days: DataFrame, carried: DataFrame | None, first: dt.date, last: dt.date
) -> DataFrame:
    """Rolling measures of the prediction dates from ``first`` to ``last``.

    ``days`` are the daily rows of the lookback before the first date and of
    all later days; a state older than those comes from ``carried``.
    """
    grid = P._grid(days.drop("hour_mask"), store.lookback)
    rolled = P.rolling_features(grid, store.windows, store.active_windows, store.lookback)
    wanted = F.col("_t").between((first - dt.date(1970, 1, 1)).days, (last - dt.date(1970, 1, 1)).days)
    rolled = rolled.where(wanted & (F.col(f"active_days_{store.lookback}d") > 0))
    # known only when the panel is read
    rolled = rolled.drop("first_seen", "last_seen", "_starts_0", "_starts_1")
    if carried is None:
        return rolled
    older = carried.select("channel_id", F.col("state").alias("_state"), F.col("state_at").alias("_at"))
    older = rolled.join(older, "channel_id", "left")
    return older.withColumns(
        {
            "last_explicit_state": F.coalesce("last_explicit_state", "_state"),
            "last_state_ts": F.coalesce("last_state_ts", "_at"),
        }
    ).drop("_state", "_at")


def append_days(
    store: PanelStore, events: DataFrame, coverage: DataFrame | None = None, stated: DataFrame | None = None
) -> tuple[dt.date, dt.date] | None:
    """Add the days of ``events`` (a typed journal) to the store; the first and last prediction date computed.

    ``coverage`` has the observed hours of the new days and ``stated`` the
    messages of their states (default: both from these events).  None for a
    batch without events.
    """
    spark = events.sparkSession
    daily = C.daily_aggregate(events, store.words)
    ends = daily.agg(F.min("day"), F.max("day")).first()  # one row
    if ends[0] is None:
        return None
    first, last = ends
    until = stored_until(spark, store)
    if until and until[-1] > last:
        raise ValueError(f"the store reaches {until[-1]}; append all days from {first} on")
    before = [d for d in until if d < first]
    carried = _stored(spark, store, "carried").where(F.col("upto") == before[-1]).drop("upto") if before else None
    changes = linked_changes(events if stated is None else stated, carried, store.words)
    states = ST.day_states(changes, store.words.fault, store.words.normal)
    overwrite_partitions(daily.join(states, ["channel_id", "day"], "left"), store.path("daily"), ["day"])
    covered = coverage if coverage is not None else C.coverage_of_daily(daily)
    overwrite_partitions(covered, store.path("coverage"), ["day"])
    # a date is opened by the day before it; silent days after the last batch open dates too
    opened = before[-1] + dt.timedelta(days=2) if before else first
    since = opened - dt.timedelta(days=store.lookback)
    days = spark.read.parquet(store.path("daily")).where(F.col("day").between(since, last))
    reach = last + dt.timedelta(days=1)
    dates = rolled_dates(store, days, carried, opened, reach).withColumn("_date", F.date_from_unix_date("_t"))
    overwrite_partitions(dates, store.path("rolled"), ["_date"])
    new = carry_on(carried, daily, changes).withColumn("upto", F.lit(last))
    overwrite_partitions(new, store.path("carried"), ["upto"])
    return opened, reach


def panel(spark: SparkSession, store: PanelStore, meta: DataFrame, since: dt.date | None = None) -> DataFrame:
    """The panel of the stored dates (from ``since`` on), equal to one built from all events at once."""
    last = stored_until(spark, store)[-1]
    rolled = spark.read.parquet(store.path("rolled"))
    daily = spark.read.parquet(store.path("daily")).select("channel_id", "day", "starts")
    if since is not None:
        rolled = rolled.where(F.col("_date") >= since)
        daily = daily.where(F.col("day") >= since)
    bounds = spark.read.parquet(store.path("carried")).where(F.col("upto") == last)
    starts = daily.where("starts > 0").select("channel_id", F.unix_date("day").alias("_day"), "starts")
    on = starts.select("channel_id", F.explode(F.array(F.struct(F.col("_day").alias("_t"), F.lit(0).alias("ahead")),
                       F.struct((F.col("_day") - 1).alias("_t"), F.lit(1).alias("ahead")))).alias("_x"), "starts")
    ahead = on.groupBy("channel_id", F.col("_x._t").alias("_t")).agg(
        *[F.coalesce(F.sum(F.when(F.col("_x.ahead") == i, F.col("starts"))), F.lit(0)).alias(f"_starts_{i}") for i in (0, 1)]
    )
    whole = (
        rolled.drop("_date")
        .join(ahead, ["channel_id", "_t"], "left")
        .fillna(0, ["_starts_0", "_starts_1"])
        .join(bounds.select("channel_id", "first_seen", "last_seen"), "channel_id")
    )
    coverage = C.dense_coverage(spark.read.parquet(store.path("coverage")).select("day", "events", "observed_hours", "channels"))
    return P.finish(
        whole, coverage, meta, store.words, store.windows, store.active_windows, store.lookback, store.min_history_days
    )
