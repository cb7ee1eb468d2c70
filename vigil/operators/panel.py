"""Channel x midnight feature panel with censored forward labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import calendar as C
from vigil.operators import states as ST
from vigil.operators.asof import asof_join
from vigil.operators.contracts import panel_feature_names
from vigil.operators.ordered import FIRST, LAST

METADATA = [
    "channel_id",
    "prediction_time",
    "target_start",
    "target_end",
    "sensor_type_current",
    "object_id_current",
    "system_type_current",
]
LABELS = ["target_fault_24_48h", "target_fault_0_24h"]
DIAGNOSTICS = [
    "feature_max_ts",
    "last_explicit_state",
    "last_state_ts",
    "at_risk_with_history",
    "channel_followup_48h",
    "global_complete_0_24h",
    "global_complete_24_48h",
    "first_seen",
    "last_seen",
]


def _grid(days: DataFrame, lookback: int) -> DataFrame:
    """Dates a channel is predicted for, each daily row on its own first date.

    A daily row opens the dates up to the next active day, at most ``lookback``
    of them.  That yields exactly the dates with activity in the days before,
    with no cross join of channels and calendar and no row for a silent channel.
    """
    timeline = Window.partitionBy("channel_id").orderBy("_day")
    whole = timeline.rangeBetween(FIRST, LAST)
    measures = [c for c in days.columns if c not in ("channel_id", "day")]
    spread = days.withColumn("_day", F.unix_date("day")).withColumns(
        {
            "first_seen": F.min("first_ts").over(whole),
            "last_seen": F.max("last_ts").over(whole),
            "_next": F.lead("_day").over(timeline),
        }
    )
    reach = F.least(F.lit(lookback), F.col("_next") - F.col("_day") - 1)
    opened = spread.withColumn("_step", F.explode(F.sequence(F.lit(0), reach)))
    return opened.select(
        "channel_id",
        (F.col("_day") + F.col("_step")).alias("_t"),
        "first_seen",
        "last_seen",
        *[F.when(F.col("_step") == 0, F.col(m)).alias(m) for m in measures],
    )


def rolling_features(
    grid: DataFrame, windows: Sequence[int], active_windows: Sequence[int], lookback: int
) -> DataFrame:
    """Rolling measures over the days before each date, in one window pass.

    Whole-number measures are differences of two running sums, which costs one
    step per row instead of one per day of the window and is exact.  Sums of
    doubles and extremes use sliding frames so that they do not cancel.
    """
    line = "PARTITION BY channel_id ORDER BY _t RANGE BETWEEN"

    def upto(value: str, days: int) -> str:
        return f"coalesce(sum({value}) OVER ({line} UNBOUNDED PRECEDING AND {days} PRECEDING), 0)"

    def running(value: str, width: int) -> str:
        return f"{upto(value, 1)} - {upto(value, width + 1)}"

    cells = ["*"]
    for width in windows:
        sliding = f"OVER ({line} {width} PRECEDING AND 1 PRECEDING)"
        for measure in [*fv.COUNT_MEASURES, "numeric_n"]:
            cells.append(f"{running(measure, width)} AS {measure}_{width}d")
        cells += [
            f"sum(numeric_sum) {sliding} AS _sum_{width}",
            f"sum(numeric_sumsq) {sliding} AS _sumsq_{width}",
            f"min(numeric_min) {sliding} AS numeric_min_{width}d",
            f"max(numeric_max) {sliding} AS numeric_max_{width}d",
        ]
    for width in sorted({*active_windows, lookback}):
        cells.append(f"int({running('int(events > 0)', width)}) AS active_days_{width}d")
    past = f"OVER ({line} UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cells += [
        f"max(last_ts) {past} AS feature_max_ts",
        f"last(last_state, true) {past} AS last_explicit_state",
        f"last(last_state_at, true) {past} AS last_state_ts",
        f"coalesce(sum(starts) OVER ({line} CURRENT ROW AND CURRENT ROW), 0) AS _starts_0",
        f"coalesce(sum(starts) OVER ({line} 1 FOLLOWING AND 1 FOLLOWING), 0) AS _starts_1",
    ]
    derived = ["*"]
    for width in windows:
        count = f"nullif(numeric_n_{width}d, 0)"
        mean = f"_sum_{width} / {count}"
        derived += [
            f"{mean} AS numeric_mean_{width}d",
            f"CASE WHEN numeric_n_{width}d > 0 THEN sqrt(greatest(0D,"
            f" _sumsq_{width} / {count} - power({mean}, 2))) END AS numeric_std_{width}d",
        ]
    return grid.selectExpr(*cells).selectExpr(*derived)


def build(
    daily: DataFrame,
    coverage: DataFrame,
    transitions: DataFrame,
    meta: DataFrame,
    words: C.StateWords = C.StateWords(),
    windows: Sequence[int] = fv.PANEL_WINDOWS,
    active_windows: Sequence[int] = fv.ACTIVE_WINDOWS,
    lookback: int = fv.LOOKBACK_DAYS,
    min_history_days: int = fv.MIN_HISTORY_DAYS,
) -> DataFrame:
    """Panel of features known at midnight and labels of the two days after it.

    State changes and episode starts are reduced to channel and day and joined
    to the daily table on the keys it is already partitioned by; then a single
    shuffle on the channel serves the grid and all rolling features.  A channel
    has one row per day there, so no key is large.
    """
    states = ST.day_states(transitions, words.fault, words.normal)
    days = daily.drop("hour_mask").join(states, ["channel_id", "day"], "left")
    rolled = rolling_features(_grid(days, lookback), windows, active_windows, lookback)
    return finish(rolled, coverage, meta, words, windows, active_windows, lookback, min_history_days)


def finish(
    rolled: DataFrame,
    coverage: DataFrame,
    meta: DataFrame,
    words: C.StateWords = C.StateWords(),
    windows: Sequence[int] = fv.PANEL_WINDOWS,
    active_windows: Sequence[int] = fv.ACTIVE_WINDOWS,
    lookback: int = fv.LOOKBACK_DAYS,
    min_history_days: int = fv.MIN_HISTORY_DAYS,
) -> DataFrame:
    """Panel from rolling measures: coverage, attributes, ratios and labels, row by row."""
    short, week, month = windows[0], windows[-2], windows[-1]
    # One row per calendar date, so the size is bounded by the dates there are.
    dates = C.coverage_features(coverage, [short, week, lookback]).withColumn(
        "_t", F.unix_date("day")
    )
    rows = (
        rolled.where(F.col(f"active_days_{lookback}d") > 0)
        .join(F.broadcast(dates), "_t")
        .withColumn("prediction_time", F.col("day").cast("timestamp_ntz"))
        .join(meta, "channel_id", "left")
    )
    t = F.col("prediction_time")
    day1, day2 = t + F.expr("interval 24 hours"), t + F.expr("interval 48 hours")
    dow = F.extract(F.lit("dayofweek_iso"), t).cast("int")
    angle = F.lit(2 * math.pi) * dow / 7
    week_mean = F.col(f"events_{week}d") / F.lit(float(week))
    month_mean = F.col(f"events_{month}d") / F.lit(float(month))
    old_enough = S.days_between(t, F.col("first_seen")) >= min_history_days
    followed = F.col("last_seen") >= day2

    def label(starts: str, complete: str, observed: Column) -> Column:
        return (
            F.when(F.col(starts) > 0, F.lit(1)).when(F.col(complete) & observed, F.lit(0))
        ).cast("tinyint")

    full = rows.withColumns(
        {
            "target_start": day1,
            "target_end": day2,
            "global_complete_0_24h": F.col("complete"),
            "global_complete_24_48h": F.col("complete_next"),
            "channel_followup_48h": followed,
            "target_fault_0_24h": label("_starts_0", "complete", F.col("last_seen") >= day1),
            "target_fault_24_48h": label("_starts_1", "complete_next", followed),
            "hours_since_last_event": S.hours_between(t, F.col("feature_max_ts")),
            "history_days": S.days_between(t, F.col("first_seen")),
            f"alarm_rate_{week}d": S.ratio(F.col(f"alarms_{week}d"), F.col(f"events_{week}d")),
            f"event_ratio_{short}d_{week}d": S.ratio(
                F.col(f"events_{short}d") / F.lit(float(short)), week_mean
            ),
            f"event_ratio_{week}d_{month}d": S.ratio(week_mean, month_mean),
            "dow": dow,
            "month": F.month(t),
            "dow_sin": F.sin(angle),
            "dow_cos": F.cos(angle),
            "history_complete_days": F.col(f"complete_before_{lookback}d"),
            f"global_complete_days_{short}d": F.col(f"complete_before_{short}d"),
            f"global_complete_days_{week}d": F.col(f"complete_before_{week}d"),
            "at_risk_with_history": F.coalesce(
                (F.col("last_explicit_state") == words.normal)
                & old_enough
                & (F.col(f"complete_before_{short}d") == short),
                F.lit(False),
            ),
        }
    )
    features = panel_feature_names(windows, active_windows)
    return full.select(*METADATA, *features, *LABELS, *DIAGNOSTICS)


def add_forward_label(panel: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """Label of a start on the day after the prediction date.

    One where a start was seen, zero where both the flow and the channel were
    observed to the end, else NULL.  ``starts`` has one row per channel and day.
    """
    target_day = F.date_add(F.to_date("prediction_time"), 1)
    ahead = starts.select("channel_id", F.col("day").alias("_day"), F.col("starts").alias("_n"))
    joined = panel.withColumn("_day", target_day).join(ahead, ["channel_id", "_day"], "left")
    observed = F.col("global_complete_24_48h") & F.col("channel_followup_48h")
    value = F.when(F.col("_n") > 0, F.lit(1)).when(observed, F.lit(0)).cast("tinyint")
    return joined.withColumn(name, value).drop("_day", "_n")


def monthly_label(
    rows: DataFrame,
    fault_runs: DataFrame,
    coverage: DataFrame,
    lead: int = fv.MONTHLY_LEAD_DAYS,
    horizon: int = fv.MONTHLY_HORIZON_DAYS,
) -> DataFrame:
    """Start of a new episode in [t + lead, t + horizon) for observed rows only.

    The first start after the lead comes from a forward as-of join.  A row is
    kept when the channel was seen past the horizon and no day of the window
    was incomplete.
    """
    t = F.col("prediction_time")
    far = t + F.expr(f"interval {horizon} days")
    starts = fault_runs.where("observed_start").select("channel_id", "start_ts")
    leads = rows.withColumn("_from", t + F.expr(f"interval {lead} days"))
    nearest = asof_join(
        leads, starts, ["channel_id"], "_from", "start_ts", ["start_ts"], "forward", strict=False
    )
    # One row per calendar date.
    gaps = F.broadcast(C.incomplete_ahead(coverage, lead, horizon))
    kept = (
        nearest.where(F.col("last_seen") >= far)
        .withColumn("day", F.to_date("prediction_time"))
        .join(gaps, "day")
        .where(F.col("bad_ahead") == 0)
    )
    hit = F.coalesce(F.col("start_ts") < far, F.lit(False)).cast("int")
    return (
        kept.withColumn("target_monthly", hit)
        .withColumnRenamed("start_ts", "next_start_after_24h")
        .drop("day", "bad_ahead", "_from")
    )
