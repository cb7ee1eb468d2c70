"""Features of past episodes and ratios built on the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S


def _day_marks(fault_runs: DataFrame) -> DataFrame:
    """Starts and recoveries per channel and day; confirmed episodes only."""
    confirmed = fault_runs.where("observed_start")
    starts = confirmed.groupBy("channel_id", F.to_date("start_ts").alias("day")).agg(
        F.count("*").alias("starts"), F.max("start_ts").alias("last_start")
    )
    hours = F.col("duration_hours")
    closes = (
        confirmed.where(F.col("end_ts").isNotNull() & (hours >= 0))
        .groupBy("channel_id", F.to_date("end_ts").alias("day"))
        .agg(
            F.count("*").alias("closes"),
            S.count_if(hours <= fv.SHORT_EPISODE_HOURS).alias("short_closes"),
            F.sum(F.log1p(hours)).alias("log_hours"),
            F.max("end_ts").alias("last_close"),
        )
    )
    return starts.unionByName(closes, allowMissingColumns=True)


def episode_formulas(
    windows: Sequence[int] = fv.EPISODE_WINDOWS,
    lags: Sequence[int] = fv.EPISODE_LAGS,
    close_windows: Sequence[int] = fv.CLOSE_WINDOWS,
) -> dict[str, str]:
    """Window SQL of every episode feature by its name, in contract order.

    The rows of the window are marks and prediction rows of a channel; ``_t`` is
    the day and ``_at`` the prediction time.  Counts are differences of two
    running sums, which is exact for integers; logarithms are summed in a
    sliding frame, as differences of running doubles are not.
    """
    line = "OVER (PARTITION BY channel_id ORDER BY _t RANGE BETWEEN"

    def upto(value: str, days: int) -> str:
        return f"coalesce(sum({value}) {line} UNBOUNDED PRECEDING AND {days} PRECEDING), 0)"

    def within(value: str, days: int) -> str:
        return f"{upto(value, 1)} - {upto(value, days + 1)}"

    def since(stamp: str) -> str:
        newest = f"max({stamp}) {line} UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"timestampdiff(MICROSECOND, {newest}, _at) / 3.6e9"

    def on_day(days: int) -> str:
        return f"int(coalesce(sum(starts) {line} {days} PRECEDING AND {days} PRECEDING), 0) > 0)"

    def mean_log(days: int) -> str:
        return f"sum(log_hours) {line} {days} PRECEDING AND 1 PRECEDING) / nullif({within('closes', days)}, 0)"

    found = {"hours_since_fault_start": since("last_start"), "hours_since_fault_end": since("last_close")}
    found |= {f"fault_starts_{d}d": within("starts", d) for d in windows}
    found |= {f"fault_start_days_{d}d": within("int(starts > 0)", d) for d in windows}
    found |= {f"fault_day_lag_{d}": on_day(d) for d in lags}
    for d in close_windows:
        found[f"fault_closes_{d}d"] = within("closes", d)
        found[f"short_fault_closes_{d}d"] = within("short_closes", d)
        found[f"past_log_duration_mean_{d}d"] = mean_log(d)
    return found


def episode_features(
    rows: DataFrame,
    fault_runs: DataFrame,
    windows: Sequence[int] = fv.EPISODE_WINDOWS,
    lags: Sequence[int] = fv.EPISODE_LAGS,
    close_windows: Sequence[int] = fv.CLOSE_WINDOWS,
) -> DataFrame:
    """Prediction rows with counts, recency and weekly lags of past episodes.

    Starts and recoveries are reduced to one row per channel and day, unioned
    with the prediction rows and ordered by day: one shuffle serves all
    features, and the cost of a count does not depend on the width of its window.
    """
    formulas = episode_formulas(windows, lags, close_windows)
    past = "OVER (PARTITION BY channel_id ORDER BY _t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    newest = f"greatest(max(last_start) {past}, max(last_close) {past})"
    asked = rows.select(
        "channel_id",
        F.to_date("prediction_time").alias("day"),
        F.col("prediction_time").alias("_at"),
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"),
    )
    line = asked.unionByName(_day_marks(fault_runs), allowMissingColumns=True).withColumn("_t", F.unix_date("day"))
    found = line.selectExpr(
        "_row", *[f"{sql} AS {name}" for name, sql in formulas.items()], f"{newest} AS episode_feature_max_ts"
    )
    return found.where(F.col("_row").isNotNull()).select("_row.*", *formulas, "episode_feature_max_ts")


def ratio_features(df: DataFrame) -> DataFrame:
    """Shares, ranges and rates by their formulas; a zero denominator gives NULL."""
    return df.withColumns({name: F.expr(sql) for name, sql in fv.RATIO_FORMULAS.items()})


def model_matrix(df: DataFrame, numeric: list[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Model columns: finite 32-bit numbers and texts with a word for missing."""
    numbers = {c: S.finite_or_null(F.col(c).cast("double")).cast("float") for c in numeric}
    texts = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(fv.MISSING)) for c in categorical
    }
    return df.withColumns({**numbers, **texts})
