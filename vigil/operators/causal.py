"""Causal target encoding: the past label rate of a channel at each date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.ranges import running

_MINE, _ROW = 0, 1


def causal_rate(
    rows: DataFrame,
    history: DataFrame,
    label: str,
    key: str = "channel_id",
    alpha: float = 100.0,
    prefix: str = "channel_history",
) -> DataFrame:
    """Rows with the positives a channel had before and its smoothed rate.

    Only labels whose window ended by the prediction time count
    (``target_end <= prediction_time``).  The rate is pulled towards the global
    rate known at that time with strength ``alpha``.  The history is reduced to
    one row per channel and end time first.  Both lines, that of a channel and
    the global one, are cut into ranges of time, so neither a busy channel nor
    times that are not midnights end up in one task.
    """
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    per_end = history.groupBy(key, F.col("target_end").alias("_at")).agg(
        F.sum(F.col(label).cast("double")).alias("_pos"), F.count("*").cast("double").alias("_n")
    )
    names = rows.columns
    packed = F.struct(*[F.col(f"`{c}`") for c in names])
    asked = rows.select(
        key, F.col("prediction_time").alias("_at"), F.lit(_ROW).alias("_side"), packed.alias("_row")
    )
    order = [F.asc("_at"), F.asc("_side")]
    line = per_end.withColumn("_side", F.lit(_MINE)).unionByName(asked, allowMissingColumns=True)
    sums = {"_cum_pos": F.col("_pos"), "_cum_n": F.col("_n")}
    known = running(line, [key], order, sums).where(F.col("_side") == _ROW)
    total = per_end.groupBy("_at").agg(F.sum("_pos").alias("_pos"), F.sum("_n").alias("_n"))
    times = rows.select(F.col("prediction_time").alias("_at")).distinct()
    calendar = total.withColumn("_side", F.lit(_MINE)).unionByName(
        times.withColumn("_side", F.lit(_ROW)), allowMissingColumns=True
    )
    rate = F.col("_cum_pos") / F.nullif(F.col("_cum_n"), F.lit(0.0))
    prior = (
        running(calendar, [], order, sums)
        .where(F.col("_side") == _ROW)
        .select("_at", F.coalesce(rate, F.lit(0.0)).alias("_prior"))
    )
    joined = known.join(prior.withColumnRenamed("_at", "_asked"), F.col("_at").eqNullSafe(F.col("_asked"))).drop("_asked")
    positives = F.coalesce("_cum_pos", F.lit(0.0))
    seen = F.coalesce("_cum_n", F.lit(0.0))
    rate = (positives + F.lit(float(alpha)) * F.col("_prior")) / F.nullif(
        seen + F.lit(float(alpha)), F.lit(0.0)
    )
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in names],
        positives.cast("float").alias(f"{prefix}_count"),
        rate.cast("float").alias(f"{prefix}_rate"),
    )
