"""As-of join: for each left row the nearest right row of its key in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ordered import FIRST


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    direction: str = "backward",
    strict: bool = True,
    bucket: str = "day",
) -> DataFrame:
    """Left rows with ``values`` of the nearest right row, NULL where there is none.

    backward, strict: right < left       backward, not strict: right <= left
    forward, strict:  right > left       forward, not strict:  right >= left

    Only keys and times are ordered: the left side is reduced to its distinct
    keys and times before any shuffle, the right side to one row of each key and
    time (the greatest values).  Both are put into one table that is shuffled
    once by ``(by, time bucket)`` and ordered inside a bucket, which so holds at
    most the distinct times of its span.  A time whose bucket holds no match
    takes the edge row of the nearest bucket that has one, found by a window
    over one row per bucket.  An equality join brings the answers to the left
    rows; a key or time that is NULL has no match.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    backward = direction == "backward"
    keys = [f"_by{i}" for i in range(len(by))]
    # At equal times a strict bound must meet the left row first.
    left_rank, right_rank = (0, 1) if strict else (1, 0)

    def narrow(df: DataFrame, ts: str, *more: str) -> DataFrame:
        present = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in (*by, ts)])
        named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
        stamp = F.col(f"`{ts}`").cast("timestamp_ntz").alias("_ts")
        return df.where(present).select(*named, stamp, *more)

    asked = narrow(left, left_ts).distinct().withColumn("_rank", F.lit(left_rank))
    matches = narrow(right, right_ts, F.struct(*values).alias("_right")).groupBy(*keys, "_ts")
    known = matches.agg(F.max("_right").alias("_right")).withColumn("_rank", F.lit(right_rank))
    both = (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn("_bucket", F.date_trunc(bucket, "_ts").cast("timestamp_ntz"))
        # The window and the edge rows both read this exchange.
        .repartition(*keys, "_bucket")
    )
    turn = F.asc if backward else F.desc
    inside = Window.partitionBy(*keys, "_bucket").orderBy(turn("_ts"), F.asc("_rank")).rowsBetween(FIRST, -1)
    across = Window.partitionBy(*keys).orderBy(turn("_bucket")).rowsBetween(FIRST, -1)
    nearest = F.max_by if backward else F.min_by
    edge = nearest("_right", F.when(F.col("_rank") == right_rank, F.col("_ts")))
    edges = both.groupBy(*keys, "_bucket").agg(edge.alias("_edge"))
    carried = edges.select(*keys, "_bucket", F.last("_edge", ignorenulls=True).over(across).alias("_carried"))
    local = both.withColumn("_inside", F.last("_right", ignorenulls=True).over(inside))
    local = local.where(F.col("_rank") == left_rank)
    found = local.join(carried, [*keys, "_bucket"], "left").select(
        *keys, "_ts", F.coalesce("_inside", "_carried").alias("_found")
    )
    same = [F.col(f"`{c}`") == F.col(k) for c, k in zip(by, keys)]
    own = left.withColumn("_own", F.col(f"`{left_ts}`").cast("timestamp_ntz"))
    joined = own.join(found, reduce(lambda a, b: a & b, same, F.col("_own") == F.col("_ts")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in left.columns], *[F.col("_found")[v].alias(v) for v in values]
    )
