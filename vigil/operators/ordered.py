"""Ordered computations per key that never need a whole key in one task.

A window over one key puts every row of that key into one task, and one noisy
channel may own a third of all rows.  The helpers below split a key into
buckets (usually calendar days), run the window inside ``(key, bucket)``, reduce
each bucket to one edge row, run a second window over those few edge rows and
bring the result back with an equi-join.  The answers are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding
LAST = Window.unboundedFollowing


def neighbour(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: str,
    values: dict[str, str],
    following: bool = False,
) -> DataFrame:
    """Values of the row before (or after) in the order of a key.

    ``values`` maps new column names to the columns they come from, which must
    not be NULL.  ``order`` has to be unique within a key and ``bucket`` must
    not decrease with it.
    """
    direction = F.desc if following else F.asc
    inside = Window.partitionBy(*keys, bucket).orderBy(direction(order))
    across = Window.partitionBy(*keys).orderBy(direction(bucket))
    pick, extreme = (F.min_by, F.min) if following else (F.max_by, F.max)
    edges = df.groupBy(*keys, bucket).agg(
        *[
            (extreme(order) if source == order else pick(source, order)).alias(f"_edge_{name}")
            for name, source in values.items()
        ]
    )
    carried = edges.select(
        *keys, bucket, *[F.lag(f"_edge_{n}").over(across).alias(f"_carried_{n}") for n in values]
    )
    local = df.withColumns({f"_in_{n}": F.lag(c).over(inside) for n, c in values.items()})
    joined = local.join(carried, [*keys, bucket], "left")
    found = {n: F.coalesce(f"_in_{n}", f"_carried_{n}") for n in values}
    helpers = [f"{stem}_{n}" for n in values for stem in ("_in", "_carried")]
    return joined.withColumns(found).drop(*helpers)


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: str,
    totals: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Running sums, the current row included, in the order of a key."""
    direction = F.desc if descending else F.asc
    inside = Window.partitionBy(*keys, bucket).orderBy(direction(order)).rowsBetween(FIRST, 0)
    across = Window.partitionBy(*keys).orderBy(direction(bucket)).rowsBetween(FIRST, -1)
    sums = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    offsets = sums.select(
        *keys, bucket, *[F.sum(f"_{n}").over(across).alias(f"_{n}") for n in totals]
    )
    local = df.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in totals.items()})
    joined = local.join(offsets, [*keys, bucket], "left")
    result = joined.withColumns(
        {n: F.col(f"_in_{n}") + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in totals}
    )
    return result.drop(*[f"_{n}" for n in totals], *[f"_in_{n}" for n in totals])


def number_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers 0, 1, 2, ... without gaps for rows with a unique key.

    Rows are numbered inside buckets of the key's hash; running totals over the
    at most 4,096 buckets (three hexadecimal digits) make the numbers global.
    """
    hashed = df.withColumn("_part", F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 3))
    sizes = hashed.groupBy("_part").agg(F.count("*").alias("_size"))
    across = Window.orderBy("_part").rowsBetween(FIRST, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_part").orderBy(key)
    numbered = hashed.join(F.broadcast(offsets), "_part")
    number = F.col("_offset") + F.row_number().over(inside) - 1
    return numbered.withColumn(name, number).drop("_part", "_offset")
