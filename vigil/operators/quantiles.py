"""Exact interpolated quantiles per group, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the sketch that narrows a quantile down to about one part in ACCURACY / 8 of its group.
ACCURACY = 50_000


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """``by`` and ``quantiles`` (array, in the order of ``fractions``) of the values that are numbers.

    A sketch bounds every quantile from both sides.  Values below the bounds
    are only counted, before the shuffle; those between them are reduced to
    distinct values and ordered, which is a small share of a group of any size.
    A sketch that missed its bound raises an error.  Groups without a value are
    left out; a NULL group is a group.
    """
    number = F.col(value).cast("double")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(group.alias("_g"), number.alias("_v"))
    slack = 4.0 / accuracy
    marks = [min(1.0, max(0.0, f + s)) for f in fractions for s in (-slack, slack)]
    sketch = rows.groupBy("_g").agg(
        F.count("*").alias("_rows"), F.percentile_approx("_v", marks, accuracy).alias("_m"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    # where the slack is less than a few rows, the sketch's own rounding could pass it: all values are ordered
    few = F.col("_rows") * F.lit(slack) < 4
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                ((F.col("_rows") - 1) * F.lit(float(f))).alias("place"),
                F.when(few | F.lit(f <= slack), F.col("_min")).otherwise(F.col("_m")[2 * i]).alias("low"),
                F.when(few | F.lit(f >= 1 - slack), F.col("_max")).otherwise(F.col("_m")[2 * i + 1]).alias("high"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    # bounds first: values above are left out, values below become one row a group, quantile and task
    # one row a group goes to the values, which stay where they are: a join that moves them puts a whole group into one task
    bounded = rows.join(F.broadcast(sketch.select("_g", wanted.alias("_wanted"))), "_g")
    each = bounded.select("_g", "_v", F.explode("_wanted").alias("_w")).where("_v <= _w.high")
    cut = F.when(F.col("_v") >= F.col("_w.low"), F.col("_v")).alias("_v")
    near = each.groupBy("_g", "_w", cut).agg(F.count("*").alias("_n"))
    running = Window.partitionBy("_g", "_w").orderBy(F.col("_v").asc_nulls_first())
    counted = near.withColumn("_cum", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("_w.place")
    found = counted.groupBy("_g", "_w").agg(
        F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > F.floor(place)), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > F.ceil(place)), F.col("_v"))).alias("_b"),
        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("_below"),
    )
    # a bound that misses its place would give a neighbour instead
    missed = (F.col("_below") > F.floor(place)) | F.col("_a").isNull() | F.col("_b").isNull()
    found = found.withColumn("_a", F.when(missed, F.raise_error(F.lit("a quantile lies outside its bounds"))).otherwise(F.col("_a")))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))
    ordered = found.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(F.col("_w.i").alias("i"), between.alias("q")))).alias("_q"))
    return ordered.select(*[F.col("_g")[c].alias(c) for c in by], F.col("_q.q").alias("quantiles"))


def with_quantiles(
    stats: DataFrame, df: DataFrame, by: Sequence[str], value: str, names: dict[str, float]
) -> DataFrame:
    """``stats`` (one row a group) and one column for each named quantile; NULL without a value."""
    found = exact_quantiles(df, by, value, list(names.values()))
    found = found.select(
        F.struct(*by).alias("_group") if by else F.struct(F.lit(0).alias("_all")).alias("_group"), "quantiles"
    )
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    both = stats.withColumn("_group", group).join(found, "_group", "left")
    columns = [F.col("quantiles")[i].alias(n) for i, n in enumerate(names)]
    return both.select(*stats.columns, *columns)
