"""Global order by range partitions: positions and running totals without one task holding a group.

Rows are dealt to partitions by sampled ranges of their order, so the number of
pieces follows the data and the session's partitions, and a group that owns a
third of all rows is cut like any other.  Each piece is ordered for itself;
what the pieces before it hold is added from one small row a group and piece.
The dealt rows are written once, so every reader sees the same pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import materialize

#: Bits below the partition number in Spark's increasing ids.
_BITS = 33


def in_pieces(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` written in ranges, with ``_range_piece`` and ``_range_row``, which ascends in the order of each group."""
    keys = [*[F.col(f"`{g}`").asc_nulls_first() for g in group], *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("_range_row", F.monotonically_increasing_id())
    return materialize(dealt.withColumn("_range_piece", F.shiftright("_range_row", _BITS)), "ranges")


def _of_piece(rows: DataFrame, offsets: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns ``names`` of the offsets of each row's group and piece; a NULL group is a group."""
    right = offsets.select(
        *[F.col(f"`{g}`").alias(f"_range_of_{i}") for i, g in enumerate(group)], F.col("_range_piece").alias("_range_of"), *names
    )
    same = [rows["_range_piece"] == right["_range_of"]]
    same += [rows[f"`{g}`"].eqNullSafe(right[f"_range_of_{i}"]) for i, g in enumerate(group)]
    return rows.join(right, reduce(lambda a, b: a & b, same)).drop("_range_of", *[f"_range_of_{i}" for i in range(len(group))])


def positions(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], position: str = "position", size: str = "size"
) -> DataFrame:
    """``df`` with each row's place in its group (from 0) and the number of rows of the group."""
    rows = in_pieces(df, group, order)
    pieces = rows.groupBy(*group, "_range_piece").agg(F.min("_range_row").alias("_range_first"), F.count("*").alias("_rows"))
    # one row a group and piece
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumns(
        {"_range_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_range_size": F.sum("_rows").over(whole)}
    )
    placed = _of_piece(rows, offsets, group, ["_range_first", "_range_before", "_range_size"])
    place = F.col("_range_row") - F.col("_range_first") + F.col("_range_before")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(position), F.col("_range_size").alias(size))


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], totals: dict[str, Column], whole: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with running sums, the row included, in the order of its group.

    ``whole`` maps further columns to the names of sums whose total over the
    group they hold.
    """
    rows = in_pieces(df, group, order).withColumns({f"_add_{n}": c for n, c in totals.items()})
    sums = rows.groupBy(*group, "_range_piece").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in totals])
    every = Window.partitionBy(*group)
    before = every.orderBy("_range_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumns(
        {f"_before_{n}": F.sum(f"_sum_{n}").over(before) for n in totals}
        | {f"_whole_{k}": F.sum(f"_sum_{n}").over(every) for k, n in (whole or {}).items()}
    )
    inside = Window.partitionBy(*group, "_range_piece").orderBy("_range_row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_in_{n}": F.sum(f"_add_{n}").over(inside) for n in totals})
    carried = [*[f"_before_{n}" for n in totals], *[f"_whole_{k}" for k in whole or {}]]
    both = _of_piece(local, offsets, group, carried)
    return both.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            F.when(F.col(f"_before_{n}").isNull(), F.col(f"_in_{n}"))
            .otherwise(F.col(f"_before_{n}") + F.coalesce(f"_in_{n}", F.lit(0)))
            .alias(n)
            for n in totals
        ],
        *[F.col(f"_whole_{k}").alias(k) for k in whole or {}],
    )
