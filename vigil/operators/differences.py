"""Differences of two tables by a tree of sums over key buckets.

Each row has a hash of its key, whose leading bits name a bucket on every
level, and a hash of its content.  The lowest level is one aggregation; the
levels above add it up.  Equal tables are told by their roots alone; of others,
only buckets that differ are followed, and only their rows are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bucket on each level, lowest last: at most 65,536 buckets.
LEVELS = (0, 4, 8, 12, 16)


def _bucket(key: Sequence[str], bits: int = LEVELS[-1]) -> Column:
    hashed = F.xxhash64(*key, *[F.col(k).isNull() for k in key])
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def content_hash(columns: Sequence[str]) -> Column:
    """Hash of a row that tells where its NULLs are."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def tree(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``level``, ``bucket``, ``rows`` and ``digest`` (a sum that does not depend on the order).

    The table is read once; partial sums leave at most one row a task and bucket.
    """
    lowest = df.groupBy(_bucket(key).alias("_low")).agg(
        F.count("*").alias("_rows"), F.sum(content_hash(columns).cast("decimal(38,0)")).alias("_digest")
    )
    levels = F.array(
        *[
            F.struct(F.lit(i).alias("level"), F.shiftright("_low", LEVELS[-1] - bits).alias("bucket"))
            for i, bits in enumerate(LEVELS)
        ]
    )
    each = lowest.select("_rows", "_digest", F.inline(levels))
    return each.groupBy("level", "bucket").agg(F.sum("_rows").alias("rows"), F.sum("_digest").alias("digest"))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lowest buckets in which two trees differ, found level by level from the root."""
    found = None
    for level, bits in enumerate(LEVELS):
        a = left.where(F.col("level") == level).select("bucket", "rows", "digest")
        b = right.where(F.col("level") == level).select(
            "bucket", F.col("rows").alias("_rows"), F.col("digest").alias("_digest")
        )
        if found is not None:
            step = bits - LEVELS[level - 1]
            children = F.transform(F.sequence(F.lit(0), F.lit((1 << step) - 1)), lambda i: F.shiftleft("bucket", step) + i)
            below = found.select(F.explode(children).alias("bucket"))
            a, b = a.join(below, "bucket", "left_semi"), b.join(below, "bucket", "left_semi")
        both = a.join(b, "bucket", "full")
        same = F.col("rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest"))
        found = both.where(~same).select("bucket")
    return found


def differing_rows(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of buckets that differ which one side has more often: ``columns``, ``side`` and ``times``."""
    buckets = differing_buckets(tree(left, key, columns), tree(right, key, columns))
    # buckets of one level: at most 65,536 numbers
    wanted = F.broadcast(buckets)

    def of(df: DataFrame, sign: int) -> DataFrame:
        marked = df.select(*columns, _bucket(key).alias("bucket")).join(wanted, "bucket", "left_semi")
        return marked.drop("bucket").withColumn("_sign", F.lit(sign))

    counted = of(left, 1).unionByName(of(right, -1)).groupBy(*columns).agg(F.sum("_sign").alias("_sum"))
    side = F.when(F.col("_sum") > 0, "left").otherwise("right")
    return counted.where("_sum <> 0").select(*columns, side.alias("side"), F.abs("_sum").alias("times"))
