"""What the vector searches share: which rows take part, and blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries sent to the tasks together.
QUERY_BLOCK = 2048


def finite(vector: Column) -> Column:
    """A vector that is not null and holds neither nulls nor NaN nor infinities."""
    limit = F.lit(float("inf"))
    parts = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(vector.isNotNull() & parts, F.lit(False))


def one_per_id(df: DataFrame, vec_id: str, vector: Column) -> DataFrame:
    """``id`` and ``vector``: rows with one id count as one, that of the smallest vector; no null ids."""
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), vector.alias("vector"))
    return rows.where("vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))


def query_blocks(queries: DataFrame, rows: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``queries`` (``id``, ``vector``), about ``rows`` of one length at a time.

    A block is chosen by the hash of the id, so a rerun gives the same blocks;
    the driver holds one block.
    """
    sized = queries.withColumn("_length", F.size("vector"))
    for length, count in sorted(tuple(r) for r in sized.groupBy("_length").count().collect()):
        blocks = -(-count // rows)
        numbered = sized.where(F.col("_length") == length).withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for block in range(blocks):
            found = numbered.where(F.col("_block") == block).orderBy("id").select("id", "vector").collect()
            if found:
                vectors = np.array([r["vector"] for r in found]).reshape(len(found), length)
                yield np.array([r["id"] for r in found], dtype=np.int64), vectors


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of an array column without nulls, all of one length."""
    array = batch.column(column)
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), len(flat) // max(1, len(array)))


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best of (``query_id``, ``vec_id``, ``score``) for each query, ties to the smaller id, with ``rank``."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    place = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
