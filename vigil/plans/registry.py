"""Registry of the queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """Named SQL that the check queries may refer to like a table."""
    PARTS[name] = sql


def _needs(sql: str) -> list[str]:
    return [name for name in PARTS if re.search(rf"\b{name}\b", sql)]


def with_parts(sql: str) -> str:
    """SQL preceded by the named parts it uses, in order of their definition."""
    wanted: set[str] = set()
    queue = _needs(sql)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += _needs(PARTS[name])
    if not wanted:
        return sql
    body = ",\n".join(f"{name} AS ({text})" for name, text in PARTS.items() if name in wanted)
    return f"WITH {body}\n{sql}"


def portable(df: DataFrame) -> DataFrame:
    """Dates as timestamps, booleans and bytes as integers: one type in every engine."""
    casts = {"date": "timestamp_ntz", "boolean": "int", "tinyint": "int"}
    return df.select(
        *[
            F.col(f"`{name}`").cast(casts[kind]).alias(name) if kind in casts else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: portable(run(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def oracle() -> dict[str, str]:
    return {name: with_parts(sql) for name, sql in ORACLE.items()}
