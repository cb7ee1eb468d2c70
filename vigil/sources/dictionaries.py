"""Readers of the channel, object and state dictionaries and of plan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import fixed_values as fv
from vigil.functions import scalars as S

_TEXT, _LONG, _INT, _STAMP = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()


def _schema(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHANNELS_SCHEMA = _schema(
    {
        fv.CHANNEL_KEY: _LONG,
        fv.SENSOR_TYPE: _TEXT,
        fv.OBJECT_KEY: _LONG,
        fv.SYSTEM_TYPE: _TEXT,
        fv.SENSOR_NAME: _TEXT,
        fv.SYSTEM_TAG: _TEXT,
    }
)
OBJECTS_SCHEMA = _schema({fv.OBJECT_KEY: _LONG, fv.OBJECT_NAME: _TEXT})
STATES_SCHEMA = _schema(
    {fv.SENSOR_TYPE: _TEXT, fv.STATE_SET: _LONG, fv.STATE_NAME: _TEXT, fv.STATE_ALARM: _TEXT}
)
REPAIR_PLAN_SCHEMA = _schema(
    {
        "division": _TEXT,
        "plan_month": _TEXT,
        "object_label": _TEXT,
        "sensor_count": _INT,
        "dismantle_start": _STAMP,
        "delivery_text": _TEXT,
        "return_date": _STAMP,
        "acceptance_date": _STAMP,
        "source_row": _INT,
    }
)
EQUIPMENT_SCHEMA = _schema(
    {
        "schedule_group": _INT,
        "object_label": _TEXT,
        "equipment": _TEXT,
        "quantity": _INT,
        "unit": _TEXT,
        "source_row": _INT,
    }
)
MONTHLY_PLAN_SCHEMA = _schema(
    {
        "schedule_group": _INT,
        "object_label": _TEXT,
        "equipment": _TEXT,
        "quantity": _INT,
        "unit": _TEXT,
        "plan_year": _INT,
        "month": _INT,
        "action": _TEXT,
        "source_row": _INT,
        "source_cell": _TEXT,
    }
)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text dictionary with a declared schema; columns are matched by header name."""
    header = spark.read.option("header", True).csv(path).columns
    clean = [name.strip("﻿ ") for name in header]
    by_name = {field.name: field for field in schema}
    layout = T.StructType(
        [by_name.get(name, T.StructField(name, T.StringType())) for name in clean]
    )
    rows = spark.read.schema(layout).option("header", True).option("enforceSchema", True).csv(path)
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in clean]
    present = [F.col(f"`{f.name}`") for f in schema if f.name in clean]
    return rows.select(*present, *absent).select(*[F.col(f"`{f.name}`") for f in schema])


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CHANNELS_SCHEMA)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, OBJECTS_SCHEMA)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State dictionary without exact copies, with the normalised state text."""
    rows = read_table(spark, path, STATES_SCHEMA).distinct()
    return rows.withColumn("state", S.normal_text(F.col(fv.STATE_NAME)))


def channel_metadata(channels: DataFrame) -> DataFrame:
    """Current channel attributes under the names the panel uses."""
    return channels.select(
        F.col(fv.CHANNEL_KEY).cast("string").alias("channel_id"),
        F.col(fv.SENSOR_TYPE).alias("sensor_type_current"),
        F.col(fv.OBJECT_KEY).alias("object_id_current"),
        F.col(fv.SYSTEM_TYPE).alias("system_type_current"),
    )
