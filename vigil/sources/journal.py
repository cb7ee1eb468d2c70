"""Journal readers: raw text files and prepared Parquet, both to one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators.contracts import require_columns

CLEAN_COLUMNS = [
    *fv.RAW_COLUMNS,
    "ts",
    "alarm",
    "num",
    "nonfinite",
    "state",
    "sensor_type",
    "object_id",
    "system_type",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in fv.JOURNAL_COLUMNS])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def journal_path(spark: SparkSession, root: str, year: int) -> str:
    """Prepared Parquet of a year if there is one, else the text file (flat or nested)."""
    text = f"ext-journal-{year}.csv"
    options = [
        f"{root}/processed/events_{year}.parquet",
        f"{root}/{text}",
        f"{root}/ext-journal-{year}/{text}",
    ]
    for path in options:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"no journal of {year} under {root}")


def read_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text journal, every column kept as text, plus the year its file name states."""
    rows = spark.read.schema(RAW_SCHEMA).option("header", True).csv(paths)
    file_year = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})\.csv", 1)
    named = zip(fv.JOURNAL_COLUMNS, fv.RAW_COLUMNS)
    return rows.select(
        *[F.col(f"`{source}`").alias(target) for source, target in named],
        file_year.try_cast("int").alias("file_year"),
    )


def typed(raw: DataFrame) -> DataFrame:
    """Typed journal row from the six text columns; identifiers stay text."""
    require_columns(raw, fv.RAW_COLUMNS)
    number = S.parse_decimal(F.col("value_raw"))
    return (
        raw.withColumn("event_id", F.trim("event_id"))
        .withColumn("channel_id", F.trim("channel_id"))
        .withColumn("ts", S.parse_stamp(F.col("raw_date"), F.col("raw_time")))
        .withColumn("alarm", S.parse_flag(F.col("alarm_raw")))
        .withColumn("num", S.finite_or_null(number))
        .withColumn("nonfinite", S.nonfinite_flag(number))
        .withColumn("state", F.when(number.isNull(), S.normal_text(F.col("value_raw"))))
    )


def attach_channels(events: DataFrame, channels: DataFrame) -> DataFrame:
    """Type, object and system of the channel; events of unknown channels stay.

    The dictionary is read from a file, so Spark knows its size and broadcasts
    it by itself below ``spark.sql.autoBroadcastJoinThreshold``; above that the
    join shuffles and adaptive execution splits a hot channel.
    """
    known = channels.select(
        F.col(fv.CHANNEL_KEY).cast("long").alias("_channel"),
        F.col(fv.SENSOR_TYPE).alias("sensor_type"),
        F.col(fv.OBJECT_KEY).alias("object_id"),
        F.col(fv.SYSTEM_TYPE).alias("system_type"),
    )
    key = F.col("channel_id").try_cast("long")
    return events.join(known, key == F.col("_channel"), "left").drop("_channel")


def read_prepared(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Prepared Parquet journal; raw identifier columns are used where present."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))

    def first_of(names: list[str]) -> F.Column:
        present = [n for n in names if n in rows.columns]
        if not present:
            raise ValueError(f"prepared journal lacks all of {names}")
        return F.trim(F.col(f"`{present[0]}`").cast("string"))

    number = F.col(fv.PREPARED_NUM)
    return rows.select(
        first_of(fv.PREPARED_EVENT_ID).alias("event_id"),
        first_of(fv.PREPARED_CHANNEL_ID).alias("channel_id"),
        F.col("дата").alias("raw_date"),
        F.col("время").alias("raw_time"),
        F.col(fv.PREPARED_ALARM_RAW).alias("alarm_raw"),
        F.col(fv.PREPARED_VALUE_RAW).alias("value_raw"),
        F.col(fv.PREPARED_TS).cast("timestamp_ntz").alias("ts"),
        F.col(fv.PREPARED_ALARM).cast("boolean").alias("alarm"),
        S.finite_or_null(number).alias("num"),
        S.nonfinite_flag(number).alias("nonfinite"),
        S.normal_text(F.col(fv.PREPARED_STATE)).alias("state"),
        F.col(fv.SENSOR_TYPE).alias("sensor_type"),
        F.col(fv.OBJECT_KEY).alias("object_id"),
        F.col(fv.SYSTEM_TYPE).alias("system_type"),
    )


def read_journal(spark: SparkSession, paths: str | list[str], channels: DataFrame) -> DataFrame:
    """Typed journal with channel attributes, from text or prepared Parquet."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    text = [p for p in listed if p.endswith(".csv")]
    prepared = [p for p in listed if not p.endswith(".csv")]
    parts = []
    if text:
        parts.append(attach_channels(typed(read_raw(spark, text)), channels).select(CLEAN_COLUMNS))
    if prepared:
        parts.append(read_prepared(spark, prepared))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
